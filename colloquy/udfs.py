"""SQL-visible functions, and the points where users extend the engine."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .operators import normalize, splitting
from .operators.redact import Redactor
from .sources.jsonl import register_extractor

__all__ = ["register_extractor", "register_functions", "register_redaction", "register_views", "redactor"]

_redactor = Redactor()


def redactor() -> Redactor:
    """The built-in patterns and the registered ones."""
    return _redactor


def register_redaction(kind: str, pattern: str, flags: str = "", group: int = 0, guard: str | None = None, marks: tuple[str, ...] = ()) -> None:
    """A pattern that claims after the built-in ones. With marks, only texts with one of these literals, in any case, are looked at."""
    global _redactor
    _redactor = _redactor.with_pattern(kind, pattern, flags, group, guard, marks)


#: The line that derive_title makes a title of.
_TITLE_LINE = (
    "t STRING", "STRING",
    r"""regexp_replace(regexp_replace(regexp_replace(try_element_at(filter(transform(split(t, '\\n'), x -> regexp_replace(x, '(?U)^[\\s\\x{FEFF}]+|[\\s\\x{FEFF}]+\\z', '')), x -> x <> '' AND NOT startswith(x, '```')), 1), '^[#>\\-*\\s]+', ''), '(?U)\\s+', ' '), '(?U)^[\\s\\x{FEFF}]+|[\\s\\x{FEFF}]+\\z', '')""",
)
#: SQL text of functions that are expressions: they are inlined into the plan and run in the JVM.
_SQL = {
    "normalize_role": ("role STRING", "STRING", "CASE WHEN lower(role) IN ('human', 'user', 'input') THEN 'user' WHEN lower(role) IN ('system', 'developer') THEN 'system' WHEN lower(role) IN ('tool', 'toolresult', 'tool_result', 'tool-call', 'function') THEN 'tool' ELSE 'assistant' END"),
    "to_epoch_ms": ("value STRING", "BIGINT", r"CASE WHEN value RLIKE '^[0-9]+([.][0-9]+)?$' THEN CASE WHEN try_cast(value AS DOUBLE) <= 0 THEN NULL WHEN try_cast(value AS DOUBLE) < 1e12 THEN CAST(round(try_cast(value AS DOUBLE) * 1000) AS BIGINT) ELSE CAST(round(try_cast(value AS DOUBLE)) AS BIGINT) END ELSE unix_millis(try_to_timestamp(value)) END"),
    "jaccard": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(array_union(a, b)) = 0 THEN 1.0D ELSE CAST(size(array_intersect(a, b)) AS DOUBLE) / size(array_union(a, b)) END"),
    "derive_title": ("t STRING", "STRING", r"""CASE WHEN length(title_line(t)) > 72 THEN concat(regexp_replace(substring(title_line(t), 1, 71), '(?U)\\s+\\z', ''), '…') ELSE title_line(t) END"""),
    "norm_answer": ("t STRING", "STRING", r"""regexp_replace(regexp_replace(lower(coalesce(t, '')), '(?U)^[\\s`"\';,]+|[\\s`"\';,]+\\z', ''), '(?U)\\s+', ' ')"""),
}


def register_functions(spark: SparkSession) -> None:
    """normalize_role, to_epoch_ms, jaccard, norm_answer, derive_title, redact in SQL; the last is Arrow-vectorised."""
    for name, (params, kind, body) in {"title_line": _TITLE_LINE, **_SQL}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
    own = redactor()

    @F.arrow_udf(StringType())
    def redact(texts: pa.Array) -> pa.Array:
        return own.batch(texts).field("text")

    spark.udf.register("redact", redact)




def register_views(spark: SparkSession, turns: DataFrame, **options) -> None:
    """Temporary views ``turns``, ``sessions`` and ``topics`` (of splitting.derive_topics, with its options), to be asked in SQL."""
    turns.createOrReplaceTempView("turns")
    normalize.sessions(turns).createOrReplaceTempView("sessions")
    splitting.derive_topics(turns, **options).createOrReplaceTempView("topics")
