"""Message content of any nesting to text, tools and reasoning size."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions.text import strip
from ..schema import TOOL

PARTS = StructType([StructField("text", StringType()), StructField("tools", ArrayType(TOOL)), StructField("thinking_chars", LongType())])

#: Kinds of content blocks, spelled without case, hyphens, underscores and spaces.
CALLS = ("tooluse", "toolcall", "functioncall", "toolinvocation")
RESULTS = ("toolresult", "toolresponse", "functioncalloutput", "tooloutput")
THINKING = ("thinking", "redactedthinking", "reasoning", "reasoningsummary", "think")
TEXTS = ("text", "inputtext", "outputtext", "plaintext")
SKIPPED = ("image", "inputimage", "document", "audiospeech", "inputaudio")
CONTAINERS = ("content", "text", "parts", "message")
TEXT_KEYS = ("text", "content", "value", "message", "parts", "output", "input", "summary")


class Parts:
    """Collects what one content value holds; nesting is walked with an explicit stack, so depth is no limit."""

    def __init__(self) -> None:
        self.text: list[str] = []
        self.tools: list[tuple[str, str | None]] = []
        self.thinking = 0

    def add(self, content) -> Parts:
        stack = [content]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                self.text += [node] if node else []
            elif isinstance(node, list):
                stack += reversed(node)
            elif isinstance(node, dict):
                below = self._block(node)
                stack += [] if below is None else [below]
        return self

    def _block(self, node: dict):
        """Takes in a typed block; what an untyped one contains is returned to be walked."""
        named = node.get("type") or node.get("kind")
        kind = "".join(c for c in named.lower() if c not in "-_ \t\n") if isinstance(named, str) else ""
        if node.get("thought") is True or node.get("isThought") is True:
            self.thinking += len(node["text"]) if isinstance(node.get("text"), str) else 0
        elif kind in CALLS:
            inner = node.get("function") if isinstance(node.get("function"), dict) else {}
            name = next((x for x in (node.get("name"), node.get("toolName"), node.get("tool_name"), inner.get("name")) if x), "tool")
            given = next((x for x in (node.get("input"), node.get("arguments"), node.get("args"), inner.get("arguments")) if x is not None), None)
            self.tools.append((str(name), given if isinstance(given, str) or given is None else json.dumps(given, ensure_ascii=False)))
        elif kind in THINKING:
            held = next((node[k] for k in ("thinking", "text", "summary", "reasoning") if node.get(k) is not None), "")
            self.thinking += len(held if isinstance(held, str) else "\n".join(strings(held)))
        elif kind in TEXTS:
            self.text += [node["text"]] if isinstance(node.get("text"), str) else []
        elif kind not in RESULTS and kind not in SKIPPED:
            return next((node[k] for k in CONTAINERS if k in node), None)
        return None


def strings(node) -> list[str]:
    """Texts below a value: of an object, under the first text key that leads to any."""
    if isinstance(node, str):
        return [node] if node else []
    if isinstance(node, list):
        return [s for x in node for s in strings(x)]
    if isinstance(node, dict):
        return next((found for k in TEXT_KEYS if k in node and (found := strings(node[k]))), [])
    return []


#: Values that are walked at once; what they become is Arrow again before the next ones are looked at.
SLICE = 500
_TOOL = pa.struct([("name", pa.string()), ("input", pa.string())])
_FIELDS = [("text", pa.string()), ("tools", pa.list_(_TOOL)), ("thinking_chars", pa.int64())]


def _taken_in(contents: pa.Array) -> pa.Array:
    rows = []
    for c in contents.to_pylist():
        p = Parts().add(json.loads(c)) if c is not None else Parts()
        rows.append(("\n".join(p.text).strip(), [{"name": n, "input": i} for n, i in p.tools], p.thinking))
    columns = zip(*rows, strict=True)
    return pa.StructArray.from_arrays([pa.array(x, t) for x, (_, t) in zip(columns, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])


@F.arrow_udf(PARTS)
def _walked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for contents in batches:
        parts = [_taken_in(contents.slice(at, SLICE)) for at in range(0, len(contents), SLICE)]
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(_FIELDS))
        pa.default_memory_pool().release_unused()


def parts_of(content: Column) -> Column:
    """STRUCT<text, tools, thinking_chars> of a variant. Plain strings, the usual case, never leave the JVM: Python is
    asked about every row, so it gets a null for them."""
    simple = content.isNull() | (F.schema_of_variant(content) == "STRING")
    plain = F.struct(strip(F.try_variant_get(content, "$", "string")).alias("text"), F.array().cast(PARTS["tools"].dataType).alias("tools"), F.lit(0).cast("long").alias("thinking_chars"))
    return F.when(simple, plain).otherwise(_walked(F.when(~simple, F.to_json(content))))


def with_parts(rows: DataFrame, content: Column) -> DataFrame:
    """rows with ``p``, the parts of content. Generators keep content from being written out at every use, and a filter on p
    from being a second walk, in workers of its own."""
    held = rows.select("*", F.inline(F.array(F.struct(content.alias("p"))))).withColumn("p", parts_of(F.col("p")))
    return held.select(*rows.columns, F.inline(F.array(F.struct("p"))))
