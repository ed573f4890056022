"""Chat formatting: tool calls linked to their results.

Calls and results meet in a hash join on the conversation and the call's identifier; each call gets its place in the
topological order (a call comes after the call it waits for) by pointer doubling; arguments are validated against the
tools' schemas; and every call is serialised as canonical JSON (sorted keys, no spaces). Only Spark functions run, and
nothing is gathered per conversation, so a conversation may have any number of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored

#: Doublings: chains of up to 2 ** 40 calls; what is left then waits for itself.
MOST_DOUBLINGS = 40
#: Schema rows that may be broadcast.
MOST_BROADCAST = 100_000

#: The tools that the query's conversations use.
SCHEMAS = (
    ("reply", (("chars", "integer", True), ("first", "string", True), ("text", "string", True), ("turn", "integer", True), ("words", "integer", False))),
    ("configure", (("chars", "integer", True), ("first", "string", False), ("text", "string", True), ("turn", "integer", True))),
)


def schemas_frame(spark: SparkSession, schemas=SCHEMAS) -> DataFrame:
    """name, params: an array of (name, type, required)."""
    rows = []
    for name, params in schemas:
        items = [F.struct(F.lit(p).alias("name"), F.lit(t).alias("type"), F.lit(r).alias("required")) for p, t, r in params]
        rows.append(F.struct(F.lit(name).alias("name"), F.array(*items).alias("params")))
    return spark.range(1).select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, after) -> level, null for calls that wait for themselves in a circle.

    level is the number of calls before it on its chain. An ``after`` that names no call counts as none.
    """
    known = calls.select("conv_id", F.col("call_id").alias("after")).withColumn("known", F.lit(True))
    at = calls.join(known, ["conv_id", "after"], "left").select("conv_id", "call_id", F.when(F.col("known"), F.col("after")).alias("next"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("level"))
    at = stored(at, "call-levels")
    for _ in range(MOST_DOUBLINGS):
        if at.where("next is not null").limit(1).count() == 0:
            break
        ahead = at.select("conv_id", F.col("call_id").alias("next"), F.col("next").alias("next2"), F.col("level").alias("level2"))
        at = stored(at.join(ahead, ["conv_id", "next"], "left").select("conv_id", "call_id", F.col("next2").alias("next"), (F.col("level") + F.coalesce("level2", F.lit(0))).alias("level")), "call-levels")
    return at.select("conv_id", "call_id", F.when(F.col("next").isNull(), F.col("level")).alias("level"))


def type_of(value: Column) -> Column:
    """The JSON type of a variant."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "STRING", "string").when(kind.isin("BIGINT", "TINYINT", "SMALLINT", "INT"), "integer").when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind == "VOID", "null").otherwise("number")
    )


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """A row per call: conv_id, call_id, level, turn, name, result_turn, status, errors, json.

    calls: conv_id, call_id, turn, name, arguments (JSON text), after (the call it waits for, or null). results:
    conv_id, call_id, turn, content. schemas: name, params. Other columns are ignored.

    status is linked, unanswered (no result) or circular (no place in the order). Of calls or results with one
    identifier the one with the smallest turn counts (then by content), others repeat it; results without a call are
    left out, as are rows whose conv_id or call_id is null. errors lists what is wrong with the arguments: not a JSON
    object, no such tool, a missing or a mistyped parameter, sorted. (level, turn) sorts a conversation topologically.
    """
    by_turn = F.struct(F.coalesce("turn", F.lit((1 << 63) - 1)).alias("turn"), "name", "arguments", "after", F.col("turn").alias("t"))
    calls = calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(by_turn).alias("c"))
    calls = stored(calls.select("conv_id", "call_id", F.col("c.t").alias("turn"), "c.name", "c.arguments", "c.after"), "calls")
    answer = F.struct(F.coalesce("turn", F.lit((1 << 63) - 1)).alias("turn"), "content", F.col("turn").alias("t"))
    answers = results.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(answer).alias("r"))

    tools = stored(schemas.dropDuplicates(["name"]), "tool-schemas")
    tools = F.broadcast(tools) if tools.count() <= MOST_BROADCAST else tools
    rows = calls.join(levels(calls.select("conv_id", "call_id", "after")), ["conv_id", "call_id"])
    rows = rows.join(answers.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(tools, "name", "left")

    variant = F.try_parse_json(F.col("arguments"))
    is_object = F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))
    rows = rows.withColumn("args", F.when(is_object, variant)).withColumn("given", F.expr("cast(args as map<string, variant>)"))
    missing = F.transform(F.filter("params", lambda p: p["required"] & ~F.map_contains_key("given", p["name"])), lambda p: F.concat(F.lit("missing "), p["name"]))
    mistyped = F.filter("params", lambda p: F.map_contains_key("given", p["name"]) & ~_fits(type_of(F.col("given")[p["name"]]), p["type"]))
    mistyped = F.transform(mistyped, lambda p: F.concat(F.lit("mistyped "), p["name"]))
    errors = F.when(F.col("params").isNull(), F.array(F.lit("no such tool"))).when(F.col("args").isNull(), F.array(F.lit("not an object"))).otherwise(F.array_sort(F.concat(missing, mistyped)))
    status = F.when(F.col("level").isNull(), "circular").when(F.col("r").isNull(), "unanswered").otherwise("linked")
    return rows.select("conv_id", "call_id", "level", "turn", "name", F.col("r.t").alias("result_turn"), status.alias("status"), errors.alias("errors"), canonical(is_object).alias("json"))


def _fits(kind, wanted):
    return (kind == wanted) | ((wanted == "number") & (kind == "integer"))


def json_text(value):
    """A string as JSON, null as null."""
    held = F.to_json(F.struct(value.alias("x")))
    return F.when(value.isNull(), "null").otherwise(F.substr(held, F.lit(6), F.length(held) - 6))


def canonical(is_object):
    """Sorted keys and no spaces: arguments, id, name and result."""
    arguments = F.when(is_object, F.to_json("args")).otherwise(json_text(F.col("arguments")))
    return F.concat(
        F.lit('{"arguments":'), arguments, F.lit(',"id":'), json_text(F.col("call_id")), F.lit(',"name":'), json_text(F.col("name")),
        F.lit(',"result":'), json_text(F.col("r.content")), F.lit("}"),
    )


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations (conv_id, turn, role, text).

    A user turn calls ``reply``, a system turn ``configure``; a call's identifier is ``<conv_id>-<turn>`` and it waits for
    the call two turns before. The assistant's turn after it, whose identifier names the turn before, is its result.
    Arguments hold the turn's whole text, its first word and counts; a null text lacks them and is reported as missing.
    """
    words = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter(F.split("text", " "), lambda w: w != "")))
    fields = [words.alias("words"), F.col("turn").alias("turn"), F.substring_index("text", " ", 1).alias("first"), F.coalesce(F.length("text"), F.lit(0)).alias("chars")]
    arguments = F.to_json(F.struct(*fields, F.col("text")))
    name = F.when(F.col("role") == "user", "reply").when(F.col("role") == "system", "configure")
    key = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    called = turns.where(F.col("role").isin("user", "system"))
    calls = called.select("conv_id", key(F.col("turn")).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"), key(F.col("turn") - 2).alias("after"))
    results = turns.where("role = 'assistant'").select("conv_id", key(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
