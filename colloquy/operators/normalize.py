"""Messages to turns and sessions: dropping, merging, numbering, rolling up.

All is window and group work on session_id, so one shuffle serves the chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.roles import normal_role
from ..functions.text import strip, title_of

#: A session is quiz-ready with so many user turns and characters.
READY_TURNS, READY_CHARS = 2, 400


def from_conversations(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) in the canonical shape of messages."""
    return conversations.select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("src_pos"), "role", "text", F.lit(None).cast("long").alias("ts_ms"),
        F.lit(None).cast("array<struct<name: string, input: string>>").alias("tools"), F.lit(0).cast("long").alias("thinking_chars"),
    )


def cleaned(messages: DataFrame, keep_tool_output: bool = False) -> DataFrame:
    """Roles normalised, texts trimmed; empty turns go (with their tools) and so do tool turns unless they are kept."""
    out = messages.withColumns({"role": normal_role(F.col("role")), "text": strip(F.coalesce("text", F.lit(""))), "ts_ms": F.when(F.col("ts_ms") > 0, F.col("ts_ms"))})
    out = out.where("length(text) > 0")
    return out if keep_tool_output else out.where("role <> 'tool'")


def merged_turns(messages: DataFrame) -> DataFrame:
    """Consecutive turns of one role become one, if both or neither have tools: texts joined by a blank line, the first
    time and source position, tools one after another. msg_idx counts from 0 after merging. Thinking of merged-in turns
    counts in thinking_all and, as in the reference, not in thinking_chars."""
    by = Window.partitionBy("session_id").orderBy("src_pos")
    has_tools = F.coalesce(F.size("tools") > 0, F.lit(False))
    flags = messages.withColumn("kind", F.struct("role", has_tools.alias("has_tools")))
    flags = flags.withColumn("new", F.coalesce(F.col("kind") != F.lag("kind").over(by), F.lit(True)).cast("int"))
    islands = flags.withColumn("msg_idx", F.sum("new").over(by) - 1)
    turn = F.array_sort(F.collect_list(F.struct("src_pos", "text", "ts_ms", F.coalesce("tools", F.array()).alias("tools"), F.coalesce("thinking_chars", F.lit(0)).alias("thinking"))))
    grouped = islands.groupBy("session_id", "msg_idx").agg(F.first("role").alias("role"), turn.alias("t"))
    return grouped.select(
        "session_id", F.col("msg_idx").cast("int").alias("msg_idx"), F.col("t")[0]["src_pos"].alias("src_pos"), "role", F.array_join("t.text", "\n\n").alias("text"),
        F.col("t")[0]["ts_ms"].alias("ts_ms"), F.flatten("t.tools").alias("tools"), F.col("t")[0]["thinking"].alias("thinking_chars"),
        F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x["thinking"]).alias("thinking_all"), F.size("t").alias("merged"),
    )


def sessions(turns: DataFrame) -> DataFrame:
    """A row per session: turns and characters counted, first and last time, title of the first user turn, readiness."""
    user = F.col("role") == "user"
    out = turns.groupBy("session_id").agg(
        F.count("*").alias("messages"), F.count_if(user).alias("user_turns"), F.sum(F.length("text")).alias("chars"),
        F.sum(F.coalesce(F.size("tools"), F.lit(0))).alias("tool_calls"), F.sum(F.coalesce("thinking_chars", F.lit(0))).alias("reasoning_chars"),
        F.min("ts_ms").alias("started_ms"), F.max("ts_ms").alias("updated_ms"), F.min_by(F.when(user, F.col("text")), F.when(user, F.col("msg_idx"))).alias("first_user"),
    )
    ready = (F.col("user_turns") >= READY_TURNS) & (F.col("chars") >= READY_CHARS)
    return out.withColumns({"title": F.coalesce(title_of(F.col("first_user")), F.lit("Untitled")), "quiz_ready": ready}).drop("first_user")


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order: what dropDuplicates leaves to chance."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(by)).where("_place = 1").drop("_place")


def capped(rows: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each key: a cap that is a feature (sessions shown per harness), not one on work."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(by)).where(F.col("_place") <= most).drop("_place")


def dedupe_sessions(rows: DataFrame) -> DataFrame:
    """By path and native id (a database holds many sessions under one path), the first scanned wins."""
    return first_of(rows, ["path", "native_id"], ["scan_ordinal"])
