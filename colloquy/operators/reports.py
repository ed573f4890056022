"""Catalog reports: per-harness counts, groups, lists, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import time_ago


def harness_report(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """A row per harness: files by outcome, and sessions, ready ones and characters. files: harness, status, length;
    sessions: harness, quiz_ready, chars. Harnesses with only one of the two have zeros for the other."""
    status = lambda s: F.count_if(F.col("status") == s)
    seen = files.groupBy("harness").agg(
        F.count("*").alias("file_count"), status("detected_only").alias("detected_only"), status("empty").alias("empty"), status("skipped").alias("skipped"), F.sum("length").alias("total_bytes"),
    )
    held = sessions.groupBy("harness").agg(F.count("*").alias("session_count"), F.count_if("quiz_ready").alias("quiz_ready"), F.sum("chars").alias("total_chars"))
    numbers = ["file_count", "detected_only", "empty", "skipped", "total_bytes", "session_count", "quiz_ready", "total_chars"]
    return seen.join(held, "harness", "full_outer").na.fill(0, numbers)


def absent_harnesses(registry: DataFrame, detected: DataFrame) -> DataFrame:
    return registry.join(detected.select(F.col("harness").alias("id")).distinct(), "id", "left_anti")


def session_list(sessions: DataFrame, harness: str | None = None, ready_only: bool = False) -> DataFrame:
    """Newest first; ties by id."""
    out = sessions if harness is None else sessions.where(F.col("harness") == harness)
    out = out.where("quiz_ready") if ready_only else out
    return out.orderBy(F.desc_nulls_last("updated_ms"), "session_id")


def search(sessions: DataFrame, query: str, columns: tuple[str, ...] = ("title", "project", "harness_name")) -> DataFrame:
    """Case-insensitive substring over the joined columns; a blank query gives all."""
    needle = query.strip().lower()
    return sessions.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(needle))) if needle else sessions


def grouped(sessions: DataFrame, key: str = "harness", shown: int = 200) -> DataFrame:
    """Groups by size, each with its newest sessions (ids and times; bodies stay out)."""
    entry = F.struct(F.coalesce("updated_ms", F.lit(0)).alias("updated_ms"), "session_id")
    by = Window.partitionBy(key).orderBy(F.desc(entry))
    top = sessions.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= shown).groupBy(key).agg(F.sort_array(F.collect_list(entry), asc=False).alias("newest"))
    return sessions.groupBy(key).agg(F.count("*").alias("size")).join(top, key).orderBy(F.desc("size"), key)


def tool_counts(turns: DataFrame, most: int = 25) -> DataFrame:
    """Tools by calls, ties by name."""
    return turns.select(F.explode("tools").alias("t")).groupBy(F.col("t.name").alias("name")).agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "name").limit(most)


def usage(calls: DataFrame) -> DataFrame:
    """Model calls per quiz: successful ones, attempts, tokens, distinct models in order of first use."""
    pairs = F.array_sort(F.collect_list(F.struct("seq", "model")))
    return calls.groupBy("quiz_id").agg(F.count_if("ok").alias("calls_ok"), F.sum("attempts").alias("attempts"), F.sum("tokens").alias("tokens"), F.array_distinct(F.transform(pairs, lambda p: p["model"])).alias("models"))


def _counted(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(F.format_number(n, 0), F.when(n == 1, f" {one}").otherwise(f" {many or one + 's'}"))


def summary_line(*parts: Column) -> Column:
    """Parts joined by middle dots, nulls left out."""
    return F.concat_ws(" · ", *parts)


def session_line(now_ms: Column) -> Column:
    """Of a row of sessions: turns, tool calls, characters, how long ago."""
    return summary_line(_counted(F.col("messages"), "turn"), F.when(F.col("tool_calls") > 0, _counted(F.col("tool_calls"), "tool call")), _counted(F.col("chars"), "character"), time_ago(now_ms, F.col("updated_ms")))


def catalog_line(catalog: DataFrame) -> DataFrame:
    """Of a harness report: one row, ``line``, with harnesses, sessions, ready ones and files that couldn't be read."""
    sums = catalog.agg(F.count_if(F.col("session_count") > 0).alias("h"), F.sum("session_count").alias("s"), F.sum("quiz_ready").alias("r"), F.sum("skipped").alias("k"))
    return sums.select(summary_line(_counted(F.col("h"), "harness", "harnesses"), _counted(F.coalesce("s", F.lit(0)), "session"), F.concat(F.format_number(F.coalesce("r", F.lit(0)), 0), F.lit(" quiz-ready")), F.when(F.col("k") > 0, F.concat(_counted(F.col("k"), "file"), F.lit(" skipped")))).alias("line"))


def payload_line(payload: DataFrame) -> DataFrame:
    """session_id, line: how much of a session its payload holds."""
    held = payload.groupBy("session_id").agg(F.count("*").alias("n"), F.max("used").alias("c"), F.first("message_count").alias("m"))
    return held.select("session_id", summary_line(F.concat(F.format_number("n", 0), F.lit(" of "), _counted(F.col("m"), "message")), _counted(F.col("c"), "character"), F.when(F.col("n") < F.col("m"), "shortened")).alias("line"))


def plan_line(deck: DataFrame) -> DataFrame:
    """session_id, line: what a deck asks."""
    held = deck.groupBy("session_id").agg(F.count("*").alias("t"), F.max("question_count").alias("q"), F.sum("flashcards").alias("f"), F.max("shortfall").alias("s"))
    short = F.when(F.col("s") > 0, F.concat(F.format_number("s", 0), F.lit(" fewer than asked")))
    return held.select("session_id", summary_line(_counted(F.col("q"), "question"), _counted(F.col("f"), "flashcard"), _counted(F.col("t"), "topic"), short).alias("line"))
