"""Markdown chat logs: user lines begin with ``#### ``, tool noise with ``> ``, fences are verbatim."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.roles import epoch_ms
from ..functions.text import strip

STARTED = r"^# aider chat started at\s+(.+?)\s*\z"


def read_markdown(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages by path, context by path) of files (path, content).

    Lines are classed by windows: a running count of fences tells what is inside one; runs of one class are turns; a tool
    line closes an assistant's turn; what stands before the first user line goes.
    """
    by = Window.partitionBy("path").orderBy("pos")
    lines = files.select("path", F.posexplode(F.split(F.regexp_replace("content", "\r\n", "\n"), "\n")).alias("pos", "line"))
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    lines = lines.withColumn("fences", F.sum(fence.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1))).withColumn("inside", F.coalesce(F.col("fences") % 2 == 1, F.lit(False)) | fence)
    started = ~F.col("inside") & F.col("line").rlike(STARTED)
    role = (
        F.when(started, "start").when(~F.col("inside") & F.col("line").rlike(r"^####\s"), "user").when(~F.col("inside") & F.col("line").rlike(r"^>"), "tool")
        .otherwise("assistant")
    )
    rows = lines.withColumn("role", role)
    # Blank lines belong to the run before them, so that they don't split a user's turn from its next line.
    blank = (F.col("line").rlike(r"^\s*\z")) & ~F.col("inside")
    rows = rows.withColumn("role", F.when(blank, None).otherwise(F.col("role"))).withColumn("role", F.last("role", ignorenulls=True).over(by)).where("role is not null")
    rows = rows.withColumn("seen", F.max((F.col("role") == "user").cast("int")).over(by)).withColumn("new", F.coalesce(F.col("role") != F.lag("role").over(by), F.lit(True)).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(by)).withColumn("text", F.when(F.col("role") == "user", F.regexp_replace("line", r"^####\s?", "")).otherwise(F.col("line")))
    held = F.array_sort(F.collect_list(F.struct("pos", "text")))
    turns = rows.where("seen = 1 and role in ('user', 'assistant')").groupBy("path", "run").agg(F.min("pos").cast("long").alias("src_pos"), F.first("role").alias("role"), strip(F.array_join(F.transform(held, lambda x: x["text"]), "\n")).alias("text"))
    messages = turns.where("text <> ''").select(
        "path", "src_pos", "role", "text", F.lit(None).cast("long").alias("ts_ms"), F.array().cast("array<struct<name: string, input: string>>").alias("tools"), F.lit(0).cast("long").alias("thinking_chars"),
    )
    began = lines.where(started).groupBy("path").agg(F.min_by("line", "pos").alias("line"))
    null = F.lit(None).cast("string")
    return messages, began.select("path", null.alias("cwd"), null.alias("native_id"), null.alias("title"), epoch_ms(F.regexp_extract("line", STARTED, 1)).alias("started_ms"))
