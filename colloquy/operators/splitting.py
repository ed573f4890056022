"""Topics of sessions with over-long segments.

Three choices depend on what was chosen before: where an over-long segment is cut, how messages are packed into pieces of
a size, and what small pieces are folded into. The first looks at a number or two per exchange, by session. The other two
are the same greedy packing, done by pointer doubling: every row's next start comes from a range window over running sums,
and starts are reached from the first one in doubled jumps, so a huge session spreads over the cluster. Texts are never
gathered: a message is cut where it is.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import statement_of, strip
from ..tables import Steps
from .topics import LABEL_CHARS, MAX_SEGMENT_CHARS, MAX_TOPICS, MIN_SEGMENT_CHARS, THRESHOLD, boundaries, exchanges, ranked, segments, topics, with_exchange

#: A message is cut at a line's or sentence's end only past this share of a piece; segments are cut up to so many per topic.
BREAK_SHARE, POOL = 0.5, 12


def packed(rows: DataFrame, block: list[str], order: str, size: str, target: int) -> DataFrame:
    """rows with ``pack``, the order number of the first row of their group: rows of a block are filled into groups of at
    most target in order, a group beginning where the last one had no room. A row over target is a group of its own.

    order counts rows of a block without gaps; size is a whole number. Takes log2(groups of a block) rounds of joins.
    """
    steps = Steps(rows.sparkSession, "packed")
    by = Window.partitionBy(*block).orderBy(order)
    sums = rows.select(*block, F.col(order).alias("at"), F.col(size).cast("long").alias("size")).withColumn("end", F.sum("size").over(Window.partitionBy(*block).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    sums = sums.withColumns({"begin": F.col("end") - F.col("size"), "final": F.max("at").over(Window.partitionBy(*block))})
    within = Window.partitionBy(*block).orderBy("begin").rangeBetween(0, target)  # those that begin within the target of this one
    reach = sums.select(*block, "at", "final", "begin", F.max("at").over(within).alias("far"), F.max("end").over(within).alias("full"), F.min("at").over(Window.partitionBy(*block)).alias("head"))
    after = F.when((F.col("full") > F.col("begin") + target) & (F.col("at") < F.col("final")), F.greatest("far", F.col("at") + 1))
    jumps = steps.stored(reach.select(*block, "at", "head", after.alias("next")))
    starts = steps.stored(jumps.where("at = head").select(*block, "at"))
    jumps, first = jumps.where("next is not null").select(*block, "at", "next"), jumps
    while True:
        reached = steps.stored(starts.join(jumps, [*block, "at"]).select(*block, F.col("next").alias("at")))
        if reached.isEmpty():
            break
        starts = starts.unionByName(reached)
        ahead = jumps.select(*block, F.col("at").alias("next"), F.col("next").alias("then"))
        jumps = steps.stored(jumps.join(ahead, [*block, "next"]).select(*block, "at", F.col("then").alias("next")))
    marked = rows.join(starts.select(*block, F.col("at").alias(order), F.lit(True).alias("_starts")), [*block, order], "left")
    held = F.last(F.when(F.col("_starts"), F.col(order)), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    steps.drop(first)
    return marked.withColumn("pack", held).drop("_starts")


def parts_of(scores: list[float | None], chars: list[int], threshold: float, max_chars: int, most: int) -> list[int]:
    """The part of each exchange: cut before scores of the threshold, then, while there are fewer than most parts, the
    largest one over max_chars at its highest score (the first such)."""
    n = len(scores)
    starts = [0] + [i for i in range(1, n) if scores[i] is not None and scores[i] >= threshold]
    sums = [0]
    for c in chars:
        sums.append(sums[-1] + c)
    heap = [(sums[a] - sums[b], a, b) for a, b in zip(starts, [*starts[1:], n], strict=True) if b - a > 1 and sums[b] - sums[a] > max_chars]
    heapq.heapify(heap)
    while heap and len(starts) < most:
        _, a, b = heapq.heappop(heap)
        at = max(range(a + 1, b), key=lambda i: scores[i])
        starts.append(at)
        for x, y in ((a, at), (at, b)):
            if y - x > 1 and sums[y] - sums[x] > max_chars:
                heapq.heappush(heap, (sums[x] - sums[y], x, y))
    first = set(starts)
    out, part = [], -1
    for i in range(n):
        part += i in first
        out.append(part)
    return out


def cuts_of(text: str, target: int) -> list[tuple[int, int]]:
    """Ranges of at most target characters that tile the text, each cut at its last line's or sentence's end past its middle."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + target)
        if end < len(text):
            stop = max(text.rfind("\n", at, end) + 1, text.rfind(". ", at, end) + 2 if text.rfind(". ", at, end) >= 0 else 0) - at
            end = at + stop if stop > target * BREAK_SHARE else end
        out.append((at, end))
        at = end
    return out


def _parts_column(threshold: float, max_chars: int, most: int):
    @F.arrow_udf("array<int>")
    def run(rows: pa.Array) -> pa.Array:
        out = [parts_of([x["score"] for x in r], [x["chars"] for x in r], threshold, max_chars, most) for r in rows.to_pylist()]
        return pa.array(out, pa.list_(pa.int32()))

    return run


def _cuts_column(target: int):
    @F.arrow_udf("array<struct<a: int, b: int>>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[{"a": a, "b": b} for a, b in cuts_of(t.as_py(), target)] for t in texts], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))

    return run


def derive_topics(
    turns: DataFrame, threshold: float = THRESHOLD, max_topics: int = MAX_TOPICS, max_chars: int = MAX_SEGMENT_CHARS, min_chars: int = MIN_SEGMENT_CHARS, label_chars: int = LABEL_CHARS, max_pieces: int | None = None
) -> DataFrame:
    """topics for all sessions: over-long segments are cut at their strongest inner boundary while they have one, then
    by size; small pieces that hardly differ from what is before them are folded into it if the sum fits.

    A topic that begins or ends within a message has ``char_from`` and ``char_to``, the range of characters of its first
    and last message; others have nulls. A piece that doesn't begin with a user turn is labelled by its own text.
    Boundaries of pieces are looked up by message. With max_pieces, pieces of a part past so many aren't topics, and
    ``cut_chars`` of the part's last topic says how many characters they had; it is 0 elsewhere.

    Sessions without an over-long segment are planned lazily; for the others the packing runs when this is called.
    """
    c = F.col
    parts = segments(exchanges(turns), threshold)
    long = parts.groupBy("session_id", "segment").agg(F.sum("chars").alias("c")).where(c("c") > max_chars).select("session_id").distinct()
    steps = Steps(turns.sparkSession, "topics")
    long = steps.stored(long)
    plain = topics(turns.join(long, "session_id", "left_anti"), threshold, max_topics, label_chars).withColumn("cut_chars", F.lit(0).cast("long"))
    if long.isEmpty():
        return plain
    parts = boundaries(exchanges(turns.join(long, "session_id", "left_semi")))
    parts = steps.stored(parts.select("session_id", "exchange", "start", "end", "user_text", "chars", "score", "wrote", "substantive", "code_blocks", "errors", F.size("files").alias("n_files")))
    numbers = parts.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("exchange", "score", "chars"))).alias("x"))
    numbers = numbers.withColumn("p", _parts_column(threshold, max_chars, POOL * max_topics)(c("x")))
    numbers = numbers.select("session_id", F.explode(F.arrays_zip(c("x.exchange").alias("exchange"), c("p").alias("part"))).alias("e")).select("session_id", "e.exchange", "e.part")
    sums = ("chars", "wrote", "substantive", "code_blocks", "errors", "n_files")
    numbered = parts.join(numbers, ["session_id", "exchange"])
    whole = numbered.groupBy("session_id", "part").agg(
        F.min("start").alias("msg_from"), F.max("end").alias("msg_to"), F.count("*").alias("exchanges"), F.min_by("user_text", "exchange").alias("opening"), *(F.sum(s).alias(s) for s in sums)
    )
    whole = steps.stored(whole)
    none = F.lit(None).cast("int")
    fitting = whole.where(c("chars") <= max_chars).withColumns({"n_files": F.lit(0).cast("long"), "char_from": none, "char_to": none, "sub_split": F.lit(False), "agent_label": F.lit(False), "cut_chars": F.lit(0).cast("long")})
    pieces = steps.stored(fitting.unionByName(_pieces(turns, whole.where(c("chars") > max_chars), max_chars, max_pieces)))
    return plain.unionByName(ranked(_folded(pieces, parts, threshold, min_chars, max_chars), max_topics, label_chars))


def _pieces(turns: DataFrame, over: DataFrame, target: int, most: int | None) -> DataFrame:
    """The pieces of over-long parts, with their part's columns."""
    c = F.col
    key = ["session_id", "part"]
    messages = with_exchange(turns).join(over.select(*key, c("msg_from").alias("_from"), c("msg_to").alias("_to")), "session_id").where("msg_idx between _from and _to")
    messages = messages.select(*key, "msg_idx", "role", "text", F.length("text").alias("size"))
    fits = c("size") <= target
    short = messages.withColumn("block", F.sum((~fits).cast("int")).over(Window.partitionBy(*key).orderBy("msg_idx").rowsBetween(Window.unboundedPreceding, 0))).where(fits)
    groups = packed(short.select(*key, "block", "msg_idx", "size"), [*key, "block"], "msg_idx", "size", target).select(*key, "msg_idx", "pack")
    features = {"_long": (F.length(strip(c("text"))) > 80).cast("int"), "_fences": F.regexp_count("text", F.lit("```")).cast("int")}
    none = F.lit(None).cast("int")
    together = short.join(groups, [*key, "msg_idx"]).withColumns(features).groupBy(*key, "pack").agg(
        F.min("msg_idx").alias("first"), F.max("msg_idx").alias("last"), F.sum("size").alias("own"), F.sum("_long").alias("longs"), F.sum("_fences").alias("fences"), F.min_by("text", "msg_idx").alias("text"), F.min_by("role", "msg_idx").alias("role")
    )
    together = together.select(*key, "first", "last", none.alias("char_from"), none.alias("char_to"), "own", "longs", "fences", "text", "role")
    cut = messages.where(~fits).withColumn("k", F.explode(_cuts_column(target)(c("text")))).withColumn("text", F.substr("text", c("k.a") + 1, c("k.b") - c("k.a"))).withColumns(features)
    cut = cut.select(*key, c("msg_idx").alias("first"), c("msg_idx").alias("last"), c("k.a").alias("char_from"), c("k.b").alias("char_to"), F.length("text").cast("long").alias("own"), c("_long").cast("long").alias("longs"), c("_fences").cast("long").alias("fences"), "text", "role")
    asked = (c("role") == "user") & (F.coalesce("char_from", F.lit(0)) == 0)
    rows = together.unionByName(cut).join(over, key)
    share = c("own") / F.greatest(c("chars"), F.lit(1))
    out = rows.select(
        *key, c("first").alias("msg_from"), c("last").alias("msg_to"), (c("last") - c("first") + 1).cast("long").alias("exchanges"), F.when(asked, c("text")).otherwise(statement_of(c("text"), c("first") + 1)).alias("opening"),
        c("own").alias("chars"), F.bround(c("wrote") * share).cast("long").alias("wrote"), c("longs").alias("substantive"), (c("fences") / 2.0).alias("code_blocks"), F.bround(c("errors") * share).cast("long").alias("errors"),
        F.when(c("first") == c("msg_from"), c("n_files")).otherwise(0).alias("n_files"), "char_from", "char_to", F.lit(True).alias("sub_split"), (~asked).alias("agent_label"),
    )
    if most is None:
        return out.withColumn("cut_chars", F.lit(0).cast("long"))
    by = Window.partitionBy(*key).orderBy("msg_from", "char_from")
    place = F.row_number().over(by)
    later = F.sum("chars").over(by.rowsBetween(1, Window.unboundedFollowing))
    return out.withColumns({"_place": place, "_later": later}).where(c("_place") <= most).withColumn("cut_chars", F.when(c("_place") == most, F.coalesce("_later", F.lit(0))).otherwise(0)).drop("_place", "_later")


def _folded(pieces: DataFrame, parts: DataFrame, threshold: float, min_chars: int, max_chars: int) -> DataFrame:
    """Pieces under min_chars behind weak boundaries go to what is before them, as far as that has room."""
    c = F.col
    before = parts.select("session_id", c("start").alias("msg_from"), "score")
    by = Window.partitionBy("session_id").orderBy("msg_from", "char_from")
    rows = pieces.join(before, ["session_id", "msg_from"], "left").withColumn("place", F.row_number().over(by))
    small = (c("place") > 1) & (c("chars") < min_chars) & (F.coalesce("score", F.lit(0.0)) < threshold)
    rows = rows.withColumn("block", F.sum((~small).cast("int")).over(Window.partitionBy("session_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    groups = packed(rows, ["session_id", "block"], "place", "chars", max_chars)
    first = lambda name: F.min_by(name, "place").alias(name)
    out = groups.groupBy("session_id", "pack").agg(
        F.min("msg_from").alias("msg_from"), F.max_by("msg_to", "place").alias("msg_to"), *map(first, ("opening", "n_files", "char_from", "sub_split", "agent_label")), F.max_by("char_to", "place").alias("char_to"),
        *(F.sum(s).alias(s) for s in ("exchanges", "chars", "wrote", "substantive", "code_blocks", "errors", "cut_chars")),
    )
    order = F.row_number().over(Window.partitionBy("session_id").orderBy("pack")) - 1
    return out.withColumn("segment", order.cast("long")).withColumns({"n_files": c("n_files").cast("int")}).drop("pack")


def with_touched(turns: DataFrame, found: DataFrame) -> DataFrame:
    """topics with ``files`` (distinct, sorted) and ``tools`` (name, count; most used first, then by name) of their messages."""
    from .topics import tool_paths

    key = ["session_id", "msg_from", "char_at"]
    rows = found.withColumn("char_at", F.coalesce("char_from", F.lit(-1)))
    inside = turns.select("session_id", "msg_idx", "tools").where(F.size("tools") > 0).join(rows.select(*key, "msg_to"), "session_id").where("msg_idx between msg_from and msg_to")
    files = inside.select(*key, F.explode(tool_paths(F.col("tools"))).alias("f")).groupBy(*key).agg(F.array_sort(F.collect_set("f")).alias("files"))
    counts = inside.select(*key, F.explode("tools.name").alias("name")).groupBy(*key, "name").agg(F.count("*").alias("count"))
    used = counts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "name"))).alias("t"))
    used = used.select(*key, F.transform("t", lambda x: F.struct(x["name"].alias("name"), (-x["n"]).alias("count"))).alias("tools"))
    out = rows.join(files, key, "left").join(used, key, "left")
    return out.withColumns({"files": F.coalesce("files", F.array().cast("array<string>")), "tools": F.coalesce("tools", F.array().cast("array<struct<name: string, count: bigint>>"))}).drop("char_at")
