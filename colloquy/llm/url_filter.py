"""URL filters by a Bloom filter cascade.

The listed keys are rules ``host + path``. A url's keys are its host's suffixes times its path's prefixes, in the label
counts and lengths that rules have; the key universe is all keys of the whole corpus. Level 1 encodes the listed keys,
level 2 the universe's false positives of level 1, level 3 the listed keys that level 2 holds wrongly, and so on until
a level has no false positive: then membership is exact for each key of the universe. Urls are judged by testing bits of
literal words, without a join, and only Spark functions run.

Size. The first level's false positive rate is set to |listed| / |universe|, so every later level encodes about as many
keys as are listed and the cascade has O(|listed| * log |universe|) bits. A list whose cascades would pass ``most_bits`` is
split by a hash of its keys into shards, each with the cascades of its own part of list and universe: shard after shard is
built and judges the keys that fall to it, so a plan carries the bits of one shard, and any list has its exact answer.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, stored

#: Bits of the cascades that a plan may carry (as 64-bit words): 8 MiB.
MOST_BITS = 1 << 26
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules that the query judges by.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


@dataclass(frozen=True)
class Shape:
    """The label counts of rules' hosts and the lengths of their paths."""

    labels: tuple[int, ...]
    lengths: tuple[int, ...]

    def keys(self, host: Column, path: Column) -> Column:
        """The url's keys that can be rules, longest first; of equal length the longer host first."""
        found = []
        for c in self.labels:
            for n in self.lengths:
                fits = (F.length(host) > 0) & (F.length(path) >= n) & (F.size(F.split(host, r"\.")) >= c)
                suffix = F.substring_index(host, ".", -c)
                key = F.struct((F.length(suffix) + n).alias("size"), F.length(suffix).alias("host_size"), F.concat(suffix, F.substring(path, 1, n)).alias("key"))
                found.append(F.when(fits, key))
        return F.transform(F.reverse(F.array_sort(F.array_distinct(F.filter(F.array(*found), lambda k: k.isNotNull())))), lambda k: k["key"])


class Level:
    """One Bloom filter as literal 64-bit words."""

    def __init__(self, words: dict[int, int], bits: int, hashes: int, seed: int):
        self.bits, self.hashes, self.seed = bits, hashes, seed
        self.words = [words.get(i, 0) for i in range(-(-bits // 64))]

    @staticmethod
    def positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(seed), F.lit(i), key), F.lit(bits)) for i in range(hashes)]

    def holds(self, key: Column) -> Column:
        table = F.array(*(F.lit(w).cast("long") for w in self.words)) if len(self.words) < 256 else F.from_json(F.lit(str(self.words)), "array<bigint>")
        out = F.lit(True)
        for at in self.positions(key, self.bits, self.hashes, self.seed):
            word = F.element_at(table, (F.shiftright(at, 6) + 1).cast("int"))
            out = out & (F.call_function("getbit", word, F.pmod(at, F.lit(64)).cast("int")) == 1)
        return out


def build_level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter of the n distinct keys of column ``key`` with about this false positive rate."""
    hashes = max(1, round(-math.log2(rate)))
    bits = max(64, math.ceil(n * hashes / math.log(2)))
    at = keys.select(F.explode(F.array(*Level.positions(F.col("key"), bits, hashes, seed))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    return Level({r["word"]: r["bits"] for r in words.collect()}, bits, hashes, seed)


class Cascade:
    """Exact membership of the universe's keys among the listed ones."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def holds(self, key: Column) -> Column:
        """In level 1 but not in 2: listed. In 1 and 2 but not in 3: not listed. And so on; the last level settles it."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[k].holds(key), out).otherwise(F.lit(k % 2 == 1))
        return out


def cascade_bits(listed: int, universe: int) -> int:
    """About the bits of a cascade: its first level, and later ones, which halve every other time and begin with as many keys."""
    return math.ceil(listed * (max(1.0, math.log2(max(universe, 1) / max(listed, 1))) + 4) / math.log(2))


def build_cascade(listed: DataFrame, universe: DataFrame, most_levels: int = 64, universe_size: int | None = None) -> Cascade:
    """listed and universe have a column ``key``; the universe may repeat keys and hold listed ones.

    Each level's keys are a table in the shared folder. The universe is scanned once: what passes level 1 is kept, and
    later levels look only at that. An empty list holds nothing; an empty universe needs one level. ``universe_size`` is about
    its number of distinct keys, counted if it isn't given; it only sets the first level's size.
    """
    members = stored(listed.where("key is not null").distinct(), "cascade-listed")
    n = members.count()
    if not n:
        return Cascade([])
    others = universe.where("key is not null")
    total = distinct_keys(others) if universe_size is None else universe_size
    levels = [build_level(members, n, min(0.5, n / max(total, 2 * n)), 0)]
    passed = others.where(levels[0].holds(F.col("key"))).distinct().join(members, "key", "left_anti")
    wrong, held = stored(passed, "cascade-1"), members
    while (n := wrong.count()) and len(levels) < most_levels:
        levels.append(build_level(wrong, n, 0.5, len(levels)))
        # Now the keys of the level before are tested, and the false positives among them are the next level's.
        wrong, held = stored(held.where(levels[-1].holds(F.col("key"))), f"cascade-{len(levels)}"), wrong
    if n:
        raise RuntimeError("the cascade doesn't settle")
    return Cascade(levels)


def distinct_keys(keys: DataFrame) -> int:
    """About the number of distinct keys of column ``key``."""
    return keys.agg(F.approx_count_distinct("key", 0.02)).first()[0]


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", most_bits: int = MOST_BITS) -> DataFrame:
    """pages with ``host``, ``path``, ``rule`` and ``verdict``; the longest fitting rule decides, without one it is allow.

    rules: verdict (allow or block), host, path; repeated rules count once, and block wins where a rule has both. A null
    url has an empty host, fits no rule and is allowed. Columns of these names are replaced. Repeated rows stay.
    Rules whose cascades take more than ``most_bits`` are judged in shards, and the rows are stored after each shard: select
    the columns of pages that are wanted before.
    """
    rules = stored(rules.select("verdict", "host", "path", F.concat("host", "path").alias("key")).distinct(), "url-rules")
    sizes = rules.agg(F.collect_set(F.size(F.split("host", r"\."))).alias("c"), F.collect_set(F.length("path")).alias("n")).first()
    shape = Shape(tuple(sorted(sizes["c"])), tuple(sorted(sizes["n"])))
    host, path = host_and_path(F.col(url_col))
    drop = [c for c in ("host", "path", "rule", "verdict") if c != url_col and c in pages.columns]
    rows = pages.drop(*drop).withColumns({"host": host, "path": path})
    if not shape.labels:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    keys = shape.keys(F.col("host"), F.col("path"))
    total = distinct_keys(rows.select(F.explode(keys).alias("key")))
    listed = {r["verdict"]: r["n"] for r in rules.groupBy("verdict").agg(F.countDistinct("key").alias("n")).collect()}
    shards = max(1, math.ceil(sum(cascade_bits(n, total) for n in listed.values()) / most_bits))
    if shards == 1:
        return _judged(rows, rules, keys, total, None)
    scratch = Scratch(pages.sparkSession)
    rows = scratch.stored(rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")}), "url-rows")
    for k in range(shards):
        before, out = rows, _judged(rows, rules, keys, -(-total // shards), lambda key, k=k: F.pmod(F.xxhash64(F.lit(-1), key), F.lit(shards)) == k)
        rows = scratch.stored(out, "url-rows") if k < shards - 1 else stored(out, "url-judged")
        scratch.drop(before)
    return rows


def _judged(rows: DataFrame, rules: DataFrame, keys: Column, total: int, of_shard: Callable[[Column], Column] | None) -> DataFrame:
    """rows with rule and verdict. With a shard, those it has from other shards stay where none of this shard's rules is longer."""
    inside = of_shard or (lambda key: F.lit(True))
    universe = rows.select(F.explode(keys).alias("key")).where(inside(F.col("key")))
    blocked, allowed = (build_cascade(rules.where((F.col("verdict") == v) & inside(F.col("key"))).select("key"), universe, universe_size=total) for v in ("block", "allow"))

    def verdict(rule: Column) -> Column:
        return F.when(rule.isNotNull() & blocked.holds(rule), "block").otherwise("allow")

    if of_shard is None:
        rows = rows.withColumn("rule", F.try_element_at(F.filter(keys, lambda k: blocked.holds(k) | allowed.holds(k)), F.lit(1)))
        return rows.withColumn("verdict", verdict(F.col("rule")))
    # The keys are in order, so of the rule from other shards and this shard's the first one decides.
    fits = F.filter(keys, lambda k: k.eqNullSafe(F.col("rule")) | (inside(k) & (blocked.holds(k) | allowed.holds(k))))
    first = F.try_element_at(fits, F.lit(1))
    return rows.withColumns({"rule": first, "verdict": F.when(first.eqNullSafe(F.col("rule")), F.col("verdict")).otherwise(verdict(first))})
