"""Mixing sources to target weights.

Words are summed per source (pre-aggregated, so a hot source costs one row per task), targets are filled up under each
source's limit, and every document is taken floor(rate) times plus one Bernoulli copy whose probability is the rate's
fraction under one hash seed, decided by a hash of its id. Each source then takes the best of several seeds, which
conditions the draw (see with_copies). Only Spark functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: The sources' weights, in code point order, repeating.
WEIGHTS = (3, 1, 2)
SHARE, LIMIT = 1.5, 2.0
#: Hash seeds that each source chooses from: the one whose copies come nearest to its target.
SEEDS = 16
#: Sources that may be broadcast; a row is under a kilobyte.
MOST_BROADCAST = 20_000


def n_words(text: Column) -> Column:
    """Runs of other characters than space and \\x09-\\x0D; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def draw(key: Column, seed: Column) -> Column:
    """Uniform in [0, 1): 32 bits of an MD5. A null key draws like an empty one."""
    digest = F.md5(F.concat_ws(":", seed.cast("string"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """source, source_size -> weight and target: share of all sizes by weight, at most limit times the source's own.

    sizes has one row per source. What a source can't take goes to the others by weight, again and again: with sources
    ordered by limit * size / weight, all up to some place are at their limit and the rest share what is left.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    table = F.array(*(F.lit(w).cast("long") for w in weights))
    ranked = sizes.withColumn("weight", F.element_at(table, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    fill = Window.orderBy(F.col("source_size") * F.lit(limit) / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    budget = F.sum("source_size").over(whole) * F.lit(share)
    ranked = ranked.withColumn("level", (budget - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(limit)) / F.sum("weight").over(after))
    ranked = ranked.withColumn("fits", F.col("level") <= F.col("source_size") * F.lit(limit) / F.col("weight"))
    level = F.max(F.when(F.col("fits"), F.struct(-F.col("source_size") * F.lit(limit) / F.col("weight"), "level"))).over(whole)["level"]
    target = F.least(F.col("source_size") * F.lit(limit), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return ranked.withColumn("target", target).select("source", "source_size", "weight", "target")


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))


def _extra(seed: Column) -> Column:
    """1 for a Bernoulli copy of the row (_id) under a seed, else 0."""
    return F.when(draw(F.col("_id"), seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)


def with_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    limit: float = LIMIT,
    seeds: int = SEEDS,
) -> DataFrame:
    """Every row of docs as ``_row``, its ``size`` in words, ``source_size``, ``target`` (both of its source) and ``copies``.

    Rows with the same id draw alike. A null source is a source; a document without words is never copied. Each source
    takes, of ``seeds`` hash seeds, the one whose taken words are nearest to its target (the smallest of equals), which
    steadies sources of few documents. In sources of few or very unequal documents a copy's chance is therefore not the
    rate's fraction: a document that holds most of its source's words practically never gets its copy with a fraction
    under 0.5 and practically always with one above. ``seeds=1`` gives the plain draw. Only one row per source is
    joined to the documents, whose texts aren't shuffled unless sources are too many to be broadcast.
    """
    sized = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    sized = stored(sized, "mix-sizes")
    sources = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit).withColumn("rate", _rate()), "mix-targets")
    few = sources.count() <= MOST_BROADCAST

    def joined(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
        side = table.withColumnRenamed("source", "_s")
        return rows.join(F.broadcast(side) if few else side, F.col(key).eqNullSafe(F.col("_s"))).drop("_s")

    extra = joined(sized, "source", sources).groupBy("source").agg(*(F.sum(F.col("size") * _extra(F.lit(k))).alias(f"x{k}") for k in range(seeds)))
    wanted = F.col("target") - F.floor("rate") * F.col("source_size")
    choice = F.array_min(F.array(*(F.struct(F.abs(F.col(f"x{k}") - wanted), F.lit(k).alias("seed")) for k in range(seeds))))["seed"]
    chosen = stored(joined(extra, "source", sources).select("source", "source_size", "target", "rate", choice.alias("_seed")), "mix-seeds")

    packed = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_key"), n_words(F.col(text_col)).alias("size"))
    out = joined(packed, "_key", chosen)
    copies = F.when(F.col("size") > 0, F.floor("rate") + _extra(F.col("_seed"))).otherwise(F.lit(0)).cast("long")
    return out.select("_row", "size", "source_size", "target", copies.alias("copies"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """A row per document: id, ``size``, ``source_size``, ``target``, ``copies`` and ``taken``, its words in the mix."""
    out = with_copies(docs, id_col=id_col, **options)
    return out.select(F.col(f"_row.`{id_col}`"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Every document as often as the plan takes it, with all its columns and ``copy`` (from 1), which replaces one of that name.

    Documents without words go; repeated rows are taken each by itself, alike if they share an id or have none.
    """
    out = with_copies(docs, **options)
    names = [F.col(f"_row.`{c}`") for c in docs.columns if c != "copy"]
    return out.where("copies > 0").select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
