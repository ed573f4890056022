"""Exact top-k inner-product search by columnar branch and bound.

Vectors become integers floor(scale * x). Candidates lie in vertical layout (one row per dimension); for each query the
partial scores of the surviving candidates grow dimension block by dimension block, and after each block those whose
score plus the Cauchy-Schwarz bound on the remaining mass stays below the k-th best known score are compacted away.

Queries go out in blocks of about ``query_block`` rows, one block at a time, so what is broadcast is bounded whatever the
table's size, and every candidate partition is scanned once for each block. Each task returns k rows per query at most; a window merges them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

QUERY_BLOCK = 16_384
DIM_BLOCK = 8
#: Candidates that are laid out vertically at once.
CANDIDATE_BLOCK = 16_384
_SCHEMA = "query_id long, vec_id long, score long"
_SAFE = float(1 << 52)


def usable(vec: str):
    """Not null, and no component null, NaN or infinite."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.col(vec).isNotNull() & ~F.exists(vec, bad)


class Vertical:
    """Integer vectors by dimension, with the squared mass of each dimension block."""

    def __init__(self, ids: np.ndarray, columns: np.ndarray, block: int = DIM_BLOCK):
        self.ids, self.columns, self.block = ids, columns, block
        starts = np.arange(0, max(1, columns.shape[0]), block)
        self.mass = np.add.reduceat(np.square(columns), starts, axis=0) if columns.size else np.zeros((1, len(ids)))

    def best(self, query: np.ndarray, k: int, known: list[tuple[float, int]], own: int) -> list[tuple[float, int]]:
        """The k best of known and these candidates but the query's own: (score, id), best first, ties to smaller ids."""
        floor = known[-1][0] if len(known) == k else -np.inf
        dims = self.columns.shape[0]
        size = self.block
        query = np.pad(query, (0, max(0, dims - len(query))))[:dims]
        q_mass = np.add.reduceat(np.square(query), np.arange(0, max(1, dims), size)) if dims else np.zeros(1)
        order = np.argsort(-q_mass, kind="stable")
        alive = np.flatnonzero(self.ids != own)
        if floor == -np.inf and len(alive) > 4 * k:  # a first floor: whole scores of the candidates with the most mass
            first = alive[np.argpartition(self.mass[:, alive].sum(axis=0), -4 * k)[-4 * k :]]
            floor = np.sort(query @ self.columns[:, first])[-k]
        score = np.zeros(len(alive))
        left_q, left_x = float(q_mass.sum()), self.mass[:, alive].sum(axis=0)
        for b in order:
            score += query[b * size : (b + 1) * size] @ self.columns[b * size : (b + 1) * size, alive]
            left_q -= float(q_mass[b])
            left_x -= self.mass[b, alive]
            if floor > -np.inf:
                keep = score + np.sqrt(max(left_q, 0.0) * np.maximum(left_x, 0.0)) * (1 + 1e-9) + 1e-6 >= floor
                if keep.sum() < 0.8 * len(alive) or b == order[-1]:
                    alive, score, left_x = alive[keep], score[keep], left_x[keep]
        ids = self.ids[alive]
        if len(score) > k:
            least = np.partition(score, -k)[-k]
            keep = score >= least
            score, ids = score[keep], ids[keep]
        return sorted([*known, *zip(score.tolist(), ids.tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]


def integers(vectors: list[list[float]], scale: int) -> np.ndarray:
    """floor(scale * x) as float64, [dimension, row]; shorter vectors are filled with zeros."""
    dims = max(map(len, vectors), default=0)
    if all(len(v) == dims for v in vectors):
        flat = np.array(vectors, np.float64).reshape(len(vectors), dims)
    else:
        flat = np.zeros((len(vectors), dims))
        for i, v in enumerate(vectors):
            flat[i, : len(v)] = v
    return np.floor(flat * scale).T


def exact_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = 256,
    query_block: int = QUERY_BLOCK,
    dim_block: int = DIM_BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k highest integer inner products over all other rows.

    Ties go to the smaller id. Unusable vectors and null ids take no part; a repeated query id is answered once, for its
    smallest vector; repeated candidate rows are candidates each. Shorter vectors count as filled with zeros. A task
    whose products could pass 2**52 computes whole scores in integers of any size; scores must fit a long.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(vec_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    asked = queries.where(usable(vec_col) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(vec_col).alias("v"))
    blocks = max(1, -(-asked.select("id").count() // query_block))

    def answers(block: DataFrame) -> tuple[DataFrame, Broadcast]:
        pairs = [(r["id"], r["v"]) for r in block.toLocalIterator()]
        shared = spark.sparkContext.broadcast((np.array([i for i, _ in pairs], np.int64), integers([v for _, v in pairs], scale)))
        return best_of(rows.mapInArrow(_searcher(shared, k, scale, dim_block), _SCHEMA), k), shared

    if blocks == 1:
        return answers(asked)[0]
    # Block after block: its answers are written, and its queries leave the executors, before the next one's go out.
    asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), "topk-asked")
    found = []
    for b in range(blocks):
        block, shared = answers(asked.where(F.col("block") == b))
        found.append(stored(block, "topk-found"))
        shared.destroy()
    return reduce(DataFrame.unionAll, found)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The best k of what tasks have found for each query."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(shared, k: int, scale: int, dim_block: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, questions = shared.value
        best: list[list[tuple[float, int]]] = [[] for _ in asked]
        for batch in batches:
            for at in range(0, len(batch), CANDIDATE_BLOCK):
                part = batch.slice(at, CANDIDATE_BLOCK)
                ids, columns = part.column("id").to_numpy(), integers(part.column("v").to_pylist(), scale)
                top = np.abs(columns).max(initial=1.0) * np.abs(questions).max(initial=1.0) * max(1, len(columns))
                table = Vertical(ids, columns, dim_block) if top < _SAFE else None
                for j, own in enumerate(asked.tolist()):
                    if table:
                        best[j] = table.best(questions[:, j], k, best[j], own)
                    else:
                        best[j] = _plain(ids, columns, questions[:, j], k, best[j], own)
        out = [(q, i, int(s)) for q, found in zip(asked.tolist(), best, strict=True) for s, i in found]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    return search


def _plain(ids, columns, query, k, known, own):
    """Whole scores in Python integers, for components so large that doubles aren't exact."""
    q = [int(x) for x in query]
    scored = [(sum(a * int(b) for a, b in zip(q, columns[:, i], strict=False)), int(ids[i])) for i in range(len(ids)) if ids[i] != own]
    return sorted([*known, *scored], key=lambda x: (-x[0], x[1]))[:k]
