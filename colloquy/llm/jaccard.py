"""N-gram Jaccard join with a token-group matrix.

Exact, up to 64-bit hashes: no link of different texts is lost, whatever the sizes of groups. All heavy rows are spread
by hashes, and the plan is the same at every size.

1. Document frequencies of all tokens (64-bit hashes of n-word shingles) are counted in a mergeable sketch of fixed size
   over all documents. It only serves to order tokens: rare first, so any error costs time and no result.
2. Sketch, one scan. Equal sets collapse to one node (a hash of the set) in an aggregate; from here on rows are nodes.
3. Meetings. Sets that share a pair of min-hashes meet at the smallest node of their bucket (a pre-aggregated min, one
   row each, never all pairs). Verified meetings link; linked sets are one component.
4. Partition into groups of about ``group_size`` similar sets. A component of more sets is dealt into groups of its own;
   all other sets are dealt, by component, into groups of their family: the sets that met at one node, linked or not.
5. Matrix. Its rows are tokens, its columns groups. Two similar sets share SHARE or more of the first
   n - least_overlap + SHARE tokens in the common order, so only these tokens of each set are entered, and only those of
   several components ask: links within a component need no further look.
6. Bound and open. A query set and a group with a set of another component that share SHARE matrix rows or more are
   bounded twice: by token counts in FOLDS hash cells (a group's is the largest of its members' counts in a cell; the sum
   of the smaller counts is at least the overlap), which moves a few hundred bytes a pair, and then by the group's whole
   token union. Groups that reach the least overlap are opened in one call each: sizes and folded counts choose members,
   and those are verified by exact set intersection, each query's best one first: what it links needs no further look.
7. Components of verified links, joined to those of the links before: edges are drawn between roots of trees, so that few
   are left for repeated min-label hooking; tables are in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

from .shared import Scratch, raw, released, stored, unused

U64 = np.uint64
SKETCH_BITS = 21
SLICE = 1 << 14
STAR_KEYS = 4
GROUP_SIZE = 64
#: Cells of a set's folded counts. Counts beyond 16 bits aren't kept: such a set has no bound and is compared.
FOLDS = 128
MOST_FOLDED = (1 << 16) - 1
#: Stands for no bound; products with it stay within 64 bits.
MOST_OVERLAP = 1 << 48
#: Tokens that a query and a group must share in the matrix.
SHARE = 4
#: Times that edges are drawn between the roots of trees before the rounds of components.
CONTRACTIONS = 2
#: Rounds in which each query verifies its best member only.
ROUNDS = 3
#: Rows of a table of one long that may be broadcast: ids whose texts are looked up, so that texts needn't be shuffled.
MOST_BROADCAST_ROWS = 1_000_000
#: Bytes that are hashed at once.
BLOCK = 1 << 17
_MIX1, _MIX2, _STEP = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)


def mixed(x):
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U64(30))) * _MIX1
    x = (x ^ (x >> U64(27))) * _MIX2
    return x ^ (x >> U64(31))


_SEPARATOR = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: A random value for each byte, the same for A-Z and a-z, and zero for separators.
_BYTE = mixed((np.arange(256, dtype=U64) + U64(32) * ((np.arange(256) >= 65) & (np.arange(256) <= 90)).astype(U64) + U64(1)) * _STEP)
_BYTE[_SEPARATOR] = 0
#: Powers of an odd constant and of its inverse modulo 2**64.
_POWERS = np.cumprod(np.full(BLOCK, _STEP, U64))
_INVERSE = np.cumprod(np.full(BLOCK, pow(int(_STEP), -1, 1 << 64), U64))


def word_hashes(text: bytes | memoryview) -> np.ndarray:
    """A 64-bit hash of each word: the sum of its bytes' values times powers of an odd constant from its start.

    Bytes are summed in blocks with powers from the block's start, which each word's inverse power takes back; a word
    on a block's edge is summed up in parts.
    """
    data = np.frombuffer(text, np.uint8)
    gap = _SEPARATOR[data]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    if len(data) and not gap[0]:
        starts = np.concatenate(([0], starts))
    if not len(starts):
        return np.zeros(0, U64)
    if len(data) <= BLOCK:
        return mixed(np.add.reduceat(_BYTE[data] * _POWERS[: len(data)], starts) * _INVERSE[starts])
    out = np.zeros(len(starts), U64)
    for at in range(0, len(data), BLOCK):
        part = _BYTE[data[at : at + BLOCK]] * _POWERS[: min(BLOCK, len(data) - at)]
        first = max(0, np.searchsorted(starts, at, side="right") - 1)
        last = np.searchsorted(starts, at + BLOCK)
        if first >= last:
            continue
        edges = np.maximum(starts[first:last] - at, 0)
        sums = np.add.reduceat(part, edges) * _INVERSE[edges]
        begun = at - int(starts[first])
        if begun > 0:  # this word's powers go on over the block's edge
            sums[:1] *= U64(pow(int(_STEP), begun, 1 << 64))
        out[first:last] += sums
    return mixed(out)


def shingles(text: bytes | memoryview | None, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a UTF-8 text; fewer words than size make one shingle, none make none."""
    words = word_hashes(text) if text is not None and len(text) else np.zeros(0, U64)
    if not len(words):
        return words
    width = min(size, len(words))
    n = len(words) - width + 1
    out = words[:n] + U64(width)
    for j in range(1, width):
        out = (out ^ (out >> U64(29))) * _MIX2 + words[j : j + n]
    out ^= out >> U64(32)
    out *= _STEP
    out ^= out >> U64(29)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def least_overlap(total: int, percent: int) -> int:
    """The least intersection of two sets of this total size whose Jaccard similarity is percent / 100 or more."""
    return -(-percent * total // (100 + percent))


def node_of(tokens: np.ndarray) -> int:
    """A 64-bit hash of a set, which stands for the set."""
    return int(mixed((tokens.sum(dtype=U64) * _STEP) ^ mixed(mixed(tokens + _MIX1).sum(dtype=U64) + U64(len(tokens)))).view(np.int64))


class Sketcher:
    """What one scan needs to know: shingle size, threshold and the sketch of document frequencies."""

    def __init__(self, size: int, percent: int, cells: np.ndarray, most_folded: int = MOST_FOLDED):
        self.size, self.percent, self.cells, self.most_folded = size, percent, cells, most_folded

    def sketch(self, text: bytes | memoryview | None) -> tuple[int, int, list[int], np.ndarray, bytes | None]:
        """n, node, star keys, the tokens that are entered into the matrix, and the folded counts."""
        tokens = shingles(text, self.size)
        n = len(tokens)
        if not n:
            return 0, 0, [], tokens.view(np.int64), None
        least = np.array([(tokens * k).min() for k in _STARS])
        stars = mixed(least[::2] * _STEP + least[1::2]).view(np.int64).tolist()
        folded = np.bincount((tokens >> U64(57)).astype(np.int64), minlength=FOLDS)
        bound = folded.astype(np.uint16).tobytes() if folded.max() <= self.most_folded else None
        return n, node_of(tokens), stars, self.rarest(tokens).view(np.int64), bound

    def rarest(self, tokens: np.ndarray) -> np.ndarray:
        """The first tokens in the common order: rare ones first, equals by their hashes. The key stands for the token."""
        n = len(tokens)
        rarity = np.minimum(self.cells[(tokens & U64(len(self.cells) - 1)).astype(np.int64)], (1 << 24) - 1).astype(U64)
        keys = rarity << U64(40) | tokens >> U64(24)
        # The least overlap with a partner of any size is the least share of the set itself.
        room = n - -(-self.percent * n // 100) + SHARE
        return np.partition(keys, room - 1)[:room] if room < n else keys


#: Odd factors: a min-hash is the least product of a token with one of them.
_STARS = [U64(x) for x in mixed((np.arange(2 * STAR_KEYS, dtype=U64) + U64(1)) * _STEP) | U64(1)]


def packed(counts: np.ndarray) -> bytes:
    """Counts in the narrowest type that holds them, after a byte that names its width."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or counts.max(initial=0) < 1 << (8 * w))
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def token_counts(rows: DataFrame, size: int) -> np.ndarray:
    """The sketch's cells. Document frequencies of all tokens are summed in 2**SKETCH_BITS cells: each task
    sends its cells once, as slices, and each slice is added up in a stream."""
    cells = 1 << SKETCH_BITS

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            held: list[np.ndarray] = []
            room = 0
            for text in raw(batch.column("text")):
                held.append((shingles(text, size) & U64(cells - 1)).astype(np.int64))
                room += len(held[-1])
                if room > 1 << 18:
                    total += np.bincount(np.concatenate(held), minlength=cells)
                    held, room = [], 0
            if room:
                total += np.bincount(np.concatenate(held), minlength=cells)
        if total.any():
            parts = total.reshape(-1, SLICE)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([packed(p) for p in parts], pa.binary())], names=["slice", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("slice").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + unpacked(x)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([packed(x) for x in sums.values()], pa.binary())], names=["slice", "cells"])

    schema = "slice int, cells binary"
    summed = rows.select("text").mapInArrow(count, schema).repartition(cells // SLICE, "slice").mapInArrow(add, schema)
    total = np.zeros(cells, np.int64)
    for r in stored(summed, "jaccard-cells").collect():  # cells // SLICE rows: 16 MiB in all at most
        total[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = unpacked(r["cells"])
    return total


_SKETCH = "n long, node long, stars array<long>, prefix array<long>, folded binary"


def sketches(rows: DataFrame, size: int, percent: int, cells: np.ndarray) -> DataFrame:
    """id, n, node, star keys, matrix tokens and folded counts of each row (id, text)."""
    shared, most_folded = rows.sparkSession.sparkContext.broadcast(np.minimum(cells, (1 << 24) - 1).astype(np.uint32)), MOST_FOLDED

    @released
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(size, percent, shared.value, most_folded)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                n, node, stars, prefix, folded = zip(*map(sketcher.sketch, raw(part.column("text"))), strict=True)
                ends = np.concatenate(([0], np.cumsum([len(x) for x in prefix]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefix).astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(stars, pa.list_(pa.int64())), lists, pa.array(folded, pa.binary())],
                    names=["id", "n", "node", "stars", "prefix", "folded"],
                )

    return rows.mapInArrow(scan, f"id long, {_SKETCH}")


def token_sets(rows: DataFrame, size: int) -> DataFrame:
    """id, node and the sorted distinct tokens as packed 64-bit values of the rows (id, text); repeated rows once a task."""

    @released
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for at in range(0, len(batch), 250):
                part = batch.slice(at, 250)
                out = {}
                for i, text in zip(part.column("id").to_pylist(), raw(part.column("text")), strict=True):
                    tokens = shingles(text, size)
                    key = (i, node_of(tokens) if len(tokens) else 0)
                    if key not in seen:
                        seen.add(key)
                        out[key] = tokens.tobytes()
                ids, nodes = zip(*out, strict=True) if out else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.int64()), pa.array(out.values(), pa.binary())], names=["id", "node", "tokens"])

    return rows.mapInArrow(scan, "id long, node long, tokens binary")


def _common(a, b) -> int:
    """Intersection size of two packed sorted sets."""
    x, y = np.frombuffer(a, U64), np.frombuffer(b, U64)
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum())


@F.arrow_udf(LongType())
def overlap(a: pa.Array, b: pa.Array) -> pa.Array:
    """Intersection sizes of packed sorted sets."""
    return pa.array([_common(x, y) for x, y in zip(raw(a), raw(b), strict=True)], pa.int64())


@F.arrow_udf(LongType())
def most_overlap(a: pa.Array, b: pa.Array) -> pa.Array:
    """The sums of the smaller of two sets' folded counts, which no overlap exceeds; null, no bound, for a set without counts."""

    def one(x, y):
        if x is None or y is None:
            return None
        return int(np.minimum(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)).sum(dtype=np.int64))

    return pa.array([one(x, y) for x, y in zip(raw(a), raw(b), strict=True)], pa.int64())


@F.arrow_udf(BinaryType())
def _largest(lists: pa.Array) -> pa.Array:
    """Cell by cell the largest of each list of folded counts; null, no bound, if a set has none."""
    return pa.array([np.maximum.reduce([np.frombuffer(x, np.uint16) for x in xs]).tobytes() if None not in xs else None for xs in lists.to_pylist()], pa.binary())


@F.arrow_udf(BinaryType())
def _union(lists: pa.Array) -> pa.Array:
    """The packed sorted union of each list of packed sets."""
    return pa.array([np.unique(np.concatenate([np.frombuffer(x, U64) for x in xs.as_py()])).tobytes() for xs in lists], pa.binary())


def within_bound(a: str, b: str, total, percent: int):
    """Whether sets of these folded counts and this total size may be similar; those without a bound may."""
    return F.coalesce(most_overlap(a, b) * (100 + percent) >= percent * total, F.lit(True))


def similar(percent: int):
    """Jaccard of the columns left and right is percent / 100 or more."""
    both = overlap("left", "right")
    return both * (100 + percent) >= percent * ((F.length("left") + F.length("right")) / 8).cast("long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes, a stored table, whose sets are similar. Only sets of these nodes are shuffled."""
    few, out = pairs.count() <= MOST_BROADCAST_ROWS, pairs
    for x, name in (("a", "left"), ("b", "right")):
        side = sets.select(F.col("node").alias(x), F.col("tokens").alias(name))
        out = out.join(side.join(F.broadcast(pairs.select(x).distinct()), x, "left_semi") if few else side, x)
    return out.where(similar(percent)).select("a", "b")


def fitting(a_n: str, b_n: str, percent: int):
    """Sets of these sizes may be similar."""
    return (F.col(a_n) * 100 >= F.col(b_n) * percent) & (F.col(b_n) * 100 >= F.col(a_n) * percent)


def bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sizes and folded counts allow a link."""
    for x in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("folded").alias(f"{x}_f")), x)
    return pairs.where(fitting("a_n", "b_n", percent)).where(within_bound("a_f", "b_f", F.col("a_n") + F.col("b_n"), percent)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable over the edges (a, b). Nodes without an edge have no row.

    Each round, every node takes the smallest label of itself and its neighbours, and then its label's label. Rounds
    needed grow with the logarithm of a path's length in the usual case; tables are written to the shared folder.
    """
    scratch = Scratch(edges.sparkSession)
    both = scratch.stored(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "cc-edges")
    labels = scratch.stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        # Stored, for it is read three times below: the edges are joined once a round, whether or not Spark reuses exchanges.
        hooked = first = scratch.stored(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "cc-hooked")
        # A label's own better label reaches all that carry it.
        better = hooked.groupBy(F.col("old").alias("root")).agg(F.min("label").alias("best"))
        hooked = hooked.join(better, F.col("old") == F.col("root"), "left").select("node", "old", F.least("label", "best").alias("label"))
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = scratch.stored(hooked.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "cc-labels")
        changed = new.where("label <> old").limit(1).count()
        scratch.drop(labels, first)
        labels = new
        if not changed:
            out = stored(new.select("node", F.col("label").alias("component")), "components")
            scratch.drop()
            return out


def connected(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The components of these edges and of those whose components are known.

    Edges within a known component go first. Then every node hooks on its smallest neighbour if that is smaller, and edges
    are drawn between the roots of the trees so made, CONTRACTIONS times: a row is joined a few times at most, and only the
    edges that are left, few but for odd graphs, take the rounds of ``components``.
    """
    scratch = Scratch(edges.sparkSession)
    labels, live = known, scratch.stored(_contracted(edges, known), "cc-live")
    for k in range(CONTRACTIONS + 1):
        if live.limit(1).count() == 0:
            break
        roots = _rooted(live, scratch) if k < CONTRACTIONS else components(live)
        if k < CONTRACTIONS:
            before, live = live, scratch.stored(_contracted(live, roots), "cc-live")
            scratch.drop(before)
        if labels is not None:
            moved = labels.join(roots.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left")
            moved = moved.select("node", F.coalesce("root", "component").alias("component"))
            roots = moved.unionAll(roots.join(labels.select("node"), "node", "left_anti"))
        labels = scratch.stored(roots, "cc-labels")
    out = stored(labels if labels is not None else live.select(F.col("a").alias("node"), F.col("b").alias("component")), "components")
    scratch.drop()
    return out


def _contracted(edges: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The edges (a, b), a < b, between the components of their ends; a node without a label is one of its own."""
    out = edges.select("a", "b")
    for x in "ab" if labels is not None else "":
        out = out.join(labels.select(F.col("node").alias(x), F.col("component").alias(f"{x}_c")), x, "left").withColumn(x, F.coalesce(f"{x}_c", x)).drop(f"{x}_c")
    return out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rooted(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component: the root of each node of these edges, where its parent is the smallest of itself and its neighbours. Paths halve each round."""
    ends = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    parents = scratch.stored(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "cc-roots")
    while True:
        up = parents.select(F.col("node").alias("component"), F.col("component").alias("up"))
        jumped = scratch.stored(parents.join(up, "component").select("node", F.col("up").alias("component"), F.expr("up <> component").alias("moved")), "cc-roots")
        scratch.drop(parents)
        parents = jumped
        if parents.where("moved").limit(1).count() == 0:
            return parents.select("node", "component")


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 3,
    percent: int = 90,
    group_size: int = GROUP_SIZE,
) -> DataFrame:
    """A row per document: its id, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Two documents link when their sets of word shingles have a Jaccard similarity of percent / 100 or more. Null and
    empty texts have no shingle and link with nothing. Ids are integers; null ids are left out. Repeated rows each have a
    row; texts of one id that differ are linked each by itself. Other columns are ignored.
    """
    rows = _rows(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession)
    sketch = scratch.stored(sketches(rows, size, percent, token_counts(rows, size)), "jaccard-sketch")
    named = scratch.stored(sketch.select("id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")), "jaccard-named")
    nodes, reached = _linked(sketch, rows, size, percent, group_size, scratch)

    # Labels of nodes, by the smallest id of their component.
    names = nodes.select("node", "rep")
    low = reached.join(names, "node").groupBy("component").agg(F.min("rep").alias("low"))
    labels = names.join(reached.join(low, "component").select("node", "low"), "node", "left").select("node", F.coalesce("low", "rep").alias("component_id"))
    out = named.join(labels, "node", "left")
    out = stored(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")), "jaccard-components")
    scratch.drop()
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def _sets_of(wanted: DataFrame, nodes: DataFrame, rows: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """node, tokens of these nodes, read again from the text of each node's smallest id."""
    wanted = scratch.stored(wanted.select("node").distinct().join(nodes.select("node", "rep"), "node"), "jaccard-wanted")
    ids = wanted.select(F.col("rep").alias("id"), "node")
    few = wanted.count() <= MOST_BROADCAST_ROWS
    near = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    found = token_sets(rows.join(near(ids.select("id").distinct()), "id", "left_semi"), size).join(near(ids), ["id", "node"], "left_semi")
    return scratch.stored(found.select("node", "tokens"), "jaccard-tokens")


def _linked(sketch: DataFrame, rows: DataFrame, size: int, percent: int, group_size: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The distinct sets (node, rep, n, folded) and the components (node, component) of all that have a similar one. Drops sketch."""
    nodes = sketch.where("n > 0").groupBy("node").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("stars").alias("stars"), F.first("prefix").alias("prefix"), F.first("folded").alias("folded"))
    nodes = scratch.stored(nodes, "jaccard-nodes")
    scratch.drop(sketch)

    # Sets that share a star key meet at the smallest node there; those that met belong to one family.
    stars = nodes.select("node", F.explode("stars").alias("key"))
    centre = stars.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("key", "a")
    meetings = scratch.stored(stars.join(centre, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct(), "jaccard-meetings")
    families = meetings.groupBy("b").agg(F.min("a").alias("family")).withColumnRenamed("b", "node")
    near = scratch.stored(bounded(meetings, nodes, percent), "jaccard-near")
    tokens = _sets_of(near.select(F.col("a").alias("node")).unionAll(near.select(F.col("b").alias("node"))), nodes, rows, size, scratch)
    reached = connected(verified(near, tokens, percent))
    scratch.drop(tokens, near)

    # Matrix entries: tokens that several sets hold. One exchange serves the count and the filter.
    full, nodes = nodes, scratch.stored(nodes.select("node", "rep", "n", "folded"), "jaccard-nodes")
    entries = full.select("node", F.explode("prefix").alias("token")).where("token is not null").repartition("token")
    several = entries.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("token")
    entries = scratch.stored(entries.join(several, "token", "left_semi"), "jaccard-entries")
    scratch.drop(full)
    members = entries.select("node").distinct().join(reached, "node", "left").join(families, "node", "left").join(nodes.select("node", "n"), "node")
    members = members.select("node", "n", F.coalesce("component", "node").alias("component"), F.coalesce("family", "node").alias("family"))
    members = _dealt(scratch.stored(members, "jaccard-members"), group_size, scratch)
    dealt = scratch.stored(entries.join(members, "node"), "jaccard-dealt")
    scratch.drop(entries)
    return nodes, _opened(dealt, members, reached, nodes, rows, size, percent, scratch)


def _dealt(members: DataFrame, group_size: int, scratch: Scratch) -> DataFrame:
    """Sets with their group: unit (a large component's, or a family's), slot in it, and sets, the unit's number."""
    large = F.col("own") > group_size
    own = members.groupBy("component").agg(F.count("*").alias("own"))
    members = members.join(own, "component").withColumns({"large": large, "unit": F.when(large, F.col("component")).otherwise(F.col("family")), "by": F.when(large, F.col("node")).otherwise(F.col("component"))})
    members = scratch.stored(members.drop("own", "family"), "jaccard-units")
    units = members.groupBy("large", "unit").agg(F.count("*").alias("sets"))
    members = members.join(units, ["large", "unit"]).withColumn("slot", F.pmod(F.xxhash64("by"), F.ceil(F.col("sets") / group_size))).drop("by")
    return scratch.stored(members, "jaccard-slots")


def _opened(dealt: DataFrame, members: DataFrame, reached: DataFrame, nodes: DataFrame, rows: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """The components reached, connected by links of similar sets of different ones: such sets share SHARE matrix tokens, or all they have."""
    group = ["large", "unit", "slot"]
    # Of two units the one with fewer sets asks the other, and within a unit the lower slot the higher. A large component
    # asks none on tokens where it is the last; tokens of one component are no question.
    matrix = dealt.repartition("token")
    tokens = matrix.groupBy("token").agg(F.min("component").alias("first_c"), F.max("component").alias("last_c"), F.max(F.struct("sets", "large", "unit")).alias("last")).where("first_c <> last_c")
    columns = matrix.groupBy("token", *group).agg(
        F.first("sets").alias("sets"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("component").alias("low"), F.max("component").alias("high"),
    )
    ask = matrix.join(tokens.select("token", "last"), "token").select(
        "token", F.col("node").alias("q"), F.col("n").alias("q_n"), F.col("component").alias("q_component"), F.struct("sets", "large", "unit").alias("q_unit"), F.col("slot").alias("q_slot"), "last",
    )
    ask = ask.where(~(F.col("q_unit.large") & (F.col("q_unit") == F.col("last")))).drop("last")
    unit = F.struct("sets", "large", "unit")
    onward = (F.col("q_unit") < unit) | ((F.col("q_unit") == unit) & (F.col("q_slot") <= F.col("slot")))
    others = (F.col("low") != F.col("q_component")) | (F.col("high") != F.col("q_component"))
    sizes = (F.col("q_n") * 100 >= F.col("least") * percent) & (F.col("most") * 100 >= F.col("q_n") * percent)
    met = ask.join(columns, "token").where(onward & others & sizes).groupBy("q", "q_n", "q_component", *group).agg(F.count("*").alias("shared"))
    enough = F.col("shared") >= F.least(F.lit(SHARE), F.ceil(F.col("q_n") * percent / 100))
    asked = scratch.stored(met.where(enough).drop("shared"), "jaccard-asked")
    scratch.drop(dealt)

    # Folded counts of the asked groups bound the overlap first.
    def held(labelled: DataFrame, wanted: DataFrame) -> DataFrame:
        inside = labelled.join(wanted.select(*group).distinct(), group, "left_semi").join(nodes.select("node", "folded"), "node")
        return inside.groupBy(*group).agg(F.min("n").alias("least"), F.collect_list(F.struct("node", "n", "component", "folded")).alias("held"))

    groups = scratch.stored(held(members, asked).select(*group, "least", "held", _largest(F.transform("held", lambda x: x["folded"])).alias("right")), "jaccard-groups")
    first = asked.join(nodes.select(F.col("node").alias("q"), F.col("folded").alias("left")), "q").join(groups.select(*group, "least", "right"), group)
    first = first.where(within_bound("left", "right", F.col("q_n") + F.col("least"), percent))
    asked = scratch.stored(first.drop("least", "right"), "jaccard-asked")

    # Then the token union of each group that is left; groups that reach the least overlap are opened.
    inside = groups.join(asked.select(*group).distinct(), group, "left_semi").select(*group, "least", F.explode("held.node").alias("node"))
    inside = scratch.stored(inside, "jaccard-inside")
    sets = _sets_of(inside.select("node").unionAll(asked.select(F.col("q").alias("node"))), nodes, rows, size, scratch)
    unions = inside.join(sets, "node").groupBy(*group).agg(_union(F.collect_list("tokens")).alias("right"), F.min("least").alias("least"))
    reach = overlap("tokens", "right") * (100 + percent) >= percent * ((F.length("tokens") / 8).cast("long") + F.col("least"))
    opened = asked.join(sets.select(F.col("node").alias("q"), "tokens"), "q").join(unions, group).where(reach).drop("tokens", "right", "least")
    opened = scratch.stored(opened, "jaccard-open")
    scratch.drop(inside)

    # A query's best member over all its opened groups first, in a few rounds, so that a large cluster of near copies is
    # connected by a pair or so for each query and round, not by one for each query and group. A query whose best is no link
    # asks no further here. Sets that are in one component then need no further look, and of the others all members that
    # fit are verified. The union of a lone member was its verification.
    def labelled(rows: DataFrame, node: str, component: str) -> DataFrame:
        now = reached.select(F.col("node").alias(node), F.col("component").alias("_c"))
        return rows.join(now, node, "left").withColumn(component, F.coalesce("_c", component)).drop("_c")

    def seen(queries: DataFrame) -> DataFrame:
        return labelled(queries, "q", "q_component").join(held(labelled(members, "node", "component"), opened).select(*group, "held"), group)

    asking = None
    for _ in range(ROUNDS):
        pairs = seen(opened.join(asking, "q", "left_semi")) if asking is not None else opened.join(groups.select(*group, "held"), group)
        best = scratch.stored(pairs.select("q", (F.size("held") == 1).alias("lone"), _best_member(percent)("left", "q_n", "q_component", "held").alias("best")), "jaccard-bests")
        best = best.where("best is not null").groupBy("q").agg(F.max(F.struct("best.share", "best.node", "lone")).alias("best")).select("q", "best.node", "best.lone")
        best = scratch.stored(best.select("q", "lone", F.least("q", "node").alias("a"), F.greatest("q", "node").alias("b")), "jaccard-best")
        unsure = scratch.stored(best.where("not lone").select("a", "b").distinct(), "jaccard-pairs")
        first = scratch.stored(best.where("lone").select("a", "b").unionAll(verified(unsure, sets, percent)).distinct(), "jaccard-links")
        asking = scratch.stored(best.join(first, ["a", "b"], "left_semi").select("q"), "jaccard-asking")
        reached = connected(first, reached)
        if asking.limit(1).count() == 0:
            break
    pairs = seen(opened).select("q", F.explode(_fitting_members(percent)("left", "q_n", "q_component", "held")).alias("node"))
    pairs = scratch.stored(pairs.select(F.least("q", "node").alias("a"), F.greatest("q", "node").alias("b")).distinct(), "jaccard-pairs")
    return connected(verified(pairs, sets, percent), reached)


def _may(x, n: int, own: int, members: pa.Scalar, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members of an opened group, whether they are of other components and sizes and folded counts allow them to be similar, and the share that these allow."""
    node, size, component, folded = members.values.flatten()
    node, size, component = (c.to_numpy() for c in (node, size, component))
    may = (component != own) & (size * 100 >= n * percent) & (n * 100 >= size * percent)
    most = np.array([MOST_OVERLAP if x is None or y is None else int(np.minimum(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)).sum(dtype=np.int64)) for y in raw(folded)])
    return node, may & (most * (100 + percent) >= percent * (n + size)), most / (n + size)


def _best_member(percent: int):
    """The member of an opened group that may be the most similar, of those of other components that may be similar at all; null without one."""

    @F.arrow_udf("share double, node long")
    def best(left: pa.Array, q_n: pa.Array, q_component: pa.Array, held: pa.Array) -> pa.Array:
        out = []
        for x, n, own, members in zip(raw(left), q_n.to_pylist(), q_component.to_pylist(), held, strict=True):
            node, may, share = _may(x, n, own, members, percent)
            k = int(np.where(may, share, -1.0).argmax())
            out.append({"share": float(share[k]), "node": int(node[k])} if may[k] else None)
        return pa.array(out, pa.struct([("share", pa.float64()), ("node", pa.int64())]))

    return best


def _fitting_members(percent: int):
    """The members of an opened group that are of other components and may be similar."""

    @F.arrow_udf(ArrayType(LongType()))
    def fit(left: pa.Array, q_n: pa.Array, q_component: pa.Array, held: pa.Array) -> pa.Array:
        out = []
        for x, n, own, members in zip(raw(left), q_n.to_pylist(), q_component.to_pylist(), held, strict=True):
            node, may, _ = _may(x, n, own, members, percent)
            out.append(node[may].tolist())
        return pa.array(out, pa.list_(pa.int64()))

    return fit


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """The join itself: component_id and all linked pairs (a, b), a < b, of the smallest ids of equal sets.

    Ids name one text each. A link lies within a component, so all pairs of distinct sets of a component with fitting
    sizes are verified: work grows with the square of their number, as the links of a component of near copies do.
    """
    scratch = Scratch(docs.sparkSession)
    found = jaccard_components(docs, id_col, text_col, size, percent).where("n_shingles > 0").select(F.col(id_col).alias("id"), F.col("component_id").alias("component")).distinct()
    found = scratch.stored(found.join(found.where("id <> component").select("component").distinct(), "component", "left_semi"), "links-found")
    rows = _rows(docs, id_col, text_col).join(found.select("id").distinct(), "id", "left_semi")
    sets = scratch.stored(token_sets(rows, size).join(found, "id").groupBy("component", "tokens").agg(F.min("id").alias("node")), "links-sets")
    left, right = (sets.select("component", F.col("node").alias(x), (F.length("tokens") / 8).cast("long").alias(f"{x}_n")) for x in "ab")
    pairs = left.join(right, "component").where((F.col("a") < F.col("b")) & fitting("a_n", "b_n", percent)).select("a", "b")
    out = verified(scratch.stored(pairs, "links-pairs"), sets, percent).join(found.withColumnRenamed("id", "a"), "a").select(F.col("component").alias("component_id"), "a", "b")
    out = stored(out, "jaccard-pairs")
    scratch.drop()
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Of each component one row, with its own columns; rows without words all stay.

    Rows are told apart by a 64-bit hash of id and text, so a null id is an id and texts that share an id are linked each
    by itself. The row with the smallest id stays, a null one only if there is no other (of one id's texts that with the
    smallest hash); of rows that repeat id and text, one.
    """
    (key,) = unused(docs.columns, "key")
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col), F.col(text_col)))
    found = jaccard_components(keyed, key, text_col, size, percent)
    keys = found.groupBy(key).agg(F.max("n_shingles").alias("n"), F.min("component_id").alias("component"), F.count("*").alias("rows"))
    named = keyed.select(key, F.col(id_col).cast("long").alias("id")).distinct()
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", key, "rows")).alias("first")
    ones = keys.where("n > 0").join(named, key).groupBy("component").agg(first).select(f"first.{key}", "first.rows")
    kept = stored(ones.unionAll(keys.where("n = 0").select(key, F.lit(1).cast("long").alias("rows"))), "kept-keys")
    single = kept.where("rows = 1").select(key)
    others = stored(keys.select(key).join(single, key, "left_anti"), "other-keys")
    out = _among(keyed, single, others, key).select(*docs.columns)
    repeated = kept.where("rows > 1").select(key)
    if repeated.limit(1).count() == 0:
        return out
    row = F.struct(*docs.columns)
    one = keyed.join(repeated, key, "left_semi").groupBy(key).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row"))
    return out.unionAll(one.select("row.*"))


def _among(rows: DataFrame, wanted: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """The rows with a wanted key; wanted and others are all keys. The shorter list is broadcast if it may be, so that texts stay where they are."""
    sizes = wanted.count(), others.count()
    if min(sizes) > MOST_BROADCAST_ROWS:
        return rows.join(wanted, key, "left_semi")
    return rows.join(F.broadcast(wanted), key, "left_semi") if sizes[0] <= sizes[1] else rows.join(F.broadcast(others), key, "left_anti")
