"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, scanned over every document.

The benchmark goes to the executors in blocks whose index holds about ``block_bytes``, one out at a time, so what is
broadcast is bounded whatever the benchmark's size (a single longer item is a block of its own). One block is the usual
case, and then documents are scanned once and never shuffled. Of several, all but the last are scanned over the distinct
texts' column alone and leave a stored row per text with hits, which joins its documents again by the text's SHA-256.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .shared import raw, released, stored, unused, with_fields

WINDOW = 13
#: Bytes that a block's index may hold, in each Python worker.
BLOCK_BYTES = 128 << 20
#: At most so many bytes are held for a word of an item: its number, its window's hash, place and owner, and its entry in
#: the vocabulary if it is there for the first time.
HELD_A_WORD = 200
#: Windows that are compared at once.
SLICE = 1 << 16

#: Upper-case A-Z to lower case; every byte that is no word character to a space. Bytes of 0x80 and more belong to words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: Words as the byte table tells them.
_RUN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    """The lower-cased words of a UTF-8 text, in order."""
    return text.translate(_FOLD).split() if text else []


class WindowIndex:
    """Windows of benchmark items as arrays: for each window length the sorted hashes of its distinct windows, where each
    begins in the items' words, to compare it word by word, and the items that hold it."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        lists = [np.array([self.ids.setdefault(w, len(self.ids)) for w in words_of(text)], np.int32) for _, text in items]
        self.words = np.concatenate([*lists, np.zeros(0, np.int32)])
        ends = np.cumsum([len(x) for x in lists])
        begun: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for owner, x in enumerate(lists):
            if len(x):
                size = min(window, len(x))
                at = np.arange(ends[owner] - len(x), ends[owner] - size + 1)
                begun[size].append((at, np.full(len(at), owner, np.int32)))
        self.tables = {size: self._table(size, *(np.concatenate(x) for x in zip(*begun[size], strict=True))) for size in sorted(begun)}

    def _windows(self, starts: np.ndarray, size: int) -> np.ndarray:
        return self.words[starts[:, None] + np.arange(size)]

    def _table(self, size: int, at: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, ...]:
        """Hash and place of each distinct window, and its owners as offsets and a list."""
        hashes = np.concatenate([_rolled(self._windows(at[i : i + SLICE], size), size) for i in range(0, len(at), SLICE)])
        order = np.argsort(hashes, kind="stable")
        hashes, at, owners = hashes[order], at[order], owners[order]
        alike = hashes[1:] == hashes[:-1]
        same = np.concatenate([*((self._windows(at[i + 1 : i + 1 + SLICE], size) == self._windows(at[i : i + SLICE][: len(at) - 1 - i], size)).all(axis=1) for i in range(0, len(at) - 1, SLICE)), np.zeros(0, bool)])
        # Different windows of one hash, as good as never: brought into the order of their words.
        for value in np.unique(hashes[1:][alike & ~same]):
            lo, hi = np.searchsorted(hashes, value), np.searchsorted(hashes, value, side="right")
            inner = lo + np.lexsort(self._windows(at[lo:hi], size).T[::-1])
            at[lo:hi], owners[lo:hi] = at[inner], owners[inner]
            same[lo : hi - 1] = (self._windows(at[lo + 1 : hi], size) == self._windows(at[lo : hi - 1], size)).all(axis=1)
        fresh = np.concatenate(([True], ~(alike & same)))
        held = np.unique((np.cumsum(fresh) - 1) * len(self.names) + owners)  # an item counts once for a window
        offsets = np.searchsorted(held, np.arange(fresh.sum() + 1) * len(self.names))
        return hashes[fresh], at[fresh], offsets, (held % len(self.names)).astype(np.int32)

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words, the spans [first, last) of words inside an occurring window, and the items that have one."""
        words = words_of(text)
        get = self.ids.get
        numbers = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        spans, found = [], set()
        for size, (hashes, places, offsets, owners) in self.tables.items():
            if len(words) < size:
                continue
            known = np.concatenate(([0], np.cumsum(numbers >= 0)))
            starts = np.flatnonzero(known[size:] - known[:-size] == size)
            hit = np.zeros(len(words), bool)
            for i in range(0, len(starts), SLICE):
                part = starts[i : i + SLICE]
                own = numbers[part[:, None] + np.arange(size)]
                rolled = _rolled(own, size)
                entry = np.searchsorted(hashes, rolled)
                near = np.flatnonzero(entry < len(hashes))
                near = near[hashes[entry[near]] == rolled[near]]
                met = []
                while len(near):
                    equal = (self._windows(places[entry[near]], size) == own[near]).all(axis=1)
                    hit[part[near[equal]]] = True
                    met.append(entry[near[equal]])
                    near = near[~equal]  # those that met another window of their hash go on to the next
                    entry[near] += 1
                    near = near[entry[near] < len(hashes)]
                    near = near[hashes[entry[near]] == rolled[near]]
                for e in np.unique(np.concatenate(met)).tolist() if met else ():
                    found.update(self.names[o] for o in owners[offsets[e] : offsets[e + 1]].tolist())
            first = np.flatnonzero(hit)
            if len(first):
                breaks = np.flatnonzero(np.diff(first) > size)
                spans += zip(first[np.concatenate(([0], breaks + 1))].tolist(), (first[np.concatenate((breaks, [len(first) - 1]))] + size).tolist(), strict=True)
        return len(words), merged(spans), found


def _rolled(windows: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each row of word numbers."""
    out = np.zeros(len(windows), np.uint64)
    for j in range(size):
        out = out * _STEP + windows[:, j].astype(np.uint64) + np.uint64(1)
        out ^= out >> np.uint64(29)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The distinct items (i, t) in blocks. Rows without an id or a text give no window."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    rows = rows.where("i is not null and t is not null").distinct()
    total = rows.agg(F.sum(F.regexp_count("t", F.lit(_RUN)) * HELD_A_WORD + F.length("i"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    return [rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) for k in range(n)]


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    names: tuple[str, str, str] = ("n_words", "spans", "items"),
) -> DataFrame:
    """Every row of docs with ``n_words``, ``spans`` (word ranges inside benchmark windows) and ``items`` (their ids).

    A null or empty text has no words; repeated rows are judged each by itself; repeated benchmark items count once.
    ``names`` are those of the three columns; columns of docs that have them are replaced, others stay as they are.
    Of several benchmark blocks the hits of one are stored, and its broadcast destroyed, before the next one goes out.
    """
    spark = docs.sparkSession
    docs = docs.select([c for c in docs.columns if c not in names])
    span = StructType([StructField("first", LongType()), StructField("last", LongType())])

    def schema(rows: DataFrame) -> StructType:
        own = StructType([f for f in rows.schema.fields if f.name not in names])
        return with_fields(own, **dict(zip(names, (LongType(), ArrayType(span), ArrayType(StringType())), strict=True)))

    def index(block: DataFrame) -> Broadcast:
        return spark.sparkContext.broadcast(WindowIndex([(r["i"], r["t"].encode()) for r in block.toLocalIterator()], window))

    *early, last = _blocks(benchmark, item_col, item_text_col, block_bytes)
    if not early:
        return docs.mapInArrow(_scanner(index(last), text_col, names, first=True), schema(docs))
    (key,) = unused([*docs.columns, *names], "key")
    _, spans, items = names
    hits = []
    for block in early:
        shared = index(block)
        texts = docs.select(text_col)
        found = texts.mapInArrow(_scanner(shared, text_col, names, first=True), schema(texts)).where(F.size(spans) > 0)
        found = found.select(F.sha2(F.col(text_col).cast("binary"), 256).alias(key), spans, items).groupBy(key).agg(F.first(spans).alias(spans), F.first(items).alias(items))
        hits.append(stored(found, "benchmark-hits"))
        shared.destroy()
    # A row per block at most for each text.
    once = reduce(DataFrame.unionAll, hits).groupBy(key).agg(F.flatten(F.collect_list(spans)).alias(spans), F.flatten(F.collect_list(items)).alias(items))
    out = docs.withColumn(key, F.sha2(F.col(text_col).cast("binary"), 256)).join(once, key, "left").drop(key)
    return out.mapInArrow(_scanner(index(last), text_col, names, first=False), schema(docs))


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _scanner(index, text_col: str, names: tuple[str, str, str], first: bool):
    """Adds a block's hits to those of earlier blocks, which come as columns of their own, null where there is none."""

    @released
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = index.value
        for batch in (b.slice(at, 2000) for b in batches for at in range(0, len(b), 2000)):
            n_words, spans, items = [], [], []
            old = None if first else (batch.column(names[1]).to_pylist(), batch.column(names[2]).to_pylist())
            for i, text in enumerate(raw(batch.column(text_col))):
                n, hit, found = windows.scan(bytes(text) if text is not None else None)
                if old:
                    hit = merged(hit + [(s["first"], s["last"]) for s in old[0][i] or ()])
                    found = found | set(old[1][i] or ())
                n_words.append(n)
                spans.append([{"first": a, "last": b} for a, b in hit])
                items.append(sorted(found))
            own = [c for c in batch.schema.names if c not in names]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in own), pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))],
                names=[*own, *names],
            )

    return scan


def n_hit(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])


def contaminated(least_words_in: int = 20, n_words: str = "n_words", spans: str = "spans"):
    """At least one word is hit, and hit words are a 20th of all words or more."""
    return (n_hit(spans) > 0) & (n_hit(spans) * least_words_in >= F.col(n_words))


def items_digest():
    return F.sha2(F.concat_ws(",", "items"), 256)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that aren't contaminated, with their own columns, whatever their names, and whole texts.

    Documents without words stay; repeated rows are judged each by itself, and so are rows with a null id.
    """
    n_words, spans, items = unused(docs.columns, "n_words", "spans", "items")
    found = find_benchmark(docs, benchmark, names=(n_words, spans, items), **options)
    return found.where(~contaminated(n_words=n_words, spans=spans)).select(docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Every document with its own columns, its hit words cut out of the text; separators beside them stay."""
    n_words, spans, items = unused(docs.columns, "n_words", "spans", "items")

    @F.pandas_udf("string")
    def cut(texts, hit):
        return texts.combine(hit, _without)

    hits = find_benchmark(docs, benchmark, text_col=text_col, names=(n_words, spans, items), **options)
    # A null is skipped at once: only texts with hits are handed over.
    cleaned = F.coalesce(cut(F.when(F.size(spans) > 0, F.col(text_col)), F.col(spans)), F.col(text_col))
    return hits.withColumn(text_col, cleaned).select(docs.columns)


def _without(text: str | None, spans) -> str | None:
    if text is None or not len(spans):
        return text
    data = text.encode()
    folded = np.frombuffer(data.translate(_FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], folded.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for s in spans:
        out.append(data[at : starts[s["first"]]])
        at = ends[s["last"] - 1]
    return b"".join([*out, data[at:]]).decode()


def digest(item_ids: list[str]) -> str:
    """What items_digest() gives, for tests."""
    return hashlib.sha256(",".join(sorted(item_ids)).encode()).hexdigest()
