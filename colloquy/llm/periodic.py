"""Periodic runs of words, found by online dyadic square catching.

Words arrive one after another, in appends of any size. Each completed block of 2^k words is a catcher: it lives while
the words at distances 2^(k+1) to 2^(k+2) - 1 behind it arrive, and each of those is compared, as the suffix of 2^k words
that it starts, with the block (by names that are doubled from level to level). A square whose halves have such a
length holds a whole block in its first half, so it sets its catcher off. From an alarm on, words are compared with those
a period later, backwards at once and forwards as words are appended (a few one by one, the rest by bisection over sums of
hashes), and squares of one period that overlap are one run. Hashes can only let a stretch look too long, and every run
is compared word by word before it counts: runs are exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .shared import raw, released, slices, with_fields

#: Runs are at least so many words long, and at least two periods.
LEAST = 12
#: Words that are appended at once, and that documents are put together for.
APPEND = 1 << 16

#: Two primes below 2^31 and a base: sums of hashes, weighed by its powers, tell whether stretches are equal.
PRIMES, BASE = (2_147_483_647, 2_147_483_629), 1_000_003

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _M[0]
    x ^= x >> np.uint64(32)
    x += b
    x *= _M[1]
    x ^= x >> np.uint64(29)
    x *= _M[2]
    x ^= x >> np.uint64(32)
    return x


class Catchers:
    """The runs of a growing sequence of word numbers; ``longest`` says how long a stretch may have a run at all."""

    def __init__(self, least: int = LEAST, longest: int | None = None):
        self.least, self.longest = least, longest
        self.n = 0
        self.words = np.zeros(0, np.int64)
        self.names: list[np.ndarray] = []  # by level, of the last positions only
        self.blocks: list[np.ndarray] = []  # by level, of completed blocks
        self.cover_end = np.zeros(0, np.int64)
        self.cover_period = np.ones(0, np.int64)
        self.sums = [np.zeros(1, np.int64) for _ in PRIMES]
        self.powers = [np.ones(1, np.int64) for _ in PRIMES]
        self.open = np.zeros((0, 2), np.int64)  # (period, first) of stretches that reach the last word
        self.found: dict[tuple[int, int], int] = {}  # (first, period) of a run -> its end

    def append(self, codes: np.ndarray) -> None:
        old, self.n = self.n, self.n + len(codes)
        self._grow()
        self.words[old : self.n] = codes
        fresh = _mix(codes.astype(np.uint64), np.zeros(len(codes), np.uint64))
        self._sum_up(fresh, old)
        waiting, self.open = self.open, np.zeros((0, 2), np.int64)
        if len(waiting):
            self._settle(waiting[:, 0], waiting[:, 1])
        for k in range(64):
            size = 1 << k
            if self.longest is not None and 4 * size > max(self.longest, 4):
                break
            first = max(0, old - size + 1)  # of the positions whose suffix of this size is complete now
            if k:
                below, start = self.names[k - 1], max(0, self.n - size // 2 + 1) - len(self.names[k - 1])
                if self.n - size < first:
                    break
                at = np.arange(first, self.n - size + 1) - start
                fresh = _mix(below[at], below[at + size // 2])
            if len(self.names) == k:
                self.names.append(np.zeros(0, np.uint64))
                self.blocks.append(np.zeros(0, np.uint64))
            aligned = -first % size
            self.blocks[k] = np.concatenate([self.blocks[k], fresh[aligned::size]])
            self.names[k] = np.concatenate([self.names[k], fresh])
            where = np.arange(first, first + len(fresh))
            for back in (1, 2, 3) if k == 0 else (2, 3):
                block = (where >> k) - back
                live = int(np.searchsorted(block, 0))
                hit = np.flatnonzero(fresh[live:] == self.blocks[k][block[live:]]) + live
                if len(hit):
                    self._alarm(block[hit] << k, where[hit], size)
        for k, held in enumerate(self.names):  # the next level's next names begin so far back
            self.names[k] = held[max(0, len(held) - (2 << k)) :].copy()

    def _grow(self) -> None:
        if self.n > len(self.words):
            room = max(self.n, 2 * len(self.words)) - len(self.words)
            self.words = np.concatenate([self.words, np.zeros(room, np.int64)])
            self.cover_end = np.concatenate([self.cover_end, np.zeros(room, np.int64)])
            self.cover_period = np.concatenate([self.cover_period, np.ones(room, np.int64)])

    def _sum_up(self, hashes: np.ndarray, old: int) -> None:
        for k, p in enumerate(PRIMES):
            while len(self.powers[k]) <= self.n:
                held = self.powers[k]
                self.powers[k] = np.concatenate([held, held * (int(held[-1]) * BASE % p) % p])
            if self.n >= len(self.sums[k]):
                self.sums[k] = np.concatenate([self.sums[k], np.zeros(max(self.n + 1, 2 * old) - len(self.sums[k]), np.int64)])
            weighed = (hashes >> np.uint64(33 * k)).astype(np.int64) % p * self.powers[k][old : self.n] % p
            self.sums[k][old + 1 : self.n + 1] = (self.sums[k][old] + np.cumsum(weighed)) % p

    def _alarm(self, block: np.ndarray, suffix: np.ndarray, size: int) -> None:
        """Blocks that came again: those in a known run of a dividing period and those next to another one tell nothing new."""
        period = suffix - block
        new = (self.cover_end[block] < suffix + size) | (period % self.cover_period[block] != 0)
        block, period = block[new], period[new]
        order = np.lexsort((block, period))
        block, period = block[order], period[order]
        head = np.ones(len(block), bool)
        head[1:] = (period[1:] != period[:-1]) | (block[1:] != block[:-1] + size)
        block, period = block[head], period[head]
        if len(block):
            self._settle(period, block - self._equal(block - 1, period, -1))

    def _settle(self, period: np.ndarray, first: np.ndarray) -> None:
        """Stretches of words that equal those a period later: how far they go, which are runs, which stay open."""
        held = np.unique(np.stack([period, first], axis=1), axis=0)
        period, first = held[:, 0], held[:, 1]
        last = first + self._equal(first, period, 1)
        self.open = np.unique(np.concatenate([self.open, held[last + period == self.n]]), axis=0)
        for i in np.flatnonzero(last - first >= np.maximum(period, self.least - period)).tolist():
            a, q, end = int(first[i]), int(period[i]), int(last[i] + period[i])
            unlike = np.flatnonzero(self.words[a : end - q] != self.words[a + q : end])
            if len(unlike):  # hashes of different words were equal
                end = a + int(unlike[0]) + q
                if end - a < max(2 * q, self.least):
                    continue
            self.found[a, q] = end
            inside = slice(a, end)
            better = self.cover_end[inside] < end
            self.cover_period[inside][better] = q
            self.cover_end[inside][better] = end

    def _equal(self, at: np.ndarray, period: np.ndarray, step: int) -> np.ndarray:
        """How many words in a row, from here in steps of 1 or -1, equal the one a period later."""
        out = np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        for k in range(0, len(at), 1 << 16):
            part = live[k : k + (1 << 16)]
            place = at[part][:, None] + step * np.arange(16)
            later = place + period[part][:, None]
            there = (place >= 0) & (later < self.n)
            same = there & (self.words[np.where(there, place, 0)] == self.words[np.where(there, later, 0)])
            out[part] = np.where(same.all(axis=1), 16, same.argmin(axis=1))
        live = live[out == 16]
        at, period = at[live], period[live]
        low, high = out[live], np.where(step > 0, self.n - period - at, at + 1)  # so many are equal; no more can be
        while (low < high).any():
            half = (low + high + 1) // 2
            first = at if step > 0 else at - half + 1
            equal = np.ones(len(at), bool)
            for p, sums, powers in zip(PRIMES, self.sums, self.powers, strict=True):
                here, there = sums[first + half] - sums[first], sums[first + period + half] - sums[first + period]
                equal &= (here % p * powers[period] - there) % p == 0
            low, high = np.where(equal, half, low), np.where(equal, high, half - 1)
        out[live] = low
        return out

    def runs(self) -> np.ndarray:
        """Rows (start, length, period), by start and period, of the words so far; each stretch with its smallest period."""
        if not self.found:
            return np.zeros((0, 3), np.int64)
        all_ = np.array([(a, end, q) for (a, q), end in self.found.items()], np.int64)
        all_ = all_[np.lexsort((all_[:, 2], all_[:, 1], all_[:, 0]))]
        smallest = np.ones(len(all_), bool)
        smallest[1:] = (all_[1:, :2] != all_[:-1, :2]).any(axis=1)
        all_ = all_[smallest]
        out = np.stack([all_[:, 0], all_[:, 1] - all_[:, 0], all_[:, 2]], axis=1)
        return out[np.lexsort((out[:, 2], out[:, 0]))]


def runs_of(sequences: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """The runs of each sequence of words. Short sequences are appended to one set of catchers, with a word of its own between them."""
    out = [np.zeros((0, 3), np.int64)] * len(sequences)
    order = sorted((i for i, s in enumerate(sequences) if len(s) >= least), key=lambda i: len(sequences[i]))
    while order:
        group, total = [], 0
        while order and (not group or total + len(sequences[order[0]]) <= APPEND):
            group.append(order.pop(0))
            total += len(sequences[group[-1]]) + 1
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        catchers, starts, pending, held = Catchers(least, len(sequences[group[-1]])), [], [], 0
        for k, i in enumerate(group):
            starts.append(catchers.n + held)
            pending.append(np.fromiter(map(numbers.__getitem__, sequences[i]), np.int64, len(sequences[i])))
            pending.append(np.array([-1 - k]))
            held += len(pending[-2]) + 1
        codes = np.concatenate(pending)
        for first in range(0, len(codes), APPEND):
            catchers.append(codes[first : first + APPEND])
        runs = catchers.runs()
        cut = np.searchsorted(runs[:, 0], [*starts, len(codes)])
        for k, i in enumerate(group):
            out[i] = runs[cut[k] : cut[k + 1]] - [starts[k], 0, 0]
    return out


RUNS = ArrayType(StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())]))
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """docs with ``runs``, by start and period, in word numbers of the whole text, and ``collapsed``: the words, joined by
    one space, without those that a run holds after its first period.

    Words are separated by ASCII white space. A null, empty or wordless text has no run and an empty ``collapsed``;
    repeated rows are each treated by themselves; columns of these names, in any case, are replaced; of an empty table
    nothing is returned. Memory follows the longest text of a task.
    """
    kept = docs.select([c for c in docs.columns if c.lower() not in ("runs", "collapsed")])

    @released
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                words = [bytes(t).split() if t is not None else [] for t in raw(part.column(text_col))]
                runs = runs_of(words, least)
                rows = [[{"start": s, "length": n, "period": q} for s, n, q in r.tolist()] for r in runs]
                texts = [b" ".join(_kept(w, r)) for w, r in zip(words, runs, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, _RUNS), pa.array(texts, pa.binary()).cast(pa.string())], names=[*part.schema.names, "runs", "collapsed"])

    return kept.mapInArrow(scan, with_fields(kept.schema, runs=RUNS, collapsed=StringType()))


def _kept(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    if not len(runs):
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def longest_run():
    """The run of greatest length, of those with the smallest start, then period; null without a run."""
    before = F.when(F.col("runs").isNotNull(), F.array_sort("runs", lambda a, b: F.when(a["length"] != b["length"], (b["length"] - a["length"]).cast("int"))
        .when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(F.signum(a["period"] - b["period"]).cast("int"))))
    return F.get(before, F.lit(0))


def runs_text():
    """``start,length,period`` and a line feed for every run, in their order."""
    return F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
