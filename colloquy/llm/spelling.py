"""Spelling variants: pairs of vocabulary words that differ by exactly one code point, by finite-state composition.

The minimised acceptor of the vocabulary is composed with the transducer that edits once, and with the acceptor again;
what the composed machine accepts are the pairs. It is split by initial states: those that it is in after the half of
the shorter word that the edit leaves alone. Pairs whose edit comes after the first half share that half as a prefix and
are read forwards; the others share the second half and are read backwards. So a word belongs to at most four initial
states, a shuffle deals them out, and a task builds the acceptor of its words behind their initial states, composes, and
enumerates the accepted pairs, breadth first in numpy.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, raw, released, unused

#: Maximal runs of these letters are words.
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: One word of so many, by the crc32 of its document and itself, is read with one letter less.
SLIP = 97
#: Distinct words that a task counts before it hands counts on, and words whose acceptor is built at once.
COUNTED, WORDS = 400_000, 120_000


def _slipped(prefix: int, word: str) -> str:
    h = zlib.crc32(word.encode(), prefix)
    if h % SLIP:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, slips: bool = False) -> DataFrame:
    """(word, n): the words of whole texts, A-Z lower-cased, of at least so many code points and occurrences.

    With ``slips``, one of 97 words of a document (all its occurrences) lacks one letter. Null and empty texts have no
    words; rows with a null id count as id ``null``; every repeated row counts; an empty table has no words; other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), raw(batch.column("text")), strict=True):
                if text is None:
                    continue
                own = Counter(LETTERS.findall(bytes(text).decode("utf-8", "replace").translate(_LOWER)))
                prefix = zlib.crc32(f"{key if key is not None else 'null'}:".encode())
                for word, n in own.items():
                    word = _slipped(prefix, word) if slips else word
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > COUNTED:
                    yield batch_of()
        yield batch_of()

    counted = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def initial_states(words: DataFrame) -> DataFrame:
    """(key, c, back, word, n): the initial states of each word, one per class c (pairs of a word of c and one of c or c + 1
    code points) and direction."""
    length = F.length("word")
    classes = F.array(length, length - 1)
    rows = words.select("word", "n", F.explode(classes).alias("c")).where("c > 0").select("word", "n", "c", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    half = F.floor(F.col("c") / 2).cast("int")
    shared = F.when(F.col("back"), F.expr("right(word, c - cast(floor(c / 2) as int))")).otherwise(F.substring("word", F.lit(1), half))
    return rows.withColumn("key", F.concat_ws(":", F.col("c"), F.col("back").cast("int"), shared))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Acceptor:
    """The minimised acceptor of rows of symbols (0 ends a row), distinct and sorted; it numbers what it accepts."""

    def __init__(self, rows: np.ndarray):
        n, width = rows.shape
        parent = np.zeros(n, np.int64)  # of each row, its state at this depth
        symbols, parents, finals = [], [np.zeros(1, np.int64)], [np.zeros(1, bool)]
        for d in range(width):
            there = rows[:, d] > 0
            new = np.ones(n, bool)
            new[1:] = (parent[1:] != parent[:-1]) | (rows[1:, d] != rows[:-1, d])
            new &= there
            number = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            symbols.append(rows[first, d].astype(np.int64))
            parents.append(parent[first])
            last = there & (rows[:, d + 1] == 0 if d + 1 < width else True)
            final = np.zeros(len(first), bool)
            final[number[last]] = True
            finals.append(final)
            parent = np.where(there, number, -1 - np.arange(n))
            if not there.any():
                break
        # States with equal futures have equal signatures: from the deepest up, sums over what follows.
        signatures = [np.zeros(0, np.uint64)] * len(finals)
        below = np.zeros(0, np.uint64)
        for d in range(len(finals) - 1, -1, -1):
            own = np.where(finals[d], np.uint64(0x2545F4914F6CDD1D), np.uint64(1))
            if d < len(symbols) and len(symbols[d]):
                np.add.at(own, parents[d + 1], _mixed(below ^ _mixed(symbols[d].astype(np.uint64) + np.uint64(1))))
            signatures[d] = below = own
        offsets = np.cumsum([0, *(len(s) for s in signatures)])
        _, kept, state = np.unique(np.concatenate(signatures), return_index=True, return_inverse=True)
        self.start = int(state[0])
        self.final = np.concatenate(finals)[kept]
        # The transitions of the kept representatives, by state and symbol.
        source = np.concatenate([offsets[d] + parents[d + 1] for d in range(len(symbols))])
        target = np.concatenate([offsets[d + 1] + np.arange(len(symbols[d])) for d in range(len(symbols))])
        symbol = np.concatenate(symbols)
        own = kept[state[source]] == source
        self.source, self.symbol, self.target = state[source[own]], symbol[own], state[target[own]]
        order = np.lexsort((self.symbol, self.source))
        self.source, self.symbol, self.target = self.source[order], self.symbol[order], self.target[order]
        self.first = np.searchsorted(self.source, np.arange(len(kept) + 1))
        # How many words each state accepts, and their least and greatest lengths: by the trie, from the deepest up.
        words, least, most = (np.zeros(offsets[-1], np.int64) for _ in range(3))
        for d in range(len(finals) - 1, -1, -1):
            at = slice(offsets[d], offsets[d + 1])
            words[at], least[at], most[at] = finals[d], np.where(finals[d], 0, 1 << 30), 0
            if d < len(symbols) and len(symbols[d]):
                deeper = slice(offsets[d + 1], offsets[d + 2])
                up = offsets[d] + parents[d + 1]
                np.add.at(words, up, words[deeper])
                np.minimum.at(least, up, least[deeper] + 1)
                np.maximum.at(most, up, most[deeper] + 1)
        self.words, self.least, self.most = words[kept], least[kept], most[kept]
        # Words before those through a transition, among the source's.
        passed = np.cumsum(self.words[self.target]) - self.words[self.target]
        self.skip = passed - passed[np.minimum(self.first[self.source], max(0, len(passed) - 1))] + self.final[self.source] if len(passed) else passed

    def leaving(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the states, transition) for all transitions of all states."""
        n = self.first[states + 1] - self.first[states]
        which = np.repeat(np.arange(len(states)), n)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + self.first[states][which]


def composed_pairs(machine: Acceptor, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (number, number) that acceptor, one-edit transducer and acceptor, composed, accept behind each initial state.

    The first symbol of a row is its initial state. ``left`` has, by transition of the machine's start, how many code
    points the words of the smaller class have behind it: pairs have a word of that class, and one of it or one longer.
    The transducer copies up to the edit, then replaces (smaller symbol on the left, so a pair comes once) or inserts
    (only where the next copied symbol is another, so the place is unique), then copies to the end.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    start = np.arange(machine.first[machine.start], machine.first[machine.start + 1])
    state, number, rest = machine.target[start], machine.skip[start], left.copy()
    both: list[np.ndarray] = [np.zeros(0, np.int64)] * 6  # left and right state, their numbers, symbols to come on the left, symbol that may not come next
    while len(state) or len(both[0]):
        grown = [_copied(machine, both, out)]
        which, edge = machine.leaving(state)
        usable = rest[which] > 0
        w, e = which[usable], edge[usable]
        # Replacements: ordered pairs of transitions of one state whose futures have words of the class.
        able = machine.least[machine.target[e]] == rest[w] - 1
        rw, re_ = w[able], e[able]
        degree = np.bincount(rw, minlength=len(state))
        first = np.cumsum(degree) - degree
        later = degree[rw] - (np.arange(len(rw)) - first[rw]) - 1
        i = np.repeat(np.arange(len(rw)), later)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
        a, b = re_[i], re_[j]
        at = rw[i]
        grown.append([machine.target[a], machine.target[b], number[at] + machine.skip[a], number[at] + machine.skip[b], rest[at] - 1, np.full(len(a), -1)])
        # Insertions: the left word stays, the right one takes any symbol.
        able = (machine.least[state[which]] == rest[which]) & (machine.most[machine.target[edge]] == rest[which])
        iw, ie = which[able], edge[able]
        grown.append([state[iw], machine.target[ie], number[iw], number[iw] + machine.skip[ie], rest[iw], machine.symbol[ie]])
        both = [np.concatenate(x) for x in zip(*grown, strict=True)]
        state, number, rest = machine.target[edge], number[which] + machine.skip[edge], rest[which] - 1
        open_ = rest >= 0
        state, number, rest = state[open_], number[open_], rest[open_]
    return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1))


def _copied(machine: Acceptor, both: list[np.ndarray], out: list) -> list[np.ndarray]:
    """One copied symbol behind the edit; what is at its end is accepted."""
    x, y, nx, ny, rest, bar = both
    end = (rest == 0) & machine.final[x] & machine.final[y]
    if end.any():
        out.append((nx[end], ny[end]))
    live = rest > 0
    x, y, nx, ny, rest, bar = (v[live] for v in (x, y, nx, ny, rest, bar))
    which, edge = machine.leaving(x)
    free = machine.symbol[edge] != bar[which]
    which, edge = which[free], edge[free]
    key = y[which] * (1 << 21) + machine.symbol[edge]
    keys = machine.source * (1 << 21) + machine.symbol
    other = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
    there = keys[other] == key if len(keys) else np.zeros(0, bool)
    which, edge, other = which[there], edge[there], other[there]
    a, b, left = machine.target[edge], machine.target[other], rest[which] - 1
    able = (machine.least[a] <= left) & (left <= machine.most[a]) & (machine.least[b] <= left) & (left <= machine.most[b])
    which, edge, other, a, b = which[able], edge[able], other[able], a[able], b[able]
    return [a, b, nx[which] + machine.skip[edge], ny[which] + machine.skip[other], rest[which] - 1, np.full(len(a), -1)]


def pairs_of(keys: list[str], classes: np.ndarray, back: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows whose words are near each other, each pair once; all rows of a key must be there."""
    size = np.array([len(w) for w in words], np.int64)
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    begins = np.cumsum(size) - size
    half = classes // 2
    tail = np.where(back, half + size - classes, size - half)  # symbols behind the initial state
    width = int(tail.max(initial=0))
    place = np.arange(width)[None, :]
    at = np.where(back[:, None], begins[:, None] + tail[:, None] - 1 - place, begins[:, None] + half[:, None] + place)
    rows = np.zeros((len(words), width + 2), np.int64)
    _, rows[:, 0] = np.unique(keys, return_inverse=True)
    rows[:, 0] += 1
    rows[:, 1:-1] = np.where(place < tail[:, None], chars[np.clip(at, 0, max(0, len(chars) - 1))] + 1, 0)
    order = np.lexsort(rows[:, ::-1].T)
    rows = rows[order]
    begin = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
    of = order[begin]
    a, b = composed_pairs(Acceptor(rows), np.where(back[of], half[of], classes[of] - half[of]))
    a, b = order[a], order[b]
    # Read backwards, an insertion right behind the first half is one after a shared prefix too, and counted there.
    width = int(half.max(initial=0))
    place = np.arange(width)[None, :]
    heads = np.where(place < half[:, None], chars[np.clip(begins[:, None] + place, 0, max(0, len(chars) - 1))], 0)
    twice = back[a] & (size[a] != size[b])
    if twice.any():
        k = np.flatnonzero(twice)
        same = np.concatenate([(heads[a[part]] == heads[b[part]]).all(axis=1) for part in np.array_split(k, len(k) // (1 << 20) + 1)])
        keep = np.ones(len(a), bool)
        keep[k[same]] = False
        a, b = a[keep], b[keep]
    return a, b


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, top_n, top): for words (word, n), distinct, how many are near (differ by one code point inserted, deleted
    or replaced) and the near one of the largest n, of those the smallest in code-point order. Words without any are absent.

    Null and empty words have none; an empty table has no rows; other columns are not read.
    """
    rows = initial_states(words.where("length(word) > 0").select("word", "n"))
    dealt = rows.repartition("key").sortWithinPartitions("key")

    def best(rows_: dict[str, list]) -> pa.RecordBatch:
        names, n = rows_["word"], np.array(rows_["n"], np.int64)
        a, b = pairs_of(rows_["key"], np.array(rows_["c"], np.int64), np.array(rows_["back"], bool), names)
        one, two = np.concatenate([a, b]), np.concatenate([b, a])
        rank = np.empty(len(names), np.int64)
        rank[np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)] = np.arange(len(names))
        order = np.lexsort((rank[two], -n[two], one))
        one, two = one[order], two[order]
        head = np.flatnonzero(np.r_[True, one[1:] != one[:-1]]) if len(one) else np.zeros(0, np.int64)
        found = np.diff(np.r_[head, len(one)])
        which, top = one[head], two[head]
        return pa.RecordBatch.from_arrays(
            [pa.array([names[i] for i in which.tolist()], pa.string()), pa.array(found, pa.int64()), pa.array(n[top], pa.int64()), pa.array([names[i] for i in top.tolist()], pa.string())],
            names=["word", "n_near", "top_n", "top"],
        )

    @released
    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in ("key", "c", "back", "word", "n")}
        for batch in batches:
            for c, values in held.items():
                values += batch.column(c).to_pylist()
            keys = held["key"]
            if len(keys) >= WORDS:  # up to the last initial state, which may go on
                cut = keys.index(keys[-1])
                if cut:
                    yield best({c: v[:cut] for c, v in held.items()})
                    for v in held.values():
                        del v[:cut]
        if held["key"]:
            yield best(held)

    found = dealt.select("key", "c", "back", "word", "n").mapInArrow(compose, "word string, n_near long, top_n long, top string")
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("top_n")).alias("m"), F.col("top"))).alias("best"))
    return merged.select("word", "n_near", (-F.col("best.m")).alias("top_n"), F.col("best.top").alias("top"))


def spelling_forms(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for words (word, n), distinct.

    ``form`` is the near word of the largest n (ties: the smallest) if that n is at least twice the word's, ``root`` the last
    form in the chain of forms, the word itself without one. n doubles along a chain, so it has no circle, and each of the
    few rounds of joins doubles what is followed.
    """
    spark = words.sparkSession
    scratch = Scratch(spark)
    words = scratch.stored(words.select("word", "n"), "words")
    formed = words.join(near_words(words), "word", "left").withColumn("has", F.coalesce(F.col("top_n") >= 2 * F.col("n"), F.lit(False)))
    formed = formed.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("has"), F.col("top")).alias("form"), F.when(F.col("has"), F.col("top_n")).alias("form_n"))
    formed = scratch.stored(formed, "forms")
    scratch.drop(words)
    chain = formed.where("form is not null").select("word", F.col("form").alias("to"))
    before = None
    while True:  # a word with a form points to its form; then to what that points to, until all point to roots
        onward = chain.select(F.col("word").alias("to"), F.col("to").alias("next"))
        further = scratch.stored(chain.join(onward, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "roots")
        if before is not None:
            scratch.drop(before)
        before, chain = further, further.select("word", "to")
        if further.where("moved").isEmpty():
            break
    return formed.join(chain, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("to", "word").alias("root"))


def canonical(docs: DataFrame, forms: DataFrame, text_col: str = "text") -> DataFrame:
    """(the columns of docs, ``_word``, ``_root``): one row per distinct word of a text, with the root of its group.

    Words that the vocabulary lacks are their own roots; null texts have no rows, repeated rows have their own; names that
    docs has already get more underscores.
    """
    word, root = unused(docs.columns, "word", "root")
    lowered = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = docs.withColumn(word, F.explode(F.array_distinct(F.regexp_extract_all(lowered, F.lit("([a-zÀ-ÿ]+)"), 1))))
    known = forms.where("form is not null").select(F.col("word").alias(word), F.col("root").alias(root))
    return split.join(known, word, "left").withColumn(root, F.coalesce(root, word)).select(*docs.columns, word, root)
