"""Secret scans: Boolean trigram queries derived from each rule's regex, answered by a trigram inverted index.

The index is sharded as the documents are: each slice of an Arrow batch of a partition, of about SHARD_BYTES of text, is
one shard, indexed in its task, so no posting crosses the network. A shard's index holds the trigrams that some rule asks
for. Rules whose regex has no mandatory trigram are matched against every document.
"""

from __future__ import annotations

import re
import re._parser as sre
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .shared import raw, released, slices, with_fields


@dataclass(frozen=True)
class Rule:
    """kind; regex over whole texts; the group whose length counts and the least length of it."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The base rules, in the order in which ties are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Public formats of well-known credentials, listed after the base rules.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

#: Bytes of text in a shard (a longer text is one of its own), and those whose trigrams are looked up at once: an index's
#: scratch memory is some 20 times the latter, whatever the texts' lengths.
SHARD_BYTES, BLOCK = 1 << 20, 1 << 18

#: Alternatives that a repeated or optional part may be spelled out into before it counts as anything.
MOST_SPELLINGS = 16

# A query is True (anything), a frozenset of trigrams that must all occur, or ("or", queries), ("and", queries).


def trigram_query(pattern: str):
    """The Boolean trigram query that every text with a match of the pattern satisfies, over folded (A-Z lower) text."""
    spelled, query = _derive(list(sre.parse(pattern)))
    return _and([query, _spelled_query(spelled)])


def _spelled_query(spelled: set[str] | None):
    """One of the spellings occurs as it stands."""
    if spelled is None or any(len(s) < 3 for s in spelled):
        return True
    return _or([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(spelled)])


def _and(queries: list):
    parts = [q for q in queries if q is not True]
    if len(parts) < 2:
        return parts[0] if parts else True
    return frozenset().union(*parts) if all(isinstance(q, frozenset) for q in parts) else ("and", tuple(parts))


def _or(queries: list):
    if not queries or any(q is True for q in queries):
        return True
    return queries[0] if len(queries) == 1 else ("or", tuple(queries))


def _derive(nodes: list) -> tuple[set[str] | None, object]:
    """(all spellings of this sequence, or None where there are too many; what must hold besides)."""
    done: list = []
    whole, run = True, {""}
    for op, value in nodes:
        spelled, query = _one(op, value)
        done.append(query)
        joined = None if spelled is None else {a + b for a in run for b in spelled}
        if joined is not None and len(joined) <= MOST_SPELLINGS:
            run = joined
            continue
        done.append(_spelled_query(run))
        whole = False
        run = spelled if spelled is not None and len(spelled) <= MOST_SPELLINGS else {""}
    if whole:
        return run, _and(done)
    done.append(_spelled_query(run))
    return None, _and(done)


def _one(op, value) -> tuple[set[str] | None, object]:
    name = str(op)
    if name == "LITERAL":
        return {chr(value).lower()}, True
    if name == "AT":
        return {""}, True
    if name == "IN":
        chars = set()
        for kind, x in value:
            if str(kind) == "LITERAL":
                chars.add(chr(x).lower())
            elif str(kind) == "RANGE" and x[1] - x[0] < MOST_SPELLINGS:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, True
        return (chars if len(chars) <= MOST_SPELLINGS else None), True
    if name == "SUBPATTERN":
        return _derive(list(value[3]))
    if name == "BRANCH":
        spelled, queries = set(), []
        for branch in value[1]:
            s, q = _derive(list(branch))
            spelled = None if spelled is None or s is None else spelled | s
            queries.append(_and([q, _spelled_query(s)]))
        return (spelled, True) if spelled is not None and len(spelled) <= MOST_SPELLINGS else (None, _or(queries))
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, body = value
        s, q = _derive(list(body))
        if most == 1 and least == 0:
            return (s | {""}, True) if s is not None else (None, True)
        if least == 0:
            return None, True
        if s is not None and least == most and len(s) ** least <= MOST_SPELLINGS:
            out = {""}
            for _ in range(least):
                out = {a + b for a in out for b in s}
            return out, q
        return None, _and([q, _spelled_query(s)])
    return None, True


def trigrams_in(query) -> set[str]:
    if query is True:
        return set()
    return set(query) if isinstance(query, frozenset) else set().union(*map(trigrams_in, query[1]))


class Scanner:
    """The rules with their queries, and the table of trigrams that a shard's index keeps."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.trigrams = sorted(t for t in set().union(*map(trigrams_in, self.queries)) if t.isascii())
        self.table = None

    def postings(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """Trigram -> the sorted numbers of the shard's texts that hold it."""
        if self.table is None:
            self.table = np.zeros(1 << 21, np.uint8)
            for k, t in enumerate(self.trigrams):
                a, b, c = t.encode()
                self.table[a << 14 | b << 7 | c] = k + 1
            self.fold = np.array([b + 32 if 65 <= b <= 90 else b if b < 128 else 0 for b in range(256)], np.uint8)
        data, ends = np.frombuffer(b"\0".join(texts), np.uint8), np.cumsum([len(t) + 1 for t in texts])
        pairs = [np.zeros(0, np.int64)]
        for first in range(0, len(data) - 2, BLOCK):
            part = self.fold[data[first : first + BLOCK + 2]].astype(np.int32)
            codes = self.table[part[:-2] << 14 | part[1:-1] << 7 | part[2:]]
            at = np.flatnonzero(codes)
            docs = np.searchsorted(ends, at + first, side="right")
            pairs.append(np.unique(codes[at].astype(np.int64) << 40 | docs))
        found = np.unique(np.concatenate(pairs))  # a text may lie in several blocks
        which, docs = found >> 40, found & ((1 << 40) - 1)
        return {t: docs[which == k + 1] for k, t in enumerate(self.trigrams)}

    def candidates(self, query, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
        if query is True:
            return np.arange(n)
        if isinstance(query, frozenset):
            lists = sorted((postings[t] for t in query if t in postings), key=len)
            out = lists[0] if lists else np.arange(n)
            for x in lists[1:]:
                out = np.intersect1d(out, x, assume_unique=True)
            return out
        parts = [self.candidates(q, postings, n) for q in query[1]]
        out = parts[0]
        for x in parts[1:]:
            out = np.union1d(out, x) if query[0] == "or" else np.intersect1d(out, x, assume_unique=True)
        return out

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text the (start, end, rule number) in code points, by start and rule number."""
        postings = self.postings(texts)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        text_of: dict[int, str] = {}
        for k, (rule, query) in enumerate(zip(self.rules, self.queries, strict=True)):
            regex = rule.compiled()
            # A full scan first looks for a long enough match in the bytes, and only then counts code points.
            quick = re.compile(rule.pattern[:-1].encode() + b"{%d,}" % rule.least) if query is True and _is_run(rule) else None
            for i in self.candidates(query, postings, len(texts)).tolist():
                if quick and not quick.search(texts[i]):
                    continue
                if i not in text_of:
                    text_of[i] = texts[i].decode("utf-8", "replace")
                for m in regex.finditer(text_of[i]):
                    if len(m[rule.group]) >= rule.least:
                        out[i].append((m.start(), m.end(), k))
        return [sorted(x, key=lambda s: (s[0], s[2])) for x in out]


def _is_run(rule: Rule) -> bool:
    """The pattern is one ASCII character class and '+'."""
    return rule.group == 0 and not rule.any_case and bool(re.fullmatch(r"\[[0-9A-Za-z-]+\]\+", rule.pattern))


SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("kind", StringType())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def find_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with ``secret_spans``: every match as (start, end, kind) in code points, by start, then by the rules' order.

    A null or empty text has none; repeated rows are scanned each by itself; a column of that name is replaced.
    """
    return _scanned(docs.select([c for c in docs.columns if c != "secret_spans"]), text_col, rules, "secret_spans")


def _scanned(docs: DataFrame, text_col: str, rules: tuple[Rule, ...], name: str, masking: bool = False) -> DataFrame:
    """docs with the spans in a column of this name, or, when masking, with masked texts and no spans, in one pass."""
    scanner = Scanner(rules)

    @released
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, SHARD_BYTES):
                texts = [bytes(t) if t is not None else b"" for t in raw(part.column(text_col))]
                spans = [[{"start": a, "end": b, "kind": rules[k].kind} for a, b, k in x] for x in scanner.scan(texts)]
                if not masking:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, _SPANS)], names=[*part.schema.names, name])
                    continue
                if any(spans):  # texts without a secret stay as they are
                    old = part.column(text_col)
                    at = part.schema.get_field_index(text_col)
                    new = [masked(t.as_py(), s) if s else t.as_py() for t, s in zip(old, spans, strict=True)]
                    part = part.set_column(at, part.schema.field(at), pa.array(new, old.type))
                yield part

    return docs.mapInArrow(scan, docs.schema if masking else with_fields(docs.schema, **{name: SPANS}))


def spans_text(kinds: tuple[str, ...] | None = None):
    """kind:start:end of all spans, or of these kinds, comma-joined in their order."""
    spans = F.col("secret_spans") if kinds is None else F.filter("secret_spans", lambda s: s["kind"].isin(*kinds))
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every document, each secret (overlapping ones as one) replaced by ``[secret:<kind>]`` of its first kind.

    Texts are masked where they are scanned. Columns stay as they are, whatever their names; null and empty texts stay;
    repeated rows are masked each by itself.
    """
    return _scanned(docs, text_col, rules, "", masking=True)


def masked(text: str | None, spans) -> str | None:
    if text is None:
        return None
    out, at, hidden = [], 0, 0
    for s in spans:
        if s["start"] >= hidden:
            out += [text[at : s["start"]], f"[secret:{s['kind']}]"]
        at = hidden = max(hidden, s["end"])
    return "".join([*out, text[at:]])
