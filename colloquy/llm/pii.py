"""Personal data: a linear-chain conditional random field over word shapes, beside exact patterns.

A text is a sequence of words between white space. What the field sees of a word is its shape (classes of characters, equal
neighbours as one), how many digits it has, whether punctuation or a line's end follows, and, of words that the training
table repeats, the word itself; it looks at two words before and one after. It is trained on a small labelled table by its likelihood, and decoded by Viterbi in
numpy batches. Most words can't be anything but plain text whatever surrounds them (their score leads by more than
transitions can give); the stretches between those are decoded, which changes no result.

Spans of the field are added where they pass their kind's check and touch no span of the patterns.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .shared import raw, released, slices, with_fields

#: Kinds of the patterns, in the order in which ties are listed, and of the field, whose label 0 is plain text.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "person")
#: Rows that a field is fitted on at most.
TRAIN_ROWS = 2_000

_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(rb"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: bytes) -> bool:
    total = 0
    for k, b in enumerate(reversed(digits)):
        d = b - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: bytes) -> bytes:
    return bytes(b for b in text if 48 <= b <= 57)


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in bytes of every pattern's matches, sorted; each pattern is linear in the text."""
    out = []
    taken, at = 0, text.find(b"@")
    while at >= 0:  # what may stand before an @ holds no @, so each one has its own stretch
        start = at
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            taken = m.end()
        taken, at = max(taken, at + 1), text.find(b"@", at + 1)
    for m in _DOTTED.finditer(text):
        parts = m[0].split(b".")
        begin = m.start()
        for k in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[k : k + 4])) + 3
            if all(len(p.lstrip(b"0")) <= 3 and int(p) <= 255 for p in parts[k : k + 4]):
                out.append((begin, 1, begin + size))
            begin += size + 1
    for m in _CARD.finditer(text):
        digits = _digits(m[0]) if m.end() - m.start() < 64 else b""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


#: One to four capitalised words, a space apart.
_NAME = re.compile(rb"(?:[A-Z]|\xc3[\x80-\x9e])[A-Za-z\x80-\xff'-]+(?: (?:[A-Z]|\xc3[\x80-\x9e])[A-Za-z\x80-\xff'-]+){0,3}")


def _valid(kind: str, text: bytes) -> bool:
    """What a span of the field must be to count."""
    digits = _digits(text)
    if kind == "email":
        return re.fullmatch(rb"[^\s@]+@[^\s@]+\.[^\s@]+", text) is not None
    if kind == "ip":
        return re.fullmatch(rb"[0-9]{1,3}(\.[0-9]{1,3}){3}", text) is not None and all(int(p) <= 255 for p in text.split(b"."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15 and re.fullmatch(rb"[+0-9().\s/-]+", text) is not None
    if kind == "iban":
        flat = re.sub(rb"\s", b"", text).upper()
        return re.fullmatch(rb"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", flat) is not None and int("".join(str(int(chr(b), 36)) for b in flat[4:] + flat[:4])) % 97 == 1
    return _NAME.fullmatch(text) is not None


# ---- words and what the field sees of them

#: Classes of bytes in shapes: upper, lower (and all of 0x80 and more), digit, some punctuation by itself, other.
_CLASS = np.full(256, 3, np.uint64)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 1, 2, 2, 0
for _k, _c in enumerate(b"@.-+()/:_,"):
    _CLASS[_c] = 4 + _k
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_OUTER = np.zeros(256, bool)
_OUTER[list(b".,;:!?\"'")] = True
_QUOTE = np.zeros(256, bool)
_QUOTE[list(b"\"'")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n\r")] = True
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(32)], np.uint64)
#: Numbers of digits from which on a word counts as having "many".
MANY_DIGITS = 24
_COUNTS = (MANY_DIGITS + 1) * 3


@dataclass
class Words:
    """Places of words, and their shapes, digit counts with what follows, and spellings as numbers."""

    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray
    digits: np.ndarray
    spelling: np.ndarray


def words_of(data: np.ndarray) -> Words:
    """The words of bytes, without punctuation around them."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.r_[True, space, True].astype(np.int8)))
    start, end = edge[::2].copy(), edge[1::2].copy()
    whole = end.copy()
    for _ in range(3):
        end -= _OUTER[data[end - 1]] & (end - start > 1)
    stop = np.where(_STOP[data[np.minimum(end, max(0, len(data) - 1))]], 2, np.where(end < whole, 1, 0))  # a sentence's or line's end, other punctuation
    start += _QUOTE[data[start]] & (end - start > 1)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(start, end, none.astype(np.uint64), none, none.astype(np.uint64))
    kind = _CLASS[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[start] = True
    at = np.flatnonzero(new)
    first, last = np.searchsorted(at, start), np.searchsorted(at, end)
    order = np.arange(len(at)) - first[np.clip(np.searchsorted(start, at, side="right") - 1, 0, None)]
    sums = np.r_[np.uint64(0), np.cumsum((kind[at] + np.uint64(1)) * _POWERS[np.clip(order, 0, 31)], dtype=np.uint64)]
    shape = sums[last] - sums[first]
    digits = np.r_[0, np.cumsum(kind == 0)]
    spelling = np.minimum(end - start, 255).astype(np.uint64)
    for k in range(7):  # the length and the first seven bytes
        place = start + k
        spelling = spelling << np.uint64(8) | np.where(place < end, _LOWER[data[np.minimum(place, len(data) - 1)]], 0).astype(np.uint64)
    return Words(start, end, shape, np.minimum(digits[end] - digits[start], MANY_DIGITS) * 3 + stop, spelling)


#: Where the field looks, relative to a word.
AROUND = (-2, -1, 0, 1)


@dataclass
class Field:
    """Weights by place around the word and by shape, digits and spelling; transitions; what shapes and spellings are known."""

    shapes: np.ndarray
    spellings: np.ndarray
    weights: list[list[np.ndarray]]  # by place, then of shape, digits and stop, spelling: [number, label]
    moves: np.ndarray

    def numbers(self, words: Words) -> list[np.ndarray]:
        """Of each word its shape, digits and spelling; 0 for shapes and spellings that are not known."""
        return [_known(self.shapes, words.shape), words.digits, _known(self.spellings, words.spelling)]

    def unsure(self) -> np.ndarray:
        """By label, the most that transitions can give it over plain text, whatever stands before and after."""
        t = self.moves
        other = t[:, :, None] + t[None] - (t[:, 0, None, None] + t[0][None, None, :])  # before, label, after
        return other.max(axis=(0, 2))


def _known(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, values), max(0, len(known) - 1))
    return np.where(known[at] == values, at + 1, 0) if len(known) else np.zeros(len(values), np.int64)


def viterbi(scores: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best labels of sequences that lie one after another in scores [words, labels]; label 0 stands around each."""
    out = np.zeros(len(scores), np.int64)
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
    live = np.searchsorted(-lengths, -np.arange(1, int(lengths.max(initial=0)) + 2), side="right")  # sequences of over t words
    came = np.zeros((len(scores), len(moves)), np.int8)
    last = np.zeros(len(lengths), np.int64)
    best = scores[begins] + moves[0]
    for t in range(len(live) - 1):
        n = live[t]
        if t:
            through = best[:n, :, None] + moves[None]
            at = begins[:n] + t
            came[at] = through.argmax(axis=1)
            best = through.max(axis=1) + scores[at]
        done = live[t + 1]
        last[done:n] = (best[done:n] + moves[:, 0]).argmax(axis=1)
    for t in range(len(live) - 2, -1, -1):
        n = live[t]
        at = begins[:n] + t
        out[at] = last[:n]
        last[:n] = came[at, last[:n]]
    return out


def decode(field: Field, numbers: list[np.ndarray], document: np.ndarray) -> np.ndarray:
    """The labels of all words; sequences are the documents."""
    out = np.zeros(len(document), np.int64)
    if not len(out):
        return out
    own = scores_of(field, numbers, document)
    at = np.flatnonzero(~(own[:, :1] - own[:, 1:] > field.unsure()[1:]).all(axis=1))
    if len(at):
        begins = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (document[at[1:]] != document[at[:-1]])])
        out[at] = viterbi(own[at], field.moves, np.diff(np.r_[begins, len(at)]))
    return out


def scores_of(field: Field, numbers: list[np.ndarray], document: np.ndarray) -> np.ndarray:
    """[words, labels]: what the field gives each label of a word, without transitions."""
    shape, digits, spelling = numbers
    sorts, sort = np.unique((shape * _COUNTS + digits) * (len(field.spellings) + 1) + spelling, return_inverse=True)
    _, first = np.unique(sort, return_index=True)
    out = np.zeros((len(document), len(field.moves)))
    for place, weights in zip(AROUND, field.weights, strict=True):
        table = np.concatenate([sum(w[x[first]] for w, x in zip(weights, numbers, strict=True)), np.zeros((1, len(field.moves)))])
        seen = np.full(len(document), len(sorts))  # nothing, beyond a document's ends
        low, high = max(0, -place), len(document) - max(0, place)
        if low < high:
            same = document[low:high] == document[low + place : high + place]
            seen[low:high] = np.where(same, sort[low + place : high + place], len(sorts))
        out += table[seen]
    return out


# ---- training


def likelihood(scores: np.ndarray, moves: np.ndarray, labels: np.ndarray, lengths: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log likelihood, its gradients by scores and by moves) of padded sequences [n, length, labels]; label 0 is around each."""
    n, longest, many = scores.shape
    inside = np.arange(longest)[None, :] < lengths[:, None]

    def summed(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)

    ahead = np.zeros((longest, n, many))
    ahead[0] = scores[:, 0] + moves[0]
    for t in range(1, longest):
        ahead[t] = np.where(inside[:, t, None], summed(ahead[t - 1][:, :, None] + moves[None], 1) + scores[:, t], ahead[t - 1])
    total = summed(ahead[-1] + moves[:, 0], 1)
    back = np.zeros((longest, n, many))
    back[-1] = moves[:, 0]
    for t in range(longest - 2, -1, -1):
        back[t] = np.where(inside[:, t + 1, None], summed(moves[None] + (scores[:, t + 1] + back[t + 1])[:, None, :], 2), moves[:, 0])
    by_score = np.exp(ahead + back - total[None, :, None]).transpose(1, 0, 2) * inside[:, :, None]
    by_move = np.zeros_like(moves)
    gold, rows = 0.0, np.arange(n)
    grad_move = np.zeros_like(moves)
    for t in range(longest):
        here = inside[:, t]
        before = labels[:, t - 1] if t else np.zeros(n, np.int64)
        np.add.at(grad_move, (before[here], labels[here, t]), 1)
        gold += float((scores[rows, t, labels[:, t]] + moves[before, labels[:, t]])[here].sum())
        if t:
            both = ahead[t - 1][:, :, None] + moves[None] + (scores[:, t] + back[t])[:, None, :] - total[:, None, None]
            by_move += np.exp(both[here]).sum(axis=0)
    by_move[0] += by_score[:, 0].sum(axis=0)
    ends = labels[rows, lengths - 1]
    np.add.at(grad_move, (ends, 0), 1)
    gold += float(moves[ends, 0].sum())
    by_move[:, 0] += by_score[rows, lengths - 1].sum(axis=0)
    grad_score = -by_score
    np.add.at(grad_score, (rows[:, None] * np.ones_like(labels), np.arange(longest)[None, :] * np.ones_like(labels), labels), inside.astype(float))
    return gold - float(total.sum()), grad_score, grad_move - by_move


def fit(table: DataFrame, most_rows: int = TRAIN_ROWS, rounds: int = 60, ridge: float = 0.02) -> Field:
    """A field from rows (text string, spans array<struct<start, end, kind>> in code points): at most so many, those of the
    smallest hashes. Null texts and spans of unknown kinds are left out; no rows give a field that finds nothing."""
    rows = table.where("text is not null").orderBy(F.xxhash64("text"), "text").limit(most_rows).select("text", "spans").collect()
    sequences = []
    for r in rows:
        data = np.frombuffer(r["text"].encode(), np.uint8)
        words = words_of(data)
        place = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        labels = np.zeros(len(words.start), np.int64)
        for s in r["spans"] or []:
            if s["kind"] in KINDS:
                labels[(place[words.start] < s["end"]) & (place[words.end] > s["start"])] = KINDS.index(s["kind"]) + 1
        if len(labels):
            sequences.append((words, labels))
    many = len(KINDS) + 1
    seen = [Counter(np.concatenate([getattr(w, what) for w, _ in sequences]).tolist()) if sequences else Counter() for what in ("shape", "spelling")]
    shapes, spellings = (np.array(sorted(v for v, n in c.items() if n >= least), np.uint64) for c, least in zip(seen, (2, 6), strict=True))
    sizes = [len(shapes) + 1, _COUNTS, len(spellings) + 1]
    field = Field(shapes, spellings, [[np.zeros((s, many)) for s in sizes] for _ in AROUND], np.zeros((many, many)))
    if not sequences:
        field.weights[AROUND.index(0)][1][:, 0] = 10.0
        return field
    lengths = np.array([len(y) for _, y in sequences], np.int64)
    shape = (len(sequences), int(lengths.max()))
    labels = np.zeros(shape, np.int64)
    ends = np.cumsum(sizes * len(AROUND))
    nothing = int(ends[-1])
    features = np.full((*shape, len(ends)), nothing)
    for i, (words, y) in enumerate(sequences):
        labels[i, : len(y)] = y
        numbers = field.numbers(words)
        for p, place in enumerate(AROUND):
            low, high = max(0, -place), min(len(y), len(y) - place)
            for k in range(3):
                features[i, low:high, 3 * p + k] = numbers[k][low + place : high + place] + ends[3 * p + k] - sizes[k]
    weights, moves = np.zeros((nothing + 1, many)), np.zeros((many, many))
    flat = features.reshape(-1)
    steps = [np.full_like(weights, 0.1), np.full_like(moves, 0.1)]
    signs = [np.zeros_like(weights), np.zeros_like(moves)]
    for _ in range(rounds):  # each weight by the sign of its slope, in steps that grow while the sign stays
        _, by_score, by_move = likelihood(weights[features].sum(axis=2), moves, labels, lengths)
        spread = np.repeat(by_score.reshape(-1, many), len(ends), axis=0)
        slope = np.stack([np.bincount(flat, spread[:, k], nothing + 1) for k in range(many)], axis=1)
        slope[nothing] = 0
        for x, g, step, sign in zip((weights, moves), (slope, by_move), steps, signs, strict=True):
            now = np.sign(g - ridge * x)
            step *= np.where(now * sign > 0, 1.2, np.where(now * sign < 0, 0.5, 1.0))
            np.clip(step, 1e-6, 0.5, out=step)
            now[now * sign < 0] = 0
            x += now * step
            sign[:] = now
    field.weights = [[weights[ends[3 * p + k] - sizes[k] : ends[3 * p + k]] for k in range(3)] for p in range(len(AROUND))]
    field.moves = moves
    return field


#: Sentences of the labelled table; what stands in braces is filled by rule, and labelled where it is a kind.
SENTENCES = r"""
my name is {person} and I live here|please call {person} at {phone} today|Mr. {person} wrote to us|Mrs. {person} and Dr. {person} came
Dr. {person} will see you at {time}|contact {person} by mail at {email}|write to {email} or call {phone}|tel {phone}|phone: {phone}|fax {phone} , mail {email}
ich heiße {person} und wohne in {cap}|Herr {person} ruft an|Frau {person} , Telefon {phone}|mein Name ist {person}|Tel. {phone} oder {email}
je m'appelle {person} et je suis là|Madame {person} a dit|Monsieur {person} , {phone}|téléphone {phone}|mon nom est {person}
mi nombre es {person} y vivo aquí|Señor {person} dijo|Señora {person} , teléfono {phone}|llame al {phone} ahora|me llamo {person}
card {card} expires {date}|pay with {card} now|Karte {card} , gültig bis {date}|carte {card}|tarjeta {card}|{words} {card} {words}
server {ip} is down|from {ip} to {ip}|{words} {ip} {words}|host {ip} port {number}|IBAN {iban}|account {iban} of {person}|Konto {iban}|{words} {iban} {words}
{words} {email} {words}|{words} {phone} {words}|{email} {words}.|{phone} {words}|mobile {phone}|cell {phone}|reach me on {phone} or at {email}
{caps} {words}. {caps} {words}.|{caps} {words} {number} {words}.|In {year} {words} {cap} {words} {version} {words}.|{words} {date} {words} {time} {words}
{words} {decimal} {words} {number} {words}|order {digits} of {date} {words}|{words} {digits} {words}|id {hex} {words}|{hex} {words}|{words} {hex}|version {version} {words}
{caps} {words} {cap} {words}, {cap} {words}.|see {url} {words}|{url}|{words} {code} {words}|{code}|{number} {number} {number}|{number}. {caps} {words}|{words} ({number}) {words}
{words} {range} {words}|page {number} of {number}|{year}|{date}|total {decimal} {words}|call the function|my card is here|the phone rang {number} times|name of {words}|call me at {time}
{caps}. {caps}. {caps} {words}.|{words}. {caps}. {caps}, {words}. {caps}|{words}.\n{caps}.\n{caps} {words}.|{caps}. {words}. {caps} {caps}. {caps}|{caps} {caps} {caps} {caps} {words}|{words} {caps} {caps} {caps} {caps}. {words}
{words}. {caps} {words}. {caps}. {caps} {words}|{caps}. {caps}|{words}, {words}. {caps}|{caps}.\n{caps} {words}|{words} {caps} {words}|{words} {caps}. {words}|{caps}, {words}. {words}. {caps}.|{caps}|{caps}.
{words}. {short}. {caps} {words}.|{words}.\n{short}. {caps} {words}, {words}.|{short}. {caps} {words}|{words} {words}. {short}. {caps}. {words}|{short}. {short}. {caps} {words}|{words} {short} {caps} {words}
{words} ist. {caps} {words}|{words} ist {caps}. {words}|{words} is {caps} {words}|la {words} es {caps} {words}|{words} est {caps}. {words}|{words} ist.\n{caps} {words}|{words} is.\n{caps} {words}|ist.\nIst. {caps} {words}
Mr. and Mrs. {words}|{cap} {cap} {words}|{caps} {words} {path} {words}|password={code}|{words} token={hex}|{noise} {noise} {words}|{noise} {number} {noise}|{caps} {noise} {words} {noise}
"""
#: Names that fill the labelled table.
GIVEN = "Anna Peter Maria John Lucía Pierre Ingrid Omar Chloé Hans Elena David Sofia Karl Amélie José Ruth Ivan Nora Luis"
FAMILY = "Smith Müller García Dupont Okafor Jensen Rossi Novak Martin Schmidt López Bernard Khan Weber Moreau Silva Brown Keller Ortiz Lang"


def labelled_rows(copies: int = 8, seed: int = 12) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, (start, end, kind) in code points): each sentence filled so often, by a seed."""
    rng = random.Random(seed)
    pick = lambda words: rng.choice(words.split())
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("th er on an re he in ed nd ha at en ción que sch ung eau tre ß é ü".split()) for _ in range(rng.randrange(1, 5)))

    def card() -> str:
        body = rng.choice("3456") + number(14)
        body += next(d for d in "0123456789" if luhn((body + d).encode()))
        sep = rng.choice(["", " ", "-"])
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    def iban() -> str:
        land, body = rng.choice(["DE", "FR", "ES", "GB"]), number(18)
        check = 98 - int(body + "".join(str(int(c, 36)) for c in land) + "00") % 97
        whole = f"{land}{check:02d}{body}"
        return rng.choice([whole, " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))])

    fill = {
        "person": lambda: f"{pick(GIVEN)} {pick(FAMILY)}" if rng.random() < 0.8 else pick(FAMILY),
        "email": lambda: f"{rng.choice([pick(GIVEN).lower(), word(), f'{word()}.{number(2)}', f'{word()}_{word()}'])}@{rng.choice(['mail', 'post', word()])}{rng.choice(['', '.' + word()])}.{rng.choice(['com', 'org', 'de', 'example'])}",
        "ip": lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4)),
        "card": card,
        "iban": iban,
        "phone": lambda: rng.choice(
            [f"+{number(1)} ({number(3)}) {number(3)}-{number(4)}", f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"+{number(2)} {number(3)} {number(7)}", f"0{number(3)}/{number(7)}", f"+{number(11)}", f"{number(3)}.{number(3)}.{number(4)}"]
        ),
        "words": lambda: " ".join(word() for _ in range(rng.randrange(1, 7))),
        "cap": lambda: word().capitalize(),
        "caps": lambda: (word() if rng.random() < 0.5 else pick("The And Der Er It Of To In Les El La Un Is That")).capitalize(),
        "short": lambda: (pick("Of Is To In Ist On The Zu De La At Ed") if rng.random() < 0.5 else rng.choice("ABDEGIJKLNORTU") + rng.choice("aeioulrnst")),
        "number": lambda: number(rng.randrange(1, 6)),
        "digits": lambda: "9" + number(rng.randrange(5, 22)),
        "year": lambda: str(rng.randrange(1900, 2100)),
        "date": lambda: rng.choice([f"{rng.randrange(1, 29)}.{rng.randrange(1, 13)}.{rng.randrange(1990, 2030)}", f"{rng.randrange(1990, 2030)}-{number(2)}-{number(2)}", f"{number(2)}/{number(2)}"]),
        "time": lambda: f"{rng.randrange(24)}:{rng.randrange(60):02d}",
        "decimal": lambda: f"{number(rng.randrange(1, 4))}.{number(2)}",
        "version": lambda: f"{number(1)}.{number(1)}.{number(1)}",
        "hex": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([8, 32, 40, 64]))),
        "url": lambda: f"https://{word()}.example.com/{word()}/{number(2)}",
        "code": lambda: "".join(rng.choice("ABCDEFGHKLMNPQRSTabcdefghkmnpqrst23456789") for _ in range(rng.randrange(8, 24))),
        "range": lambda: f"{number(2)}-{number(2)}",
        "path": lambda: f"/{word()}/{word()}.{word()}",
        "noise": lambda: word() + rng.choice(["***", "$$$", "%%%", "###", "&&&", ",***"]),
    }
    out = []
    for sentence in (s for line in SENTENCES.strip().split("\n") for s in line.split("|")):
        for _ in range(copies):
            text, spans = "", []
            for part in re.split(r"(\{\w+\})", sentence):
                if part.startswith("{"):
                    value = fill[part[1:-1]]()
                    if part[1:-1] in KINDS:
                        spans.append((len(text), len(text) + len(value), part[1:-1]))
                    text += value
                else:
                    text += part.replace("\\n", "\n")
            out.append((text, spans))
    return out


def labelled_table(spark: SparkSession, copies: int = 8) -> DataFrame:
    return spark.createDataFrame(labelled_rows(copies), "text string, spans array<struct<start int, end int, kind string>>")


# ---- texts

SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("kind", StringType()), StructField("added", LongType())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("added", pa.int64())]))


def spans_of(texts: list[bytes], field: Field) -> list[list[tuple[int, int, str, int]]]:
    """For each text (start, end, kind, 1 if the field added it) in code points, by start, then by the order of KINDS."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    words = words_of(data)
    document = np.searchsorted(begins, words.start, side="right") - 1
    labels = decode(field, field.numbers(words), document)
    telling = np.zeros(len(texts) + 1, bool)
    telling[np.searchsorted(begins, np.flatnonzero(_TELLING[data]), side="right") - 1] = True
    found: dict[int, list[tuple[int, int, int, int]]] = {i: [(a, k, b, 0) for a, k, b in base_spans(texts[i])] for i in np.flatnonzero(telling[:-1]).tolist()}
    at = np.flatnonzero(labels)
    new = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (labels[at[1:]] != labels[at[:-1]]) | (document[at[1:]] != document[at[:-1]])]) if len(at) else at
    for first, last in zip(at[new].tolist(), at[np.r_[new[1:], len(at)] - 1].tolist() if len(at) else [], strict=True):
        i, k = int(document[first]), int(labels[first]) - 1
        a, b = int(words.start[first] - begins[i]), int(words.end[last] - begins[i])
        own = found.setdefault(i, [])
        if all(b <= x[0] or a >= x[2] for x in own if not x[3]) and _valid(KINDS[k], texts[i][a:b]):
            own.append((a, k, b, 1))
    out: list[list[tuple[int, int, str, int]]] = [[] for _ in texts]
    for i, spans in found.items():
        if spans:
            text = np.frombuffer(texts[i], np.uint8)
            place = None if texts[i].isascii() else np.r_[0, np.cumsum((text & 0xC0) != 0x80)]
            out[i] = [(a if place is None else int(place[a]), b if place is None else int(place[b]), KINDS[k], added) for a, k, b, added in sorted(spans)]
    return out


#: Bytes without which a text has no match of a pattern.
_TELLING = np.zeros(256, bool)
_TELLING[list(b"@0123456789")] = True


def find_pii(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """docs with ``pii_spans``: (start, end, kind, added) in code points, by start, then kind; ``added`` is 1 for the field's.

    Null, empty and wordless texts have none; repeated rows are each treated by themselves; a column of that name, in any
    case, is replaced; an empty table gives no rows. Memory follows the longest text of a task.
    """
    kept = docs.select([c for c in docs.columns if c.lower() != "pii_spans"])
    return _scanned(kept, field, text_col, masking=False)


def redact_pii(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """Every document, each personal datum (overlapping ones as one) replaced by ``[kind]`` of its first kind; other texts,
    null ones and all columns stay as they are."""
    return _scanned(docs, field, text_col, masking=True)


def _scanned(docs: DataFrame, field: Field, text_col: str, masking: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @released
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                spans = spans_of([bytes(t) if t is not None else b"" for t in raw(part.column(text_col))], shared.value)
                if not masking:
                    rows = [[{"start": a, "end": b, "kind": k, "added": x} for a, b, k, x in own] for own in spans]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, _SPANS)], names=[*part.schema.names, "pii_spans"])
                    continue
                if any(spans):
                    old, at = part.column(text_col), part.schema.get_field_index(text_col)
                    texts = [masked(t.as_py(), own) if own else t.as_py() for t, own in zip(old, spans, strict=True)]
                    part = part.set_column(at, part.schema.field(at), pa.array(texts, old.type))
                yield part

    return docs.mapInArrow(scan, docs.schema if masking else with_fields(docs.schema, pii_spans=SPANS))


def masked(text: str, spans: list[tuple[int, int, str, int]]) -> str:
    out, at = [], 0
    for a, b, kind, _ in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def spans_text(base_only: bool = False):
    """kind:start:end of all spans, or of the patterns', comma-joined in their order."""
    spans = F.filter("pii_spans", lambda s: s["added"] == 0) if base_only else F.col("pii_spans")
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def n_base(kind: str):
    return F.size(F.filter("pii_spans", lambda s: (s["kind"] == kind) & (s["added"] == 0))).cast("long").alias(f"n_{kind}")
