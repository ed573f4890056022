"""Toxicity by weak supervision.

Many lexicon and pattern voters vote toxic, clean or nothing on a bounded sample of training rows. A generative model
(class balance and a vote table per voter, by expectation maximisation) estimates their accuracies without trusting any;
voters that still agree too often within a class are correlated and share their weight. A linear classifier is trained
on the posterior labels, and scores every whole text by the words and votes it holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .shared import with_fields

#: Training rows that the label model and the classifier may use.
SAMPLE_DOCS = 12_000
#: Words and stems that the classifier may weigh, and those that mined voters hold.
WORDS, MINED, MINED_VOTERS = 600, 96, 6
#: Lengths, in characters, of the word beginnings that count beside whole words: stems that take many endings.
STEMS = range(3, 9)

#: Lexicons by theme.
LEXICONS = {
    "insult": "idiot idiots moron morons imbecile imbeciles fool fools dumb stupid dimwit halfwit cretin dunce",
    "worth": "worthless pathetic loser losers useless failure nobody pitiful",
    "filth": "trash garbage scum filth filthy vermin dirt parasite parasites",
    "ridicule": "clown clowns joke laughable ridiculous buffoon freak freaks",
    "disgust": "disgusting revolting repulsive nasty sickening",
    "hate": "hate hated despise loathe detest",
    "threat": "kill hurt destroy hang shoot strangle",
    "profane": "damn crap shit fuck fucking bitch bastard asshole",
    "german": "idioten trottel dummkopf abschaum arschloch scheisse scheiße dumm wertlos ekelhaft widerlich versager müll",
    "french": "idiote imbécile abruti connard merde ordure déchet pathétique dégoûtant inutile",
    "spanish": "idiota imbécil estúpido estúpida basura inútil patético escoria payaso mierda perdedor",
}
_LEXICON = {w.encode(): k for k, words in enumerate(LEXICONS.values()) for w in words.split()}
_SHOUT = re.compile(rb"!{3,}")
_YOU_ARE = re.compile(rb"\b(?:you|they)(?:'re| are) (?:a |an |all |such )?([a-z]+)")
#: A-Z lowered; other ASCII than letters to spaces; bytes of 0x80 and more belong to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))

TOXIC, CLEAN = 1, 2
#: Voters that correlate so much before any class is known count as copies of one.
COPIES = 0.9


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def terms_of(words: list[bytes]) -> set[str]:
    """The distinct words and, marked with ``*``, the beginnings of longer words."""
    found = {w.decode("utf-8", "replace") for w in set(words) if len(w) <= 64}
    return found | {f"{w[:k]}*" for w in found for k in STEMS if len(w) > k}


@dataclass
class Voters:
    """The lexicon and pattern voters; ``mined`` maps terms to the mined voters that hold them."""

    mined: dict[str, int] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [*LEXICONS, *(f"mined {k}" for k in range(MINED_VOTERS)), "two hits", "dense hits", "addressed", "shouting", "no lexicon", "no mined", "long and clean"]

    def votes(self, text: bytes | None, words: list[bytes], terms: set[str]) -> np.ndarray:
        """0 nothing, TOXIC or CLEAN for each voter."""
        hits = [_LEXICON[w] for w in words if w in _LEXICON]
        mined = [self.mined[w] for w in self.mined.keys() & terms]
        out = np.zeros(len(self.names), np.int8)
        out[hits] = TOXIC
        base = len(LEXICONS)
        out[[base + k for k in mined]] = TOXIC
        base += MINED_VOTERS
        out[base] = TOXIC if len(hits) >= 2 else 0
        out[base + 1] = TOXIC if hits and len(hits) * 100 >= len(words) else 0
        raw = text or b""
        out[base + 2] = TOXIC if any(m[1] in _LEXICON for m in _YOU_ARE.finditer(raw.lower())) else 0
        out[base + 3] = TOXIC if _SHOUT.search(raw) else 0
        out[base + 4] = 0 if hits else CLEAN
        out[base + 5] = 0 if mined else CLEAN
        out[base + 6] = CLEAN if len(words) >= 50 and not hits and not mined else 0
        return out


def label_model(votes: np.ndarray, prior: float, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of toxic per row, tables [voter, vote, class], weights of the voters).

    Votes are conditionally independent given the class, each voter with its own table. Near copies share one vote from
    the start, or they would make up a class of their own; then correlations within the classes
    are estimated from the residuals, a voter's log likelihood is divided by 1 + its squared correlations with the
    others, and the model is fitted again.
    """
    n, m = votes.shape
    onehot = (votes[:, :, None] == np.arange(3)).astype(np.float64)
    weights = _shares(_correlations((votes == TOXIC).astype(np.float64)), COPIES)
    posterior = np.zeros(n)
    tables = np.full((m, 3, 2), 1 / 3)
    for turn in range(2):
        if turn == 0:  # begin as if each toxic vote were right more often than not
            posterior = np.clip(prior + 0.25 * ((votes == TOXIC).sum(1) - 0.5 * (votes == CLEAN).sum(1)), 0.02, 0.98)
        balance = prior
        for _ in range(rounds):
            both = np.stack([1 - posterior, posterior], 1)
            tables = np.einsum("nmv,nc->mvc", onehot, both) + 0.5
            tables /= tables.sum(axis=1, keepdims=True)
            balance = np.clip(posterior.mean(), 0.001, 0.999)
            ratio = (np.log(tables[:, :, 1]) - np.log(tables[:, :, 0])) * weights[:, None]
            logit = np.log(balance / (1 - balance)) + np.einsum("nmv,mv->n", onehot, ratio)
            new = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
            done = np.abs(new - posterior).max() < 1e-6
            posterior = new
            if done:
                break
        both = np.stack([1 - posterior, posterior], 1)
        active = (votes == TOXIC).astype(np.float64)
        weights = _shares(_correlations(active - both @ tables[:, TOXIC, :].T, centred=True))
    return posterior, tables, weights


def _correlations(x: np.ndarray, centred: bool = False) -> np.ndarray:
    rest = x if centred else x - x.mean(0, keepdims=True)
    sd = np.sqrt((rest**2).mean(0)) + 1e-9
    rho = (rest.T @ rest) / max(1, len(x)) / np.outer(sd, sd)
    np.fill_diagonal(rho, 0)
    return rho


def _shares(rho: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Weights that give correlated voters one vote together: 1 by 1 + the squared correlations above least."""
    return 1 / (1 + np.where(np.abs(rho) >= least, rho**2, 0).sum(1))


@dataclass
class Model:
    voters: Voters
    words: dict[str, int]
    weights: np.ndarray
    bias: float
    label_weights: np.ndarray | None = None

    def features(self, text: bytes | None) -> np.ndarray:
        """Numbers of the features that a text has: votes first, then words."""
        return self.observe(text)[1]

    def observe(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """The votes and the features."""
        words = words_of(text)
        terms = terms_of(words)
        votes = self.voters.votes(text, words, terms)
        at = np.flatnonzero(votes)
        found = sorted(self.words[w] for w in self.words.keys() & terms)
        return votes, np.concatenate([2 * at + votes[at] - 1, np.array(found, np.int64) + 2 * len(votes)]).astype(np.int64)

    def score(self, text: bytes | None) -> float:
        z = self.bias + self.weights[self.features(text)].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 2.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Newton's method for a ridge-penalised linear classifier on soft labels."""
    n, d = x.shape
    a = np.concatenate([x, np.ones((n, 1))], axis=1)
    w = np.zeros(d + 1)
    penalty = np.full(d + 1, ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        gradient = a.T @ (p - y) + penalty * w
        hessian = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """At most so many rows: those of the smallest id hashes (ids alone are sorted), an id with all its rows or none."""
    ids = rows.groupBy("id").agg(F.count("*").alias("n")).orderBy(F.xxhash64("id"), "id").limit(most)
    room = F.sum("n").over(Window.orderBy("n", F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0)) <= most  # of at most so many ids
    return rows.join(F.broadcast(ids.withColumn("room", room).where("room").select("id")), "id", "left_semi")


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from rows (id, text, toxic): at most sample_docs of them. Rows without an id and labels other than 0 and 1 are
    left out; no rows, or rows of one class, give a model too."""
    rows = _sample(labelled.where("toxic in (0, 1) and id is not null"), sample_docs).persist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array(list(held), pa.string()), *(pa.array([x[k] for x in held.values()], pa.int64()) for k in (1, 0))]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["term", "bad", "good"])

        for batch in batches:
            for text, toxic in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for term in terms_of(words_of(text)):
                    held.setdefault(term, [0, 0])[toxic] += 1
                if len(held) > 500_000:
                    yield batch_of()
        yield batch_of()

    counted = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(count, "term string, bad long, good long").groupBy("term")
    counted = counted.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    n_bad, n_good = int(size["bad"]), int(size["n"] - size["bad"])
    bad_rate, good_rate = (F.col("bad") + 0.5) / (n_bad + 1), (F.col("good") + 0.5) / (n_good + 1)
    z = (bad_rate - good_rate) / F.sqrt((F.col("bad") + F.col("good") + 1) / (n_bad + n_good + 2) * (1 / (n_bad + 1) + 1 / (n_good + 1)))
    ranked = counted.where("bad + good >= 3").withColumns({"z": z, "odds": F.log(bad_rate / good_rate)})
    telling = [r for r in ranked.orderBy(F.desc(F.abs("z")), "term").limit(WORDS).collect()]
    mined = [r["term"] for r in telling if r["odds"] > 2 and r["z"] > 3][:MINED]
    voters = Voters({w: k % MINED_VOTERS for k, w in enumerate(mined)})
    model = Model(voters, {t: k for k, t in enumerate(sorted(r["term"] for r in telling))}, np.zeros(0), 0.0)

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [model.observe(t) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.string()), batch.column("toxic").cast(pa.int32()), pa.array([v.tobytes() for v, _ in seen], pa.binary()), pa.array([f.tolist() for _, f in seen], pa.list_(pa.int64()))],
                names=["id", "toxic", "votes", "features"],
            )

    seen = sorted((r["id"], r["toxic"], bytes(r["votes"]), r["features"]) for r in rows.select("id", "toxic", "text").mapInArrow(observe, "id string, toxic int, votes binary, features array<long>").collect())
    rows.unpersist()
    n_features = 2 * len(voters.names) + len(model.words)
    if not seen or not n_bad or not n_good:
        model.weights = np.zeros(n_features)
        model.weights[np.arange(0, 2 * len(LEXICONS), 2)] = 4.0  # no labels of both kinds: each lexicon hit counts
        model.bias = -3.0
        return model
    # The given label is a voter too: right almost always, but not believed blindly.
    gold = np.array([TOXIC if r[1] else CLEAN for r in seen], np.int8)
    votes = np.concatenate([np.frombuffer(b"".join(r[2] for r in seen), np.int8).reshape(len(seen), -1), gold[:, None]], axis=1)
    posterior, _, model.label_weights = label_model(votes, max(0.01, min(0.99, n_bad / len(seen))))
    x = np.zeros((len(seen), n_features))
    for i, r in enumerate(seen):
        x[i, r[3]] = 1
    model.weights, model.bias = logistic(x, posterior)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with ``score`` (0 to 1) of each whole text; null and empty texts get that of a text without words.

    Only the text is looked at; repeated rows score alike; a column of that name is replaced.
    """
    docs = docs.drop("score") if "score" in docs.columns else docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([shared.value.score(t) for t in texts], pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(each, with_fields(docs.schema, score=DoubleType()))
