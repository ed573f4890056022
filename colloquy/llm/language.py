"""Language identification by a byte convolutional network.

Byte embeddings, filters of several widths over windows of a fixed length, max pooling over each window and a softmax,
trained in numpy on a bounded sample of labelled texts. Every window of every text is scored; a document's
probabilities are the letter-weighted means over its windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .shared import released, unused, with_fields

#: Documents that training may use, over all languages, and windows of each.
SAMPLE_DOCS, SAMPLE_WINDOWS = 2400, 4  # arguments of fit()
WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 12, 4
EPOCHS, RATE, SEED = 8, 0.01, 7
UNDETERMINED = "und"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LETTER = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])


@dataclass
class ByteNet:
    langs: list[str]
    embed: np.ndarray  # [256, EMBED]
    filters: np.ndarray  # [max width * EMBED, filters], zero below narrower filters
    bias: np.ndarray
    dense: np.ndarray  # [filters, languages]
    dense_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pooled features of byte windows [n, length], the place of each maximum and the unfolded input."""
        span = max(WIDTHS)
        n, length = windows.shape
        padded = np.zeros((n, length + span - 1), np.uint8)
        padded[:, :length] = windows
        data = np.ascontiguousarray(self.embed[padded])
        unfolded = np.lib.stride_tricks.sliding_window_view(data.reshape(n, -1), span * EMBED, axis=1)[:, ::EMBED]
        unfolded = np.ascontiguousarray(unfolded).reshape(n * length, -1)
        out = (unfolded @ self.filters).reshape(n, length, -1)
        return out, unfolded, data

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        best = self.pooled(windows)[0].max(axis=1)
        return softmax(np.maximum(best + self.bias, 0) @ self.dense + self.dense_bias)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(text: bytes) -> np.ndarray:
    """The folded bytes in rows of WINDOW, the last one filled with zeros."""
    data = np.frombuffer(text.translate(_FOLD), np.uint8)
    rows = -(-len(data) // WINDOW)
    out = np.zeros(rows * WINDOW, np.uint8)
    out[: len(data)] = data
    return out.reshape(rows, WINDOW)


def train(windows: np.ndarray, labels: list[str], epochs: int = EPOCHS, seed: int = SEED) -> ByteNet:
    """Adam on cross entropy with languages weighted alike. The same rows in the same order give the same network."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels], np.int64)
    span, total = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.concatenate([np.repeat(np.arange(span) < w, EMBED)[:, None] * np.ones((1, FILTERS)) for w in WIDTHS], axis=1).astype(np.float32)
    net = ByteNet(
        langs, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), (rng.normal(0, 0.3, (span * EMBED, total)) * mask).astype(np.float32),
        np.zeros(total, np.float32), rng.normal(0, 0.1, (total, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32),
    )
    if not len(y):
        return net
    net.embed[0] = 0
    weight = (1.0 / np.maximum(np.bincount(y, minlength=len(langs)), 1))[y].astype(np.float32)
    weight *= len(y) / weight.sum()
    values = [net.embed, net.filters, net.bias, net.dense, net.dense_bias]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            x, w = windows[rows], weight[rows, None]
            out, unfolded, _ = net.pooled(x)
            n, length, _ = out.shape
            at = out.argmax(axis=1)
            best = np.take_along_axis(out, at[:, None], axis=1)[:, 0] + net.bias
            hidden = np.maximum(best, 0)
            delta = softmax(hidden @ net.dense + net.dense_bias)
            delta[np.arange(n), y[rows]] -= 1
            delta *= w / n
            back = (delta @ net.dense.T) * (best > 0)
            places = (at + np.arange(n)[:, None] * length).ravel()
            inputs = unfolded[places].reshape(n, total, -1)
            g_filters = np.einsum("nf,nfk->kf", back, inputs) * mask
            g_inputs = (back[:, :, None] * net.filters.T[None]).reshape(n, total, span, EMBED)
            padded = np.pad(x, ((0, 0), (0, span - 1)))
            touched = padded[np.arange(n)[:, None, None], at[:, :, None] + np.arange(span)]
            g_embed = np.zeros_like(net.embed)
            np.add.at(g_embed, touched.ravel(), g_inputs.reshape(-1, EMBED))
            g_embed[0] = 0
            step += 1
            for v, g, m, s in zip(values, [g_embed, g_filters, back.sum(0), hidden.T @ delta, delta.sum(0)], first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def has_letter(text: bytes) -> bool:
    """An ASCII letter, or a letter among the other characters."""
    if any(text.translate(_FOLD).find(c) >= 0 for c in (b"e", b"a", b"i", b"n")):
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict(net: ByteNet, texts: list[bytes | None], block: int = 256) -> list[tuple[str, float]]:
    """(language, mean probability) of each whole text."""
    usable = [i for i, t in enumerate(texts) if t and net.langs and has_letter(t)]
    sums = np.zeros((len(texts), max(1, len(net.langs))))
    held: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    room = 0

    def flush():
        nonlocal held, owner, room
        if held:
            rows, who = np.concatenate(held), np.concatenate(owner)
            for at in range(0, len(rows), block):
                part = rows[at : at + block]
                letters = _LETTER[part].sum(axis=1) + 1e-3
                np.add.at(sums, who[at : at + block], net.probabilities(part) * letters[:, None])
        held, owner, room = [], [], 0

    for i in usable:
        rows = windows_of(texts[i])
        held.append(rows)
        owner.append(np.full(len(rows), i))
        room += len(rows)
        if room >= 4 * block:
            flush()
    flush()
    out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
    for i in usable:
        p = sums[i] / sums[i].sum()
        out[i] = (net.langs[int(p.argmax())], float(min(1.0, p.max())))
    return out


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> ByteNet:
    """A network from at most sample_docs rows of docs, as many of each language, those with the smallest id hashes.

    Of each text it learns from at most sample_windows windows, spread evenly over the whole text. Rows without an id, a
    text or a language are not learned from; no such row gives a network that determines nothing.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    langs = rows.agg(F.count_distinct(lang_col)).first()[0]
    each = max(1, sample_docs // max(1, langs))
    order = Window.partitionBy("lang").orderBy("h", "id")
    narrow = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"))
    ids = narrow.withColumn("r", F.row_number().over(order)).where(F.col("r") <= each).select("id").distinct()
    chosen = rows.join(F.broadcast(ids), rows[id_col] == ids["id"], "left_semi").select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, lang, text in zip(*(batch.column(c).to_pylist() for c in ("id", "lang", "text")), strict=True):
                rows = windows_of(text.encode())
                rows = rows[(rows > 0).sum(axis=1) >= 24] if len(rows) > 1 else rows
                # Shorter windows too, so that short texts are like something seen.
                picked = np.unique(np.linspace(0, max(0, len(rows) - 1), sample_windows).astype(int)) if len(rows) else []
                out += [(str(i), lang, rows[k].tobytes()) for k in picked]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.string(), pa.string(), pa.binary()))], names=["id", "lang", "bytes"])

    sample = sorted((r["id"], r["lang"], bytes(r["bytes"])) for r in chosen.mapInArrow(cut, "id string, lang string, bytes binary").collect())
    windows = np.frombuffer(b"".join(x[2] for x in sample), np.uint8).reshape(-1, WINDOW)
    short = windows[::4].copy()
    short[:, 40:] = 0
    return train(np.concatenate([windows, short]), [x[1] for x in sample] + [x[1] for x in sample[::4]])


def identify(docs: DataFrame, net: ByteNet, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with ``lang_pred`` (a learned language; und for null texts and those without a letter) and ``score`` (0 to 1).

    Only the text is looked at. Repeated rows are scored each by itself; columns of docs
    with the two names are replaced.
    """
    docs = docs.select([c for c in docs.columns if c not in names])
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @released
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                found = predict(shared.value, part.column(text_col).cast(pa.large_binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*part.schema.names, *names])

    return docs.mapInArrow(score, with_fields(docs.schema, **{names[0]: StringType(), names[1]: DoubleType()}))


def keep_identified(docs: DataFrame, net: ByteNet, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """Documents whose language is determined with at least this mean probability, with their own columns, whatever their names.

    Texts that are null or have no letter go. Repeated rows and rows with a null id are judged each by itself.
    """
    pred, score = unused(docs.columns, "lang_pred", "score")
    return identify(docs, net, text_col, (pred, score)).where((F.col(pred) != UNDETERMINED) & (F.col(score) >= least)).select(docs.columns)
