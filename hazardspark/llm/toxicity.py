"""Toxicity: a convolutional text classifier.

A word's embedding is the sum of hashed embeddings of the word and of its first
3, 4 and 5 bytes, so new forms of a known stem are recognised. Filters of
several widths run over the words of a document; the maximum of each filter
feeds a logistic layer. Everything is trained here in numpy (Adagrad, with
gradients through the maxima only). Scores are calibrated on a fifth of the
sample that the weights have not seen; so are thresholds for each language,
which decide ``flagged`` but enter no score.

The model is fitted on a sample of at most ``SAMPLE`` labelled documents
(``training``); whole texts are learned from and scored.

Results for odd rows: null or empty texts get the score of a document without
words; a null doc_id is scored and counts as held out; an unknown or null
language has the common threshold; repeated rows get the same score; other
columns are ignored; without labels of both classes every score is their mean
(0 if there are none); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import _BYTE, _LOWER, _U, Chunk, chunks, prefix_sums, span_hash, words
from .quality import Constant
from .training import SAMPLE, held_out, platt, sample, scored, sigmoid

BITS = 18
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 6
PREFIXES = (3, 4, 5)
THRESHOLD = 0.5
_EDGE = np.zeros(256, bool)  # stripped from the ends of words
_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def word_rows(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table rows (distinct words x 4), for each word of the chunk its distinct word, and the documents' first words."""
    w = words(chunk)
    data = np.append(_LOWER[chunk.data], np.uint8(0))
    start, end = w.start.copy(), w.end.copy()
    for _ in range(3):
        end -= (end - start > 1) & _EDGE[data[end - 1]]
        start += (end - start > 1) & _EDGE[data[start]]
    sums = prefix_sums(_BYTE[data])
    whole = span_hash(sums, start, end)
    _, pick, which = np.unique(whole, return_index=True, return_inverse=True)
    start, end = start[pick], end[pick]
    grams = [whole[pick]] + [span_hash(sums, start, np.minimum(start + k, end)) + _U(k) for k in PREFIXES]
    grams = [(g * _U(0x9E3779B97F4A7C15)) >> _U(64 - BITS) for g in grams]
    return np.stack(grams, axis=1).astype(np.int64), which, w.first


class Model:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.table = np.zeros((1 << BITS, DIM), np.float32)
        self.filters = [rng.normal(0, 0.5, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.shift = np.full(len(WIDTHS) * FILTERS, 0.1, np.float32)
        self.out = np.full(len(WIDTHS) * FILTERS, 0.3, np.float32)
        self.bias = np.float32(-1.0)
        self.a, self.b = 1.0, 0.0

    def pooled(self, rows, which, first) -> tuple[np.ndarray, np.ndarray]:
        """Per document and filter: the largest response and the word it starts at (-1: none)."""
        n = len(first) - 1
        embedded = self.table[rows].sum(axis=1)
        best = np.zeros((n, len(self.shift)), np.float32)
        at = np.full(best.shape, -1)
        size = np.diff(first)
        for k, (width, f) in enumerate(zip(WIDTHS, self.filters)):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            have = np.flatnonzero(size >= width)
            if not len(have):
                continue
            each = [embedded @ f[j] for j in range(width)]
            m = len(which) - width + 1
            response = each[0][which[:m]]
            for j in range(1, width):
                response = response + each[j][which[j : j + m]]
            # documents end before windows that reach into the next one; these are left out by their bounds
            bounds = np.stack([first[:-1][have], first[1:][have] - width + 1], axis=1).ravel()
            top = np.maximum.reduceat(np.vstack([response, np.full((1, FILTERS), -1e9, np.float32)]), bounds)[::2]
            best[have, cols] = top
            self.responses = response
            at[have, cols] = self._where(response, bounds, top)
        return best, at

    @staticmethod
    def _where(response, bounds, top):
        """Not needed for scoring; training sets it to a search for the maxima."""
        return -1

    def margin_of(self, best: np.ndarray) -> np.ndarray:
        return np.maximum(best + self.shift, 0) @ self.out + self.bias

    def margin(self, chunk: Chunk) -> np.ndarray:
        return self.margin_of(self.pooled(*word_rows(chunk))[0]).astype(np.float64)

    def __call__(self, chunk: Chunk) -> np.ndarray:
        return sigmoid(self.a * self.margin(chunk) + self.b)


def _maxima(response, bounds, top):
    out = np.empty(top.shape, np.int64)
    for i, (lo, hi) in enumerate(bounds.reshape(-1, 2)):
        out[i] = lo + response[lo:hi].argmax(axis=0)
    return out


def gradients(model: Model, rows, which, first, y, weight) -> tuple[list[np.ndarray], float, np.ndarray, np.ndarray]:
    """Of the weighted log loss: by filters, shift and out; by bias; and the rows of the table it touches with theirs."""
    best, at = model.pooled(rows, which, first)
    live = np.maximum(best + model.shift, 0)
    err = ((sigmoid(live @ model.out + model.bias) - y) * weight).astype(np.float32)
    grads: list = [None] * len(model.filters) + [None, live.T @ err]
    back = err[:, None] * model.out * (live > 0)
    grads[-2] = back.sum(axis=0)
    embedded = model.table[rows].sum(axis=1)
    moved = np.zeros_like(embedded)
    for k, (width, f) in enumerate(zip(WIDTHS, model.filters)):
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        d, c = np.nonzero((back[:, cols] != 0) & (at[:, cols] >= 0))
        grad = np.zeros_like(f)
        for j in range(width):
            w = which[at[d, k * FILTERS + c] + j]
            pull = back[d, k * FILTERS + c][:, None]
            np.add.at(grad[j].T, c, pull * embedded[w])
            np.add.at(moved, w, pull * f[j].T[c])
        grads[k] = grad
    used = np.flatnonzero(np.abs(moved).sum(axis=1))
    flat, pull = rows[used].ravel(), np.repeat(moved[used], rows.shape[1], axis=0)
    spot, inverse = np.unique(flat, return_inverse=True)
    total = np.zeros((len(spot), DIM), np.float32)
    np.add.at(total, inverse, pull)
    return grads, float(err.sum()), spot, total


def train(parts: list, labels: list[np.ndarray], rounds: int = 8, rate: float = 0.3, seed: int = 5) -> Model:
    """parts: what ``word_rows`` returns, for small groups of documents; Adagrad over the groups."""
    model, rng = Model(), np.random.default_rng(seed)
    share = float(np.mean(np.concatenate(labels)))
    seen_table = np.full(1 << BITS, 1e-4, np.float32)
    seen = [np.full(p.shape, 1e-2, np.float32) for p in (*model.filters, model.shift, model.out)]
    seen_bias = 1e-2
    model._where = _maxima
    for _ in range(rounds):
        for g in rng.permutation(len(parts)):
            (rows, which, first), y = parts[g], labels[g]
            weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
            grads, step, spot, total = gradients(model, rows, which, first, y, weight)
            seen_table[spot] += (total * total).sum(axis=1)
            model.table[spot] -= rate * total / np.sqrt(seen_table[spot])[:, None]
            for p_, s, g_ in zip((*model.filters, model.shift, model.out), seen, grads):
                s += g_ * g_
                p_ -= 0.3 * rate * g_ / np.sqrt(s)
            seen_bias += step * step
            model.bias = np.float32(model.bias - 0.3 * rate * step / np.sqrt(seen_bias))
    del model._where
    return model


def thresholds(score: np.ndarray, label: np.ndarray, lang: np.ndarray, least: int = 30) -> dict[str, float]:
    """The threshold of best F1 of each language that has at least ``least`` rows of both classes to tell."""
    out = {}
    for name in np.unique(lang):
        own = lang == name
        if own.sum() < least or not 0 < label[own].sum() < own.sum():
            continue
        s, y = score[own], label[own]
        tries = np.linspace(0.2, 0.8, 25)
        f1 = [2 * np.sum((s >= t) & (y == 1)) / max(1, np.sum(s >= t) + np.sum(y == 1)) for t in tries]
        best = np.flatnonzero(f1 >= np.max(f1) - 1e-12)
        out[str(name)] = float(tries[best[np.argmin(np.abs(tries[best] - THRESHOLD))]])
    return out


def fit(learn, seed: int = 13) -> tuple[Model | Constant, dict[str, float]]:
    """A model and thresholds by language from a sample (doc_id, text, label, lang)."""
    label = learn.column("label").to_numpy()
    if len(np.unique(label)) < 2:
        return Constant(float(label.mean()) if len(label) else 0.0), {}
    order = np.random.default_rng(seed).permutation(len(label))
    tune = np.zeros(len(label), bool)
    for y in (0, 1):
        own = order[label[order] == y]
        tune[own[: len(own) // 5]] = True
    learned = order[~tune[order]]
    part = learn.take(learned)
    parts, ys, at = [], [], 0
    for chunk in chunks(part.select(["doc_id", "text"]).combine_chunks(), size=64 << 10):
        parts.append(word_rows(chunk))
        ys.append(label[learned[at : at + len(chunk.doc)]].astype(np.float32))
        at += len(chunk.doc)
    model = train(parts, ys)
    calm = np.flatnonzero(tune) if len(np.unique(label[tune])) == 2 else learned
    margin = np.concatenate([model.margin(c) for c in chunks(learn.take(calm).select(["doc_id", "text"]).combine_chunks())])
    model.a, model.b = platt(margin, label[calm])
    lang = np.array([str(x) for x in learn.column("lang").to_pylist()])
    return model, thresholds(sigmoid(model.a * margin + model.b), label[calm], lang[calm])


def toxicity_scores(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5), threshold and flagged (score >= the language's threshold).

    docs: doc_id, text, lang; labels: doc_id, toxic (0 or 1).
    """
    docs = docs.withColumn("lang", F.col("lang").cast("string")) if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    model, limits = fit(sample(docs, labels, "toxic", bound, ("lang",)))
    out = scored(docs, model, ("lang",))
    limit = F.lit(THRESHOLD)
    for lang, value in sorted(limits.items()):
        limit = F.when(F.col("lang") == lang, value).otherwise(limit)
    out = out.withColumn("threshold", limit)
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged")
    )


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    read = spark.read.parquet
    return toxicity_scores(read(f"{sf_dir}/documents.parquet"), read(f"{sf_dir}/labels.parquet"))
