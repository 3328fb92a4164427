"""Quality classifier: naive Bayes support vectors.

A document is the set of its n-grams: words (1 and 2) and word shapes (1 to 3:
letter case, digits, punctuation, length, repeat of an earlier word), hashed to
``2**BITS`` features. Each indicator is scaled by the log-count ratio of its
feature between the classes, and a linear hinge-loss model is fitted to the
scaled rows by dual coordinate descent. Margins become scores by a logistic
curve fitted on a fifth of the sample that the weights have not seen.

The model is fitted on a sample of at most ``SAMPLE`` labelled documents
(``training``); whole texts are scored where they lie.

Results for odd rows: null or empty texts get the score of a document without
n-grams; a null doc_id is scored and counts as held out; repeated rows get the
same score; other columns are ignored; without labels of both classes every
score is their mean (1 if there are none, so nothing is rejected); an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import _U, Chunk, chunks, mix, word_hashes, words
from .training import SAMPLE, held_out, platt, sample, scored, sigmoid

BITS = 18
THRESHOLD = 0.3
_CLASSES = np.zeros((3, 256), np.int32)  # of bytes: upper-case letters, digits, punctuation
_CLASSES[0, ord("A") : ord("Z") + 1] = 1
_CLASSES[1, ord("0") : ord("9") + 1] = 1
_CLASSES[2, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of every distinct feature of each document, by row."""
    w = words(chunk)
    token = word_hashes(chunk, w)
    row = np.repeat(np.arange(len(chunk.doc)), np.diff(w.first))
    length = w.end - w.start
    counts = [(c := np.append(0, np.cumsum(table[chunk.data])))[w.end] - c[w.start] for table in _CLASSES]
    last = np.minimum(np.searchsorted([2, 3, 5, 9], length, "right"), 4)
    shape = last + 5 * np.minimum(counts[0], 2) + 15 * np.minimum(counts[1], 2) + 45 * np.minimum(counts[2], 3)
    for back in (1, 2):
        same = np.zeros(len(token), bool)
        same[back:] = (token[back:] == token[:-back]) & (row[back:] == row[:-back])
        shape = shape + 180 * back * same
    shape = mix(shape.astype(np.uint64) + _U(1 << 20))
    parts = []
    for kind, (of, n) in enumerate([(token, 1), (token, 2), (shape, 1), (shape, 2), (shape, 3)]):
        if len(of) < n:
            continue
        gram = of[: len(of) - n + 1] + _U(kind)
        for k in range(1, n):
            gram = mix(gram * _U(3)) + of[k : len(of) - n + 1 + k]
        whole = row[: len(gram)] == row[n - 1 :]
        parts.append((row[: len(gram)][whole] << BITS) | (mix(gram[whole]) >> _U(64 - BITS)).astype(np.int64))
    both = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    return both >> BITS, both & ((1 << BITS) - 1)


def log_count_ratios(rows: list[np.ndarray], label: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p, q = np.full(1 << BITS, smooth), np.full(1 << BITS, smooth)
    for feats, y in zip(rows, label):
        (p if y else q)[feats] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(rows: list[np.ndarray], label: np.ndarray, scale: np.ndarray, cost: np.ndarray, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge loss with an L2 penalty; rows of ``scale`` values are brought to unit length."""
    rng = np.random.default_rng(seed)
    weight, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    values = [scale[f] / max(1e-12, np.linalg.norm(scale[f])) for f in rows]
    sign = np.where(label == 1, 1.0, -1.0)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            f, x, y = rows[i], values[i], sign[i]
            slope = y * (weight[f] @ x + bias) - 1
            new = min(max(alpha[i] - slope / 2, 0.0), cost[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                weight[f] += step * y * x
                bias += step * y
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weight, bias


class Model:
    """weight: per feature, already times its ratio; ratio: what rows are normalised by."""

    def __init__(self, weight, ratio, bias, a, b):
        self.weight, self.square = (weight * ratio).astype(np.float32), (ratio * ratio).astype(np.float32)
        self.bias, self.a, self.b = bias, a, b

    def margin(self, chunk: Chunk) -> np.ndarray:
        row, feature = features(chunk)
        n = len(chunk.doc)
        norm = np.sqrt(np.bincount(row, self.square[feature], n))
        return np.bincount(row, self.weight[feature], n) / np.maximum(norm, 1e-12) + self.bias

    def __call__(self, chunk: Chunk) -> np.ndarray:
        return sigmoid(self.a * self.margin(chunk) + self.b)


class Constant:
    def __init__(self, value: float):
        self.value = value

    def __call__(self, chunk: Chunk) -> np.ndarray:
        return np.full(len(chunk.doc), self.value)


def fit(learn, seed: int = 11) -> Model | Constant:
    """A model from a sample (doc_id, text, label)."""
    label = learn.column("label").to_numpy()
    if len(np.unique(label)) < 2:
        return Constant(float(label.mean()) if len(label) else 1.0)
    rows: list[np.ndarray] = []
    for chunk in chunks(learn.select(["doc_id", "text"])):
        row, feature = features(chunk)
        cuts = np.searchsorted(row, np.arange(len(chunk.doc) + 1))
        rows += [feature[a:b].astype(np.int32) for a, b in zip(cuts, cuts[1:])]
    order = np.random.default_rng(seed).permutation(len(rows))
    tune = np.zeros(len(rows), bool)
    for y in (0, 1):  # a fifth of each class calibrates
        own = order[label[order] == y]
        tune[own[: len(own) // 5]] = True
    pick = np.flatnonzero(~tune)
    ratio = log_count_ratios([rows[i] for i in pick], label[pick])
    share = label[pick].mean()
    cost = np.where(label[pick] == 1, 0.5 / share, 0.5 / (1 - share))
    weight, bias = dual_coordinate_descent([rows[i] for i in pick], label[pick], ratio, cost)
    model = Model(weight, ratio, bias, 1.0, 0.0)
    unit = lambda f: weight[f] @ ratio[f] / max(1e-12, np.linalg.norm(ratio[f])) + bias
    calm = np.flatnonzero(tune) if len(np.unique(label[tune])) == 2 else pick
    model.a, model.b = platt(np.array([unit(rows[i]) for i in calm]), label[calm])
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``; labels: doc_id, quality (0 or 1)."""
    model = fit(sample(docs, labels, "quality", bound))
    out = scored(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, scored and filtered where they lie."""
    model = fit(sample(docs, labels, "quality", bound))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            work = pa.RecordBatch.from_arrays([pa.array(np.arange(len(b))), b.column(b.schema.get_field_index("text")).fill_null("")], ["doc_id", "text"])
            good = [model(chunk) >= threshold for chunk in chunks(work)]
            yield b.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    read = spark.read.parquet
    return quality_scores(read(f"{sf_dir}/documents.parquet"), read(f"{sf_dir}/labels.parquet"))
