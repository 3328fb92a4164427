"""What the trained models share: a bounded labelled sample, calibration, scoring."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import Chunk, chunks, numbered

FOLDS = 5
SAMPLE = 8_000
LONGEST = 128 << 10  # bytes of a text to learn from; any text is scored


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text is a multiple of 5 (a null id: held out)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, column: str, bound: int = SAMPLE, extra: tuple[str, ...] = (), longest: int = LONGEST) -> pa.Table:
    """Up to ``bound`` labelled documents to learn from, picked by a hash of doc_id: doc_id, text, label.

    Of these, texts of over ``longest`` bytes are not learned from, so that the
    sample has a size that is bounded in bytes. Only the labels, at most ``bound`` rows, are broadcast; no text is shuffled.
    """
    known = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)
    out = texts.filter(F.octet_length("text") <= longest).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label", *extra).toArrow()
    out = out.combine_chunks().sort_by("doc_id")
    first = np.ones(len(out), bool)  # repeated rows count once
    ids = out.column("doc_id").to_numpy()
    first[1:] = ids[1:] != ids[:-1]
    return out.filter(pa.array(first))


def platt(margin: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * margin + b))), by Newton's method with smoothed targets."""
    pos, neg = float(np.sum(label == 1)), float(np.sum(label == 0))
    goal = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        s = p * (1 - p) + 1e-9
        g = np.array([np.dot(p - goal, margin) + 1e-3 * (a - 1), np.sum(p - goal)])
        h = np.array([[np.dot(s * margin, margin) + 1e-3, np.dot(s, margin)], [np.dot(s, margin), np.sum(s)]])
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def scored(docs: DataFrame, score: Callable[[Chunk], np.ndarray], keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep``, and the score of each whole text."""

    def run(batches):
        for b in batches:
            doc_id, b = numbered(b)
            for chunk in chunks(b):
                rows = pa.array(chunk.doc)
                out = {"doc_id": doc_id.take(rows), **{c: b.column(b.schema.get_field_index(c)).take(rows) for c in keep}, "score": np.asarray(score(chunk), np.float64)}
                yield from pa.table(out).to_batches()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *keep)
    schema = ", ".join(["doc_id long", *[f"{c} string" for c in keep], "score double"])
    return plain.mapInArrow(run, schema)
