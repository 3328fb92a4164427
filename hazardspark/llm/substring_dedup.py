"""Substring dedup by words: compaction of a De Bruijn graph.

Windows of ``width`` words are the edges of the graph, the words that two
successive ones share its nodes. ``runs`` finds the edges that repeat, in runs
that nothing branches off; where runs of one owner differ, their windows are
compared one by one. ``graph`` joins the runs that always follow one another to
whole repeated paths. Every occurrence of a path but the first is a span of
words with a source, the coordinates (doc_id, first word) of the first, and is
removed if its words are those of the source.

Results for odd rows: a null or empty text has no words; a null doc_id has no
place in the order, so its row is kept whole and is no source for others; rows
that repeat a doc_id are taken as one document with one text, and each of them
gets the same result; a text of any length is read whole, in one task; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, words
from .graph import compact
from .runs import Windows, repeated_windows
from .shared import with_nulls

SCHEMA = "doc_id long, n_words long, n_removed long, kept string"


def _finish(chunk, w, gone) -> pa.Table:
    w = w or words(chunk)
    raw, keep = chunk.data.tobytes(), ~gone
    n = np.diff(w.first)
    before = np.append(0, np.cumsum(gone))
    removed = before[w.first[1:]] - before[w.first[:-1]]
    kept = []
    for i in range(len(chunk.doc)):
        own = raw[chunk.off[i] : chunk.off[i + 1]].split()
        kept.append(b" ".join(compress(own, keep[w.first[i] : w.first[i + 1]]) if removed[i] else own))
    return pa.table({"doc_id": chunk.doc, "n_words": n, "n_removed": removed, "kept": pa.array(kept, pa.binary()).cast(pa.string())})


def dedup_word_spans(docs: DataFrame, width: int = 20, gram: int = 8) -> DataFrame:
    """Remove every word covered by a window of ``width`` words that also starts earlier.

    docs: doc_id, text. Returns doc_id, n_words, n_removed and kept: the words
    that stay, joined by one space. Earlier means in a document of smaller
    doc_id, or further to the front of the same one; windows are judged on the
    input.
    """
    docs = with_nulls(docs)
    found = repeated_windows(docs.filter("doc_id is not null"), Windows(width, min(gram, width), True, True), _finish, SCHEMA, compact)

    def alone(batches):
        for b in batches:
            for chunk in chunks(b.set_column(0, "doc_id", pa.nulls(len(b), pa.int64()).fill_null(0))):
                w = words(chunk)
                out = _finish(chunk, w, np.zeros(len(w.start), bool))
                yield from out.set_column(0, "doc_id", pa.nulls(len(out), pa.int64())).to_batches()

    return found.unionByName(docs.filter("doc_id is null").mapInArrow(alone, SCHEMA))


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: words, removed words and a digest of what stays."""
    out = dedup_word_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
