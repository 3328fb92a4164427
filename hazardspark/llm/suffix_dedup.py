"""Substring dedup by bytes: a sparse suffix array by bucket-pointer refinement.

Of all suffixes, only those at content-chosen anchors are put in the initial
buckets: the q-gram of smallest hash in every ``width`` bytes (see ``runs``).
Spark deals the buckets to tasks by their q-gram. Buckets of one suffix are
settled. Where the suffixes of a bucket differ within the reach of their
windows, one of each kind carries its bytes along, and these are refined by
sorting on bucket pointers of later offsets, each round reusing the pointers of
the last (``runs.window_classes``), until the depth is ``width``. Suffixes that
are alike by hash as far as their windows reach take a shorter way to the same
end: their bytes are compared with those of the first of them.

Results for odd rows: a null or empty text has no bytes; a null doc_id has no
place in the order, so its row is kept whole and is no source for others; rows
that repeat a doc_id are one document with one text, and each of them gets the
same result; a text of any length is read whole, in one task; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks
from .runs import Windows, repeated_windows
from .shared import with_nulls

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _finish(chunk, w, gone) -> pa.Table:
    off, n = chunk.off, len(chunk.data)
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    edges = off[1:-1][off[1:-1] < n]
    begins[edges] = gone[edges]
    total = lambda x: (c := np.append(0, np.cumsum(x)))[off[1:]] - c[off[:-1]]
    removed = total(gone)
    ends = off[1:] - np.cumsum(removed)
    kept = chunk.data[~gone] if removed.any() else np.ascontiguousarray(chunk.data)
    offsets = np.append(0, ends).astype(np.int32)
    column = pa.BinaryArray.from_buffers(pa.binary(), len(chunk.doc), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(kept.tobytes())])
    return pa.table({"doc_id": chunk.doc, "n_bytes": np.diff(off), "n_removed": removed, "n_spans": total(begins), "kept": column})


def dedup_byte_spans(docs: DataFrame, width: int = 50, gram: int = 20) -> DataFrame:
    """Remove every byte covered by a ``width``-byte string that also starts in a document of smaller doc_id.

    docs: doc_id, text. Returns doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs) and kept: the remaining bytes, joined. Texts are UTF-8;
    strings are judged on the input.
    """
    docs = with_nulls(docs)
    found = repeated_windows(docs.filter("doc_id is not null"), Windows(width, min(gram, width), False, False), _finish, SCHEMA)

    def alone(batches):
        for b in batches:
            for chunk in chunks(b.set_column(0, "doc_id", pa.nulls(len(b), pa.int64()).fill_null(0))):
                out = _finish(chunk, None, np.zeros(len(chunk.data), bool))
                yield from out.set_column(0, "doc_id", pa.nulls(len(out), pa.int64())).to_batches()

    return found.unionByName(docs.filter("doc_id is null").mapInArrow(alone, SCHEMA))


def op9_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs and a digest of what stays."""
    out = dedup_byte_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
