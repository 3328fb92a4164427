"""Numpy helpers over Arrow string columns: chunks, words, rolling hashes.

Everything here works on one bounded chunk of documents inside a task.  Texts
stay in their Arrow buffers (UTF-8 bytes); a null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 256 << 10  # arrays of eight bytes per byte of text then stay in the cache

_U = np.uint64
_R = _U(0x9E3779B97F4A7C15 | 1)
_R2 = _U(0xD6E8FEB86659FD93 | 1)


@dataclass
class Chunk:
    """Documents whose texts lie one after another in ``data``."""

    doc: np.ndarray  # int64, one per document
    data: np.ndarray  # uint8
    off: np.ndarray  # int64, len(doc) + 1


def chunks(table: pa.RecordBatch | pa.Table, ids: str = "doc_id", text: str = "text", size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Split a batch into runs of whole documents of about ``size`` bytes each."""
    batches = table.to_batches() if isinstance(table, pa.Table) else [table]
    for batch in batches:
        if not batch.num_rows:
            continue
        doc = batch.column(batch.schema.get_field_index(ids)).to_numpy(zero_copy_only=False).astype(np.int64)
        column = batch.column(batch.schema.get_field_index(text))
        if column.null_count:
            column = column.fill_null("")
        wide = pa.types.is_large_string(column.type)
        _, offsets, values = column.buffers()
        off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(doc):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
            hi = min(hi, len(doc))
            yield Chunk(doc[lo:hi], data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; destroys the linearity of sums below."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x = x * _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


def _powers(r: np.uint64, n: int, cache: dict) -> np.ndarray:
    have = cache.get(int(r))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 18), r, np.uint64)
        have[0] = 1
        cache[int(r)] = have = np.multiply.accumulate(have)
    return have[:n]


_POWERS: dict = {}
_R_INV = _U(pow(int(_R), -1, 1 << 64))
_R2_INV = _U(pow(int(_R2), -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9FB21C651E98DF25))


def prefix_sums(values: np.ndarray, second: bool = False) -> np.ndarray:
    """Prefix sums of values[i] * r**i modulo 2**64; ``span_hash`` reads spans off them."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(_R2 if second else _R, len(values), _POWERS), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
    """A hash of values[start:end] that depends on the values alone, not on where they stand."""
    back = _powers(_R2_INV if second else _R_INV, len(sums), _POWERS)
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass
class Words:
    """Words of a chunk: byte spans in ``data`` and, per document, where its words start."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # len(doc) + 1: index of each document's first word


def words(chunk: Chunk) -> Words:
    """Maximal runs of bytes other than space, tab, LF, VT, FF and CR, never across documents."""
    n = len(chunk.data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_SPACE[chunk.data]
    opens = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    edges = chunk.off[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    opens[edges] = inside[edges + 1]
    closes[edges - 1] = inside[edges]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(start, end, np.searchsorted(start, chunk.off))


def word_hashes(chunk: Chunk, w: Words, lower: bool = False) -> np.ndarray:
    """One 64-bit hash per word, of its bytes (A-Z lower-cased first if asked for)."""
    data = _LOWER[chunk.data] if lower else chunk.data
    return span_hash(prefix_sums(_BYTE[data]), w.start, w.end)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for each i, by doubling."""
    have, span = x, 1
    while span * 2 <= width:
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    rest = width - span
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def ragged_arange(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, one after another."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)


def numbered(batch: pa.RecordBatch) -> tuple[pa.Array, pa.RecordBatch]:
    """The doc_id column, and the batch with row numbers in its place (ids may be null)."""
    at = batch.schema.get_field_index("doc_id")
    return batch.column(at), batch.set_column(at, "doc_id", pa.array(np.arange(batch.num_rows)))
