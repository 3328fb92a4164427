"""Packing by concatenation: all documents as one stream of tokens, cut at fixed windows.

The place of a document in the stream follows from two passes of prefix sums:
along each partition while it is tokenised, then over the partitions' totals,
one row each. Windows of ``capacity`` tokens are then cut wherever they fall. A
window that reaches over the end of a partition is told in parts by each of its
tasks; ``token_windows`` joins these boundary records, the rest are whole. What
remains at the end of the stream is cut at powers of two, so nothing is padded.

Results for odd rows: null or empty text is the one id 0; a null doc_id is kept
as it is; repeated rows take their places each on their own; a text of any
length is tokenised whole and written in runs of ``RUN`` ids at most; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import ragged_arange
from .packing import END_ID, word_ids
from .shared import stored

CAPACITY = 1024
RUN = 65_536
ROWS = 100  # texts tokenised at a time
BATCH = 200  # rows of RUN ids at most per Arrow batch
# Fixed value: how the tokenizer splits a text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


class ByteIds:
    """Token ids of texts by a byte-level tokenizer file, some times faster than the file's own library.

    Merging the pair whose union has the least id is what the file's list of
    merges does: ids follow that list, and every token's bytes are merged to
    that token (``tests/llm/test_windows.py`` holds the file to both, and the two
    libraries to each other on every code point). What this library refuses
    (it bounds the search for white space) goes to the file's own.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        ranks = {token_bytes(t): i for t, i in self.tokenizer.get_vocab().items() if t not in special}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def of(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except Exception:  # the other library takes any text, and raises what is wrong with this one
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def of_chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another with END_ID behind each, and where each begins."""
        end = np.array([END_ID], np.uint32)
        each = [x for t in texts for x in (self.of(t), end)]
        first = np.cumsum([0, *(len(x) + 1 for x in each[::2])])
        return np.concatenate(each), first


def token_bytes(token: str) -> bytes:
    """The bytes for which a token's characters stand: printing ones for themselves, the others, in order, for U+0100 and on."""
    return bytes(_BYTE_OF[c] for c in token)


_PRINTING = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_OF = {chr(b): b for b in _PRINTING} | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(_PRINTING)))}


def token_runs(docs: DataFrame, path: str | None = None) -> DataFrame:
    """First pass, written: doc_id, doc_tokens, start, length, ids, part and at: the run's place in the stream of its partition."""
    path = path or tokenizer_path()

    def run(batches):
        known, part, at = word_ids(path, ByteIds), TaskContext.get().partitionId(), 0
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                docs = b.slice(lo, ROWS)
                ids, first = known.of_chunk([t or "" for t in docs.column(1).to_pylist()])
                sizes = np.diff(first)
                n = -(-sizes // RUN)
                row = np.repeat(np.arange(len(n)), n)
                start = ragged_arange(n) * RUN
                length = np.minimum(sizes[row] - start, RUN)
                ends = np.append(0, np.cumsum(length))
                out = {"doc_id": docs.column(0).take(pa.array(row)), "doc_tokens": sizes[row], "start": start, "length": length, "part": np.full(len(row), part, np.int32), "at": at + ends[:-1]}
                out["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
                at += int(ends[-1])
                yield from pa.table(out).to_batches()

    schema = "doc_id long, doc_tokens long, start long, length long, part int, at long, ids array<int>"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(texts.mapInArrow(run, schema), "token-runs")


def in_stream(runs: DataFrame) -> tuple[DataFrame, int]:
    """Second pass: ``runs`` with at in the whole stream, and the stream's length. One row per partition is summed."""
    totals = runs.groupBy("part").agg(F.sum("length").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = stored(totals.select("part", F.coalesce(before, F.lit(0)).alias("ahead"), "n"), "part-totals")
    total = ahead.agg(F.sum("n")).first()[0] or 0
    return runs.join(F.broadcast(ahead.select("part", "ahead")), "part").withColumn("at", F.col("at") + F.col("ahead")).drop("ahead", "part"), total


def bounds(total: int, capacity: int) -> np.ndarray:
    """Where the sequences that are not of ``capacity`` begin: the rest of the stream in powers of two, and its end."""
    rest = total % capacity
    powers = [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]
    return total - rest + np.cumsum([0, *powers])


def cut(at: np.ndarray, length: np.ndarray, last: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """Runs of the stream cut at sequences: the run, the place in the run, the length, the sequence and the place in it, of each piece."""
    windows = last[0] // capacity

    def sequence(x):
        return np.where(x < last[0], x // capacity, windows + np.searchsorted(last, x, "right") - 1)

    n = sequence(at + length - 1) - sequence(at) + 1
    row = np.repeat(np.arange(len(n)), n)
    own = sequence(at)[row] + ragged_arange(n)
    begins = np.where(own < windows, own * capacity, last[np.clip(own - windows, 0, len(last) - 1)])
    ends = np.where(own < windows, begins + capacity, last[np.clip(own - windows + 1, 0, len(last) - 1)])
    lo, hi = np.maximum(begins, at[row]), np.minimum(ends, (at + length)[row])
    return row, lo - at[row], hi - lo, own, lo - begins


def _pieces(runs: DataFrame, total: int, capacity: int, schema: str, make) -> DataFrame:
    last = bounds(total, capacity)

    def run(batches):
        for b in batches:
            if b.num_rows:
                at, length = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("at", "length"))
                column = b.column(b.schema.get_field_index("ids"))
                where = column.offsets.to_numpy()[:-1]
                ids = column.values.to_numpy().astype("<u4")
                yield from pa.table(make(b, ids, where, *cut(at, length, last, capacity))).to_batches()

    return stored(runs.mapInArrow(run, schema), "pieces", BATCH)


def concat_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    runs, total = in_stream(token_runs(docs, path))

    def make(b, ids, where, row, lo, n, sequence, offset):
        first = where[row] + lo
        raw = ids.tobytes()
        crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(first.tolist(), n.tolist())]
        of = lambda c: b.column(b.schema.get_field_index(c)).take(pa.array(row))
        return {"doc_id": of("doc_id"), "start": of("start").to_numpy() + lo, "length": n, "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": of("doc_tokens"), "sequence_id": sequence, "offset": offset}

    return _pieces(runs, total, capacity, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long", make)


def token_windows(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The sequences themselves: sequence_id, ids. Boundary records of one window, ``capacity`` ids at most, are joined."""
    runs, total = in_stream(token_runs(docs, path))

    def make(b, ids, where, row, lo, n, sequence, offset):
        # pieces of one window that follow each other in this batch are one record
        new = np.append(True, (sequence[1:] != sequence[:-1]) | (offset[1:] != offset[:-1] + n[:-1]))
        heads = np.flatnonzero(new)
        sizes = np.add.reduceat(n, heads)
        got = ids[np.repeat(where[row] + lo, n) + ragged_arange(n)]
        out = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(got.astype(np.int32)))
        return {"sequence_id": sequence[heads], "offset": offset[heads], "length": sizes, "ids": out}

    told = _pieces(runs, total, capacity, "sequence_id long, offset long, length long, ids array<int>", make)
    whole = told.filter(F.col("length") == capacity).select("sequence_id", "ids")
    parts = told.filter(F.col("length") < capacity).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("all"))
    return whole.unionByName(parts.select("sequence_id", F.flatten("all.ids").alias("ids")))


def op13_concat_packing(spark, sf_dir: str) -> DataFrame:
    return concat_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
