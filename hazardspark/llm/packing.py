"""Best-fit packing of token sequences.

Texts are tokenised where they lie (a cache of words spares the tokenizer most
of its work; the tokenizer drops white space, so words can be encoded one by
one). Only the pieces' sizes move on. They are dealt to tasks of some hundred
thousand pieces, and each task runs bounded-space best-fit over the stream of
its own: a fixed number of open bins, a bitset of the free spaces among them,
the tightest bin that fits takes the piece, and when a bin must close, the
fullest does. The stream is looked ahead by ``LOOKAHEAD`` pieces, the longest
of which go first (an extension of the online method: of 100,000 pieces, 2,048
bins then make 1.0001 times the least number of sequences, without it 1.009).

Results for odd rows: null or empty text is the one id 0; a null doc_id is kept
as it is; repeated rows are packed each on their own; a text
of any length is cut into pieces (its task holds some 20 bytes per byte of the
longest text); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import _LOWER, Chunk, Words, chunks, numbered, ragged_arange, word_hashes, words
from .shared import stored

CAPACITY = 2048
OPEN_BINS = 2_048
LOOKAHEAD = 8_192
TASK_PIECES = 100_000
CACHE_WORDS = 400_000
END_ID = 0
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
COMBINES = 0xC6  # no byte from here on occurs in U+0000 to U+017F, none of which combines with a letter before it


def _letters() -> np.ndarray:
    """By (lead byte - 0xC3, last byte): which of U+00C0 to U+017F are letters that lower-casing leaves letters alone.

    U+0130 is none of them: it becomes an i and a combining dot, which the tokenizer takes with the punctuation behind.
    """
    out = np.zeros((3, 256), bool)
    for code in range(0xC0, 0x180):
        low = unicodedata.normalize("NFC", chr(code).lower())
        lead, last = chr(code).encode()
        out[lead - 0xC3, last] = all(unicodedata.category(c).startswith("L") for c in low)
    return out


_LATIN = _letters()


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


class WordIds:
    """Token ids of words, remembered up to a bound.

    The tokenizer lower-cases and takes runs of letters apart from runs of
    punctuation, so ASCII case and punctuation at a word's end are taken off
    before looking it up. Words of letters alone are encoded many at a time: each ends
    with the only one of its tokens that ends a word.
    """

    def __init__(self, path: str, bound: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already
        self.bound = bound
        self._load(path)
        self.clear()

    def _load(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the same merges without normalising: for words that it would leave as they are
        parts = json.loads(self.tokenizer.to_str())
        by_space = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.bare = Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "pre_tokenizer": by_space, "added_tokens": []}))
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted 64-bit hashes of known words
        self.slot = np.zeros(0, np.int64)  # where ``start`` and ``length`` have them
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids one after another, and how many each word has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = " ".join(words)
        known = text == text.lower() and unicodedata.is_normalized("NFC", text)
        ids = np.array((self.bare if known else self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words) or len(ids) != ends[-1]:
            return self._alone(words)
        return ids, np.diff(ends, prepend=0)

    def _kind(self, word: str) -> tuple[Callable, bool]:
        """How a word is encoded, and what it may be encoded together with."""
        return (self._together, word.isascii()) if word.isalpha() else (self._alone, False)

    def _learn(self, keys: np.ndarray, new: list[bytes]) -> None:
        """Encode words and remember them under their (sorted) hashes."""
        texts = [w.decode("utf-8") for w in new]
        kinds: dict = {}
        for i, t in enumerate(texts):
            kinds.setdefault(self._kind(t), []).append(i)
        slots, n = np.empty(len(new), np.int64), len(self.keys)
        for (encode, _), own in kinds.items():
            for lo in range(0, len(own), 256):
                part = own[lo : lo + 256]
                ids, lengths = encode([texts[i] for i in part])
                while n + len(part) > len(self.start):
                    self.start, self.length = np.concatenate([self.start, self.start]), np.concatenate([self.length, self.length])
                while self.used + len(ids) > len(self.ids):
                    self.ids = np.concatenate([self.ids, self.ids])
                self.start[n : n + len(part)] = self.used + np.cumsum(lengths) - lengths
                self.length[n : n + len(part)] = lengths
                self.ids[self.used : self.used + len(ids)] = ids
                self.used += len(ids)
                slots[part] = np.arange(n, n + len(part))
                n += len(part)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slot = np.insert(self.keys, at, keys), np.insert(self.slot, at, slots)

    @staticmethod
    def _units(chunk: Chunk) -> tuple[Chunk, Words]:
        """The chunk with ASCII letters lower-cased, and its words with punctuation at the end as words of their own.

        Words that hold ``<`` may hold a special token and stay as they are; so do those with a byte from COMBINES on:
        the tokenizer composes before it lower-cases, and some marks combine with a small letter but not with its capital.
        """
        w = words(chunk)
        marked = np.append(0, np.cumsum((chunk.data == ord("<")) | (chunk.data >= COMBINES)))
        marked = marked[w.end] > marked[w.start]
        low = _LOWER[chunk.data]
        if marked.any():
            for a, b in zip(w.start[marked].tolist(), w.end[marked].tolist()):
                low[a:b] = chunk.data[a:b]
        end = w.end.copy()
        for _ in range(4):
            end -= (end - w.start > 1) & _PUNCTUATION[low[end - 1]] & ~marked
        # before the punctuation stands an ASCII letter or digit, or one of the letters U+00C0 to U+017F
        before, lead = low[end - 1], low[np.maximum(end - 2, 0)]
        latin = (end - w.start > 1) & (lead >= 0xC3) & (lead <= 0xC5) & _LATIN[np.clip(lead.astype(np.int64) - 0xC3, 0, 2), before]
        split = (end < w.end) & (_PLAIN[before] | latin)
        n = 1 + split
        at = np.cumsum(n) - n
        start, stop = np.repeat(w.start, n), np.repeat(w.end, n)
        stop[at[split]] = end[split]
        start[at[split] + 1] = end[split]
        return Chunk(chunk.doc, low, chunk.off), Words(start, stop, np.append(at, len(start))[w.first])

    def of_chunk(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents, one after another with END_ID behind each, and where each begins."""
        chunk, w = self._units(chunk)
        keys, pick, which = np.unique(word_hashes(chunk, w), return_index=True, return_inverse=True)
        if len(self.keys) > self.bound:
            self.clear()
        near = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = self.keys[near] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            raw = chunk.data.tobytes()
            self._learn(keys[new], [raw[a:b] for a, b in zip(w.start[pick[new]].tolist(), w.end[pick[new]].tolist())])
        spot = self.slot[np.searchsorted(self.keys, keys)][which]
        length = self.length[spot]
        ids = self.ids[np.repeat(self.start[spot], length) + ragged_arange(length)]
        first = np.append(0, np.cumsum(length))[w.first] + np.arange(len(w.first))
        out = np.full(len(ids) + len(chunk.doc), END_ID, np.uint32)
        inside = np.ones(len(out), bool)
        inside[first[1:] - 1] = False
        out[inside] = ids
        return out, first


_KNOWN: dict[str, object] = {}


def word_ids(path: str, kind: type = WordIds):
    """One per Python worker, so that later tasks find the words of earlier ones."""
    if path not in _KNOWN:
        _KNOWN[path] = kind(path)
    return _KNOWN[path]


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for): one row per piece."""
    path = path or tokenizer_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        known = word_ids(path)
        for b in batches:
            doc_id, b = numbered(b)
            for chunk in chunks(b, size=512 << 10):
                ids, first = known.of_chunk(chunk)
                sizes = np.diff(first)
                n = -(-sizes // capacity)
                row = np.repeat(np.arange(len(n)), n)
                piece = ragged_arange(n)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                raw, at = ids.astype("<u4").tobytes(), first[row] + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist())]
                out = {"doc_id": doc_id.take(pa.array(chunk.doc[row])), "piece": pa.array(piece, pa.int32()), "start": start, "length": length, "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(ids.astype(np.int32)))
                yield from pa.table(out).to_batches()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


class Bins:
    """Bounded-space online best-fit; bins are keyed by their free space."""

    def __init__(self, capacity: int, bound: int):
        self.capacity, self.bound = capacity, bound
        self.having: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.free = 0  # bit f: some open bin has f free
        self.open = self.made = 0

    def put(self, length: int) -> tuple[int, int]:
        """The bin that takes the piece, and the place in it."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            own = self.having[space]
            name = own.pop()
            if not own:
                self.free ^= 1 << space
            self.open -= 1
        else:
            if self.open >= self.bound:
                full = (self.free & -self.free).bit_length() - 1
                self.having[full].pop()
                if not self.having[full]:
                    self.free ^= 1 << full
                self.open -= 1
            name, space = self.made, self.capacity
            self.made += 1
        left = space - length
        if left:
            self.having[left].append(name)
            self.free |= 1 << left
            self.open += 1
        return name, self.capacity - space


def pack(sized: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, task_pieces: int = TASK_PIECES, lookahead: int = LOOKAHEAD) -> DataFrame:
    """``sized`` (with doc_id, piece and length up to ``capacity``) with sequence_id and offset.

    A task packs about ``task_pieces`` pieces, however many there are, so the
    few bins that stay part empty at its end weigh little.
    """
    schema = sized.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def run(batches):
        bins = Bins(capacity, open_bins)
        base = TaskContext.get().partitionId() << 32

        def placed(held):
            t = pa.Table.from_batches(held)
            lengths = t.column("length").to_numpy()
            order = np.argsort(-lengths, kind="stable")
            t = t.take(pa.array(order))
            spots = np.array([bins.put(n) for n in lengths[order].tolist()], np.int64).reshape(-1, 2)
            return t.append_column("sequence_id", pa.array(spots[:, 0] + base)).append_column("offset", pa.array(spots[:, 1])).to_batches()

        held, rows = [], 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, lookahead - rows)
                b = b.slice(len(part))
                held.append(part)
                rows += len(part)
                if rows == lookahead:
                    yield from placed(held)
                    held, rows = [], 0
        if rows:
            yield from placed(held)

    n = max(1, round(sized.count() / task_pieces))
    lot = F.xxhash64("doc_id", "piece")
    return sized.repartition(n, lot).sortWithinPartitions(lot, "doc_id", "piece").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row per piece of a document: where it comes from, and its sequence and offset."""
    return pack(stored(pieces(docs, capacity, path), "pieces"), capacity)


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
