"""Packing by windows: exact ids, one place for each, nothing padded."""

import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardspark.llm.windows import PATTERN, RUN, ByteIds, bounds, concat_documents, cut, token_windows, tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def check(docs, tokenizer, capacity=1024):
    want = sorted((r.doc_id is None, r.doc_id or 0, tuple([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0])) for r in docs.collect())
    got = concat_documents(docs, capacity).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
        size = sum(r.length for r in own)
        assert size == capacity or size < capacity and size & (size - 1) == 0
    windows = {r.sequence_id: r.ids for r in token_windows(docs, capacity).collect()}
    assert {s: len(x) for s, x in windows.items()} == {s: sum(r.length for r in own) for s, own in by.items()}
    assert sum(map(len, windows.values())) == sum(len(x) for *_, x in want)
    stream: dict = {}
    for r in got:
        stream.setdefault(r.doc_id, []).append(r)
    crc = lambda ids, r: zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for doc_id, own in stream.items():
        texts = [ids for none, d, ids in want if (None if none else d) == doc_id]
        assert sum(r.length for r in own) == sum(map(len, texts))
        for r in own:
            assert any(len(ids) == r.doc_tokens and crc(ids, r) == r.ids_crc32 for ids in texts)
        if len(texts) == 1:
            own.sort(key=lambda r: r.start)
            assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
    return len(got), len(by)


def test_odd_rows(spark, tokenizer):
    rng = random.Random(2)
    words = ["the", " Straße", "don't", "\n\n", "naïve", "x" * 90, "  ", "日本語", "a.b,c!!", "<|endoftext|>", "12345", "  odd", "🙂", "I'LL", "\x00\x01", "\r\n"]
    rows = [(i, "".join(rng.choices(words, k=rng.randint(0, 700)))) for i in range(80)]
    rows += [(500, None), (501, ""), (502, " \n "), (None, "no id"), (503, "twice"), (503, "twice"), (504, "one two three " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("part", "at", "ids", "start", "length")})
    check(docs.repartition(5), tokenizer)
    check(docs.limit(30).repartition(3), tokenizer, 64)
    assert concat_documents(docs.limit(0)).count() == 0 and token_windows(docs.limit(0)).count() == 0
    assert check(spark.createDataFrame([(1, None)], "doc_id long, text string"), tokenizer) == (1, 1)


def test_cuts():
    assert bounds(2048, 1024).tolist() == [2048] and bounds(1024 + 13, 1024).tolist() == [1024, 1032, 1036, 1037]
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(1, 12))]
        ends, capacity = np.cumsum(sizes), 16
        row, lo, n, sequence, offset = cut(ends - sizes, np.array(sizes), bounds(int(ends[-1]), capacity), capacity)
        places = [(int(r), int(a) + i) for r, a, m in zip(row, lo, n) for i in range(m)]
        assert places == [(r, i) for r, s in enumerate(sizes) for i in range(s)]
        filled = sorted((int(s), int(o) + i) for s, o, m in zip(sequence, offset, n) for i in range(m))
        assert len(set(filled)) == ends[-1] and all(o == 0 or (s, o - 1) in set(filled) for s, o in filled)
    assert RUN > 1024


def test_the_two_libraries_agree(tokenizer):
    """What makes least-rank merging equal the file's own: merges in the order of ids, every token merged to itself, the same pattern."""
    file = json.load(open(tokenizer_path()))
    vocabulary, merges = file["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
    assert [vocabulary[a + b] for a, b in merges] == list(range(256, 256 + len(merges))) and public_tokenizers.PATTERN == PATTERN
    bare = tokenizers.Tokenizer.from_str(json.dumps(file | {"pre_tokenizer": None, "added_tokens": []}))
    names = list(vocabulary)
    assert [e.ids for e in bare.encode_batch_fast(names, add_special_tokens=False)] == [[vocabulary[n]] for n in names]
    known = ByteIds(tokenizer_path())
    texts = [f"a{c}a1{c}1 .{c}. {c} {c}{c}x\n{c}" for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000, 3)])]
    rng = random.Random(7)
    alphabet = [*"abcXYZ019 \t\n  .,'!-<|>", "'s", "'ll", " ", "　", "\u0085", "é", "日", "😀", "<|endoftext|>", "\r\n", "   "]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(20_000)] + ["a" * 100_000, " " * 200_000, "\n" * 100_000 + "x"]
    for text, e in zip(texts, tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
        assert known.of(text).tolist() == e.ids, ascii(text[:80])
