"""Packing: exact round trips through the tokenizer, and gapless sequences."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hazardspark.llm.arrays import chunks
from hazardspark.llm.packing import Bins, WordIds, pack, pack_documents, pieces, tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def rows():
    rng = random.Random(4)
    words = ["the", "Straße", "don't", "naïve", "x" * 90, "été", "日本語", "a.b,c!!", "<|endoftext|>", "12345", " odd space", "é", "🙂", "I'LL", "\x00\x01"]
    out = [(i, rng.choice([" ", "\n", "\t\t", "\x0b", "\r\n"]).join(rng.choices(words, k=rng.randint(0, 1200)))) for i in range(120)]
    return [*out, (500, None), (501, ""), (502, " \n "), (None, "no id"), (503, "twice"), (503, "twice"), (504, "́ starts with a mark ́")]


def test_pieces_match_the_tokenizer(spark):
    tokenizer = tokenizers.Tokenizer.from_file(tokenizer_path())
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("piece", F.lit("clash")).withColumn("start", F.lit(1))
    want = []
    for d, t in data:
        ids = np.array(ids_of(tokenizer, t), "<u4")
        for p, s in enumerate(range(0, len(ids), 2048)):
            own = ids[s : s + 2048]
            want.append((d, p, s, len(own), zlib.crc32(own.tobytes())))
    got = [tuple(r) for r in pieces(docs).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    whole = pieces(docs, with_ids=True).filter("doc_id = 0").orderBy("piece").collect()
    assert [i for r in whole for i in r.ids] == ids_of(tokenizer, data[0][1])
    packed = pack_documents(docs).collect()
    assert sorted([tuple(r)[:5] for r in packed], key=key) == sorted(want, key=key)
    check_sequences(packed)


def test_letters_before_punctuation():
    """Every letter of U+00C0 to U+017F before all ASCII punctuation, alone and in random texts."""
    tokenizer, known = tokenizers.Tokenizer.from_file(tokenizer_path()), WordIds(tokenizer_path())
    marks = [chr(c) for c in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127))]
    letters = [chr(c) for c in range(0xC0, 0x180)]
    texts = [f"ab{c}{p} {c}{p}{p} x{c}A{p}" for c in letters for p in marks] + ["TEMSİLCİSİ.", "GELDİ, GİTTİ."]
    rng = random.Random(1)
    texts += ["".join(rng.choices(letters + marks + list("abIİ019ΣΑ\u0307\u0301    "), k=rng.randint(1, 60))) for _ in range(4000)]
    for chunk in chunks(pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": texts})):
        ids, first = known.of_chunk(chunk)
        for i, d in enumerate(chunk.doc):
            assert ids[first[i] : first[i + 1]].tolist() == ids_of(tokenizer, texts[d]), texts[d]


def test_marks_that_combine():
    """Every capital with every mark of U+0300 to U+036F, and random texts with all of them."""
    tokenizer, known = tokenizers.Tokenizer.from_file(tokenizer_path()), WordIds(tokenizer_path())
    marks, capitals = [chr(c) for c in range(0x300, 0x370)], "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    texts = [f"{c}{m} a{c}{m}b. {c}\u0591{m}" for c in capitals for m in marks] + ["J\u030cON", "H\u0331adīth"]
    rng = random.Random(6)
    texts += ["".join(rng.choice(marks) if rng.random() < 0.2 else rng.choice(capitals + "abjy.,'< éÄİß日") for _ in range(rng.randint(1, 30))) for _ in range(20_000)]
    want = [e.ids + [0] for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    for chunk in chunks(pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": texts})):
        ids, first = known.of_chunk(chunk)
        for i, d in enumerate(chunk.doc):
            assert ids[first[i] : first[i + 1]].tolist() == want[d], ascii(texts[d])


def test_a_very_long_text(spark):
    text = "Große Wörter, ein langer Text. " * 60_000
    ids = np.array(ids_of(tokenizers.Tokenizer.from_file(tokenizer_path()), text), "<u4")
    got = pieces(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("piece").collect()
    assert [r.start for r in got] == list(range(0, len(ids), 2048)) and sum(r.length for r in got) == len(ids)
    assert [r.ids_crc32 for r in got] == [zlib.crc32(ids[s : s + 2048].tobytes()) for s in range(0, len(ids), 2048)]


def check_sequences(rows, capacity=2048):
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_few_sequences(spark):
    rng = random.Random(9)
    sizes = [min(2048, int(rng.lognormvariate(6, 1))) + 1 for _ in range(20_000)]
    sized = spark.createDataFrame([(i, 0, s if s <= 2048 else 2048) for i, s in enumerate(sizes)], "doc_id long, piece int, length long")
    for tasks, slack in ((100_000, 1.002), (5_000, 1.01)):
        n = check_sequences(pack(sized, task_pieces=tasks).collect())
        assert n <= slack * sum(min(2048, s) for s in sizes) / 2048 + tasks // 5_000
    assert pack(sized.limit(0)).count() == 0


def test_bins_close_the_fullest():
    bins = Bins(10, 2)
    assert [bins.put(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # the third closes bin 1, 3 free
    assert bins.put(4) == (0, 6) and bins.put(3) == (3, 0) and bins.put(2) == (2, 8)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the synthetic tables")
def test_the_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tokenizer = tokenizers.Tokenizer.from_file(tokenizer_path())
    want, total = {}, 0
    for r in docs.collect():
        ids = np.array(ids_of(tokenizer, r.text), "<u4")
        total += len(ids)
        want |= {(r.doc_id, p): zlib.crc32(ids[s : s + 2048].tobytes()) for p, s in enumerate(range(0, len(ids), 2048))}
    got = pack_documents(docs).collect()
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in got} == want and len(got) == len(want)
    assert check_sequences(got) <= 1.003 * total / 2048 + 1
