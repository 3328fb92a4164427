"""Substring dedup by words and by bytes, against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hazardspark.llm.graph import nonbranching, paths
from hazardspark.llm.runs import PASSAGES, SPAN, SPANS, Windows, compared, pack, table, window_classes
from hazardspark.llm.substring_dedup import dedup_word_spans
from hazardspark.llm.suffix_dedup import dedup_byte_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "é", "ñandú", "straße"] + [f"w{i}" for i in range(40)]
    phrases = [" ".join(rng.choices(vocabulary, k=60)) for _ in range(4)]
    rows: list[tuple] = []
    for i in range(60):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 80)))]
        for _ in range(rng.randint(0, 3)):
            words = rng.choice(phrases).split()
            lo = rng.randint(0, 30)
            parts += [" ".join(words[lo : lo + rng.randint(5, 40)]), " ".join(rng.choices(vocabulary, k=rng.randint(0, 10)))]
        rows.append((i * 7 - 40, rng.choice([" ", "\n", "\t\x0b "]).join(parts)))
    rows += [(2000, rows[3][1]), (2001, rows[3][1]), (2002, " ".join(phrases * 2)), (2003, ""), (2004, None), (2005, "x"), (2005, "x"), (2006, "same " * 300), (2007, "same " * 90)]
    rows += [(2008, rows[5][1]), (2008, rows[5][1])]
    rng.shuffle(rows)
    return rows


def brute_words(rows, width):
    texts = {d: WORD.findall(t or "") for d, t in rows}
    first: dict = {}
    for d in sorted(texts):
        for s in range(len(texts[d]) - width + 1):
            first.setdefault(tuple(texts[d][s : s + width]), (d, s))
    out = {}
    for d, w in texts.items():
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] != (d, s):
                gone[s : s + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), kept)
    return out


def brute_bytes(rows, width):
    texts = {d: (t or "").encode() for d, t in rows}
    first: dict = {}
    for d in sorted(texts):
        for s in range(len(texts[d]) - width + 1):
            first.setdefault(texts[d][s : s + width], d)
    out = {}
    for d, w in texts.items():
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if first[w[s : s + width]] < d:
                gone[s : s + width] = [True] * width
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(w), sum(gone), runs, bytes(x for x, g in zip(w, gone) if not g))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("part", F.lit("clash"))


def test_words_match_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        want = brute_words(rows, 20)
        got = dedup_word_spans(frame(spark, rows).repartition(3), 20).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id], r.doc_id
        assert sum(r.n_removed for r in got) > 500


def test_bytes_match_brute_force(spark):
    for seed in (3, 4):
        rows = corpus(seed)
        want = brute_bytes(rows, 50)
        got = dedup_byte_spans(frame(spark, rows).repartition(3), 50).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id], r.doc_id
        assert sum(r.n_removed for r in got) > 3000


def test_null_ids_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = dedup_word_spans(frame(spark, [(None, text), (None, text), (1, text), (2, text)])).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, r.n_removed) for r in got] == [(None, 30, 0), (None, 30, 0), (1, 30, 0), (2, 30, 30)]
    got = dedup_byte_spans(frame(spark, [(None, text), (1, text), (2, text)])).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_removed, r.n_spans) for r in got] == [(None, 0, 0), (1, 0, 0), (2, len(text), 1)]
    assert dedup_word_spans(frame(spark, [])).count() == 0
    assert dedup_byte_spans(frame(spark, [])).count() == 0


def test_a_very_long_text(spark):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(300_000))
    rows = [(1, long), (2, "a b c " + long[: len(long) // 2].rpartition(" ")[0])]
    got = {r.doc_id: r for r in dedup_word_spans(frame(spark, rows)).select("doc_id", "n_words", "n_removed").collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == got[2].n_words - 3
    got = {r.doc_id: r for r in dedup_byte_spans(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed").collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == got[2].n_bytes - 6


def test_bucket_pointers_tell_windows_apart():
    rng = np.random.default_rng(0)
    for width in (5, 8, 9, 50):
        data = rng.integers(0, 2 if width > 9 else 4, 4000).astype(np.uint8)
        data[2000:2200] = data[100:300]
        starts = np.arange(len(data) - width + 1)
        got = window_classes(data, starts, width)
        groups: dict = {}
        for s in starts:
            groups.setdefault(data[s : s + width].tobytes(), []).append(got[s])
        assert all(len(set(g)) == 1 and g[0] >= 0 for g in groups.values() if len(g) > 1)
        ids = [g[0] for g in groups.values() if g[0] >= 0]
        assert len(set(ids)) == len(ids)


def test_nothing_goes_by_hash_alone():
    """A span whose source turns out to have other words or bytes stays."""
    docs = pa.table({"doc_id": pa.array([1, 2], pa.int64()), "text": ["a b  c d", "a b c d"]})
    for by_word, right, wrong in ((True, b"a b c ", b"a b x "), (False, b"a b  c", b"a b xc")):
        how = Windows(3 if by_word else 6, 2, by_word, True)
        for passage, n in ((right, 1), (wrong, 0)):
            span = pack(*(np.array([v], t) for v, t in zip((1, 0, 1, 7, 0), SPAN)))
            told = pack(np.array([7], np.int64), np.array([0], np.int32), np.array([1], np.int32), np.array([len(passage)], np.int64)) + passage
            found = table([(0, SPANS, span), (0, PASSAGES, told)])
            out = compared(how, lambda chunk, w, gone: pa.table({"gone": [int(gone.sum())]}))(None, docs, found)
            assert sum(out.column("gone").to_pylist()) == n * how.width


def test_paths_of_a_graph(spark):
    """Edge 10 to 14 always follow one another; 15 follows 14 in one document only."""
    rows, names = [], [10, 11, 12, 13, 14]
    for doc, more in ((1, [15]), (2, [16, 15]), (3, [])):
        place = 100 * doc
        for name in [*names, *more]:
            rows.append((name, doc, place, 3, 1, 0))
            place += 3
    edges = spark.createDataFrame(rows, "name long, doc long, place int, n int, source long, at int")
    links = nonbranching(edges)
    assert {(r.name, r.next) for r in links.collect()} == set(zip(names, names[1:]))
    assert {(r.name, r.doc, r.place, r.n) for r in paths(edges, links).collect()} == {
        (10, 1, 100, 15), (15, 1, 115, 3), (10, 2, 200, 15), (16, 2, 215, 3), (15, 2, 218, 3), (10, 3, 300, 15)}
