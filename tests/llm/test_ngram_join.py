"""The Jaccard join against brute force over all pairs."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from hazardspark.llm import ngram_join
from hazardspark.llm.components import components
from hazardspark.llm.ngram_join import jaccard_components, overlaps

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(rows, size=4):
    out = {}
    for d, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = WORD.findall(low)
        out[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def brute(rows, percent=85):
    of = sets(rows)
    parent = {d: d for d in of}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(d for d in of if d is not None)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(of[a] & of[b])
            if common and 100 * common >= percent * len(of[a] | of[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(of[d]), root(d)) for d in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)] + ["É", "the", "The"]
    passage = rng.choices(vocabulary, k=40)
    rows = []
    for family in range(12):
        base = rng.choices(vocabulary, k=rng.randint(3, 90))
        if family % 3 == 0:
            base += passage
        for copy in range(rng.choice([1, 2, 5, 14])):
            words = list(base)
            for _ in range(rng.randint(0, 4)):  # about as many edits as the threshold allows
                words[rng.randrange(len(words))] = f"edit{rng.randint(0, 999)}"
            rows.append((family * 100 + copy, rng.choice([" ", "\n"]).join(words)))
    rows += [(5000 + i, " ".join(passage + rng.choices(vocabulary, k=rng.randint(0, 8)))) for i in range(25)]
    rows += [(6000, ""), (6001, None), (6002, "one"), (6003, "ONE"), (6004, "one two"), (6005, " \t"), (6006, "one two three four"), (6006, "one two three four")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("part", "rep", "n", "value", "doc", "component_id")})


def test_components_match_brute_force(spark):
    for seed in (1, 2, 3):
        rows = corpus(seed)
        want = brute(rows)
        got = jaccard_components(frame(spark, rows).repartition(3)).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert len({c for _, c in want.values()}) < len(want) - 20


def test_groups_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 200)
    rows = corpus(4)
    got = jaccard_components(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_short_documents_that_share_no_counted_ngram(spark):
    rng = random.Random(7)
    rows = []
    for pair in range(400):
        words = [f"p{pair}w{rng.randint(0, 999)}" for _ in range(rng.randint(9, 20))]
        longer = words + [f"more{rng.randint(0, 999)}" for _ in range(rng.randint(1, 3))]
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(longer))]
    want = brute(rows)
    got = jaccard_components(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) < len(want) - 100


def test_overlaps_of_two_blocks():
    rng = random.Random(6)
    sets = [np.array(sorted(rng.sample(range(300), rng.randint(0, 200))), np.uint64) for _ in range(40)]
    want = np.array([[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets])
    assert (np.triu(overlaps(sets, None), 1) == np.triu(want, 1)).all()
    assert (overlaps(sets[:15], sets[15:]) == want[:15, 15:]).all()


def test_one_id_with_several_texts(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, "some other text of its own"), (2, " ".join([*words, "more"])), (7, "a b c d e f"), (8, "g h i j k l"), (9, "a b c d e f"), (9, "g h i j k l")]
    got = jaccard_components(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 57, 1), (2, 3, 1), (2, 58, 1), (7, 3, 7), (8, 3, 7), (9, 3, 7), (9, 3, 7)]


def test_a_large_group_of_near_copies_moves_no_pairs(spark):
    """3,000 different near copies: every set meets the leader once, so hardly a block is left to multiply."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(3000):
        words = list(base)
        words[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    seen: list = []
    keep = ngram_join.stored
    try:
        ngram_join.stored = lambda df, name, **how: (seen.append((name, out := keep(df, name, **how))), out)[1]
        got = jaccard_components(docs)
        assert {r.component_id for r in got.collect()} == {0}
    finally:
        ngram_join.stored = keep
    rows_of = {name: df.count() for name, df in seen}
    assert rows_of["with-leader"] < 3 * len(rows) and rows_of["links"] + rows_of["direct"] < 3 * len(rows)


def test_a_very_long_text(spark):
    words = [f"w{i % 7919}x{i % 31}" for i in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:190_000])), (3, "w1x1 w2x2 w3x3 w4x4 w5x5")]
    got = jaccard_components(frame(spark, rows)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 3)}


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = jaccard_components(frame(spark, [(None, text), (3, text), (5, text.upper())])).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(None, 27, None), (3, 27, 3), (5, 27, 3)}
    assert jaccard_components(frame(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
