"""The pipeline's stage of near duplicates against brute force: five words, a similarity of 0.8."""

import random

import corpus_pipeline

SIZE, PERCENT = 5, 80


def kept(rows):
    of = {}
    for d, t in rows:
        w = t.split()
        of[d] = {tuple(w[i : i + SIZE]) for i in range(max(1, len(w) - SIZE + 1))}
    root = {d: d for d in of}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in of:
        for b in of:
            if a < b and 100 * len(of[a] & of[b]) >= PERCENT * len(of[a] | of[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d for d in of if find(d) == d}


def test_which_near_duplicates_go(spark):
    rng = random.Random(8)
    rows = []
    for family in range(30):
        base = [f"f{family}w{rng.randint(0, 9999)}" for _ in range(rng.randint(9, 120))]
        for copy in range(4):
            words = list(base)
            for at in rng.sample(range(len(words)), min(len(words) // 20, copy)):
                words[at] = f"edit{rng.randint(0, 9999)}"
            rows.append((10 * family + copy, " ".join(words + ["end"] * (copy == 3))))
    base = [f"w{i}" for i in range(100)]
    other = list(base)
    other[30], other[70] = "x", "y"  # 86 of 106 shingles: 0.811
    rows += [(1000, " ".join(base)), (1001, " ".join(other))]
    want = kept(rows)
    assert 1001 not in want and 30 < len(want) < len(rows) - 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == want
