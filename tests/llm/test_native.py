"""Exact dedup, sharding and mixing against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from hazardspark.llm import exact_dedup as module
from hazardspark.llm.exact_dedup import build_index, exact_dedup, keep_first
from hazardspark.llm.mixing import mix, mix_documents
from hazardspark.llm.sharding import BITS, shard

SPACE = re.compile(r"[\x20\x09-\x0D]")


def frame(spark, rows, schema="doc_id long, text string, source string"):
    # columns whose names clash with those the operators make
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit("x") for c in ("key", "bucket", "size", "rate", "salt", "bytes", "repeats")})


def rows(n=300):
    rng = random.Random(1)
    out = []
    for i in range(n):
        base = f"text {rng.randint(0, 60)} é"
        out.append((i, rng.choice([base, base.replace(" ", "\t"), base + " \n\x0b", base + " "]), rng.choice(["a", "b", "ß", "Z", None])))
    return [*out, (1000, None, "a"), (1001, "", None), (1002, " \t", "b"), (None, "text 1 é", "c"), (None, "alone", "c"), (7000, "twice", "a"), (7000, "twice", "a"), (7001, "long " * 50_000, "Z")]


def test_exact_dedup(spark):
    data = rows()
    groups: dict = {}
    for d, t, _ in data:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), d is None, d or 0, d))
    for capacity in (100_000, 20):  # a small capacity splits buckets and chains pages
        got = exact_dedup(frame(spark, data), capacity).collect()
        assert len(got) == len(data)
        for r in got:
            assert r.text_sha256 in {hashlib.sha256(k.encode()).hexdigest() for k in groups}
        by_sha = {hashlib.sha256(k.encode()).hexdigest(): min(v)[3] for k, v in groups.items()}
        size = {hashlib.sha256(k.encode()).hexdigest(): len(v) for k, v in groups.items()}
        assert all(r.keep_id == by_sha[r.text_sha256] and r.group_size == size[r.text_sha256] for r in got)
        kept = [(r.text_sha256, r.doc_id) for r in got if r.kept]
        assert len(kept) == len(groups) and dict(kept) == by_sha


def test_directory_splits_only_what_is_overfull(spark):
    data = [(i, f"t{i}", "a") for i in range(400)] + [(1000 + i, "same", "a") for i in range(200)]
    index = build_index(frame(spark, data), 50)
    sizes = index.groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys")).collect()
    assert all(r.n <= 50 or (r.n == 200 and r.keys == 1) for r in sizes) and len(sizes) > 8
    assert index.filter("text_sha256 = '%s'" % hashlib.sha256(b"same").hexdigest()).select("page").distinct().count() > 1


def test_texts_of_one_key_stay_apart(spark, monkeypatch):
    data = rows()
    want = sorted(map(str, exact_dedup(frame(spark, data)).collect()))
    for key in (F.lit(5).cast("long"), F.pmod(F.length("norm"), F.lit(3)).cast("long")):
        monkeypatch.setattr(module, "key_of", lambda norm, key=key: key)
        assert sorted(map(str, exact_dedup(frame(spark, data), 20).collect())) == want


def test_no_python_in_the_native_plans(spark):
    for plan in (exact_dedup(frame(spark, rows())), mix(frame(spark, rows()))):
        assert not any(w in plan._jdf.queryExecution().toString() for w in ("Python", "Arrow", "Pandas"))


def test_keep_first_keeps_columns(spark):
    docs = frame(spark, rows())
    got = keep_first(docs)
    assert got.columns == docs.columns
    want = {(r.doc_id, r.text_sha256) for r in exact_dedup(docs).collect() if r.kept}
    have = [(r.doc_id, hashlib.sha256(SPACE.sub("", r.text or "").encode()).hexdigest()) for r in got.collect()]
    assert set(have) == want and len(have) == len(want)


def test_sharding(spark):
    data = [(i, "x" * (i * 37 % 500), "a") for i in range(300)] + [(5000, "y" * 40_000, "a"), (None, None, "b"), (6000, "z" * 3000, "a"), (6000, "z" * 3000, "a")]
    limit = 4000
    place = lambda d: int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[: BITS // 4], 16)
    got = shard(frame(spark, data), limit).collect()
    assert len(got) == len(data)
    for r in got:
        for depth in range(BITS + 1):
            own = [(d, len((t or "").encode())) for d, t, _ in data if place(d) >> (BITS - depth) == place(r.doc_id) >> (BITS - depth)]
            if sum(b for _, b in own) <= limit or len(own) == 1 or depth == BITS:
                break
        assert (r.depth, r.prefix, r.shard_bytes, r.shard_docs) == (depth, place(r.doc_id) >> (BITS - depth), sum(b for _, b in own), len(own))


def brute_targets(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while left > 1e-9 and free:
        share = left / sum(weight[s] for s in free)
        left = 0.0
        for s in sorted(free, key=names.index):
            target[s] += share * weight[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
    return target


def test_mixing(spark):
    rng = random.Random(2)
    data = [(i, " ".join(["w"] * rng.randint(0, 50)) + rng.choice(["", "\x0b\n", "é"]), rng.choice(["a", "b", "b", "c", "ß", "Z", None])) for i in range(4000)]
    data += [(9000, None, "empty"), (None, "a b", None), (9001, "a b c", "c"), (9001, "a b c", "c")]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: dict = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = brute_targets(sizes)
    docs = frame(spark, data)
    got = mix(docs).collect()
    assert len(got) == len(data)
    of = {d: (t, s) for d, t, s in data}
    taken: dict = {}
    for r in got:
        t, s = of[r.doc_id]
        assert r["size"] == size(t) and r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-12, abs=1e-9)
        assert r.taken <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 0.1 * want[s] + 30 for s in want)
    again = mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    rows_out = mix_documents(docs)
    assert rows_out.columns == docs.columns
    assert rows_out.count() == sum(r.copies for r in got)


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert exact_dedup(empty).count() == 0 and keep_first(empty).count() == 0
    assert shard(empty).count() == 0
    assert mix(empty).count() == 0 and mix_documents(empty).count() == 0
