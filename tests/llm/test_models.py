"""The trained models and the index: held-out accuracy, recall, odd rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardspark.llm.ann import fitted, nearest
from hazardspark.llm.quality import keep_good, quality_scores
from hazardspark.llm.toxicity import toxicity_scores

DATA = "/root/testdata/sf0.1"
needs_data = pytest.mark.skipif(not os.path.exists(DATA), reason="needs the synthetic tables")


def area(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@needs_data
@pytest.mark.parametrize("column", ["quality", "toxic"])
def test_held_out_accuracy(spark, column):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    scores = quality_scores(docs, labels) if column == "quality" else toxicity_scores(docs, labels)
    got = scores.join(labels, "doc_id").filter("held_out").toPandas()
    assert len(got) > 500 and got.score.between(0, 1).all()
    auc = area(got.score.to_numpy(), got[column].to_numpy())
    right = (got.predicted == got[column]).mean()
    print(column, "held out: area under the curve", auc, "accuracy", right, "recall of 1", (got.predicted[got[column] == 1]).mean(), "of 0", (1 - got.predicted[got[column] == 0]).mean())
    assert auc > 0.97 and right > 0.95


def test_models_on_odd_rows(spark):
    rows = [(i, ("good words here " if i % 3 else "BAD!! BAD!! ") * (i % 7 + 1), "en") for i in range(200)]
    docs = spark.createDataFrame([*rows, (None, "good words", None), (900, None, "xx"), (901, "", "en"), (902, "x", "en"), (902, "x", "en")], "doc_id long, text string, lang string")
    docs = docs.withColumn("score", F.lit("clash")).withColumn("label", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(200)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for got in (quality_scores(docs, labels).collect(), toxicity_scores(docs, labels).collect()):
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id == 902}) == 1
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {i for i in range(200) if i % 3}
    none = labels.limit(0)
    assert {r.predicted for r in quality_scores(docs, none).collect()} == {1}
    assert {r.predicted for r in toxicity_scores(docs, none).collect()} == {0}
    assert quality_scores(docs.limit(0), labels).count() == 0 and toxicity_scores(docs.limit(0), labels).count() == 0


@needs_data
def test_recall_of_neighbours(spark):
    for name in ("sf0.01", "sf0.1"):
        vectors = spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet")
        queries = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
        got = nearest(vectors, queries).toPandas()
        table = vectors.orderBy("vec_id").toPandas()
        m = np.stack(table.embedding.to_numpy()).astype(np.float64)
        ids = table.vec_id.to_numpy()
        hits = 0
        for q, own in got.groupby("query_id"):
            score = m @ m[ids == q][0]
            score[ids == q] = -np.inf
            best = np.lexsort((ids, -score))[:20]
            hits += len(set(ids[best]) & set(own.vec_id))
            own = own.sort_values("rank")
            assert list(own["rank"]) == list(range(1, 21)) and (np.diff(own.score) <= 0).all()
        recall = hits / len(got)
        print(name, "recall", recall)
        assert recall >= 0.9


def test_probes_follow_the_data():
    """Clustered vectors need a small share of all visits; independent ones most of them."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(200, 32))
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    clustered = unit(np.repeat(centres, 25, axis=0) + 0.1 * rng.normal(size=(5000, 32)))
    apart = unit(rng.normal(size=(5000, 32)))
    shares = [fitted(m, 1.0 + 1e-9, 10**9, 20)[3] for m in (clustered, apart)]
    print("share of candidates: clustered", shares[0], "independent", shares[1])
    assert shares[0] < 0.1 < shares[1]


def test_ids_that_repeat_with_other_vectors(spark):
    rows = [(i, [float(i), 1.0]) for i in range(30)] + [(5, [1e160, 1.0]), (5, [-3.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    results = [sorted(map(tuple, nearest(v, q, k=3).collect())) for v, q in ((vectors, queries), (vectors.repartition(5), queries.repartition(3)))]
    assert results[0] == results[1] and len(results[0]) == 90
    assert [r[2] for r in results[0] if r[0] == 5] != []


def test_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(30)]  # ties
    rows += [(200, None), (201, [0.0] * 8), (202, [float("nan")] + [1.0] * 7), (203, [None] + [1.0] * 7), (204, [float("inf")] * 8), (205, [1.0]), (None, [1.0] * 8), (5, rows[5][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit("clash")).withColumn("score", F.lit(1))
    queries = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    got = nearest(vectors, queries, k=20).toPandas()
    sound = dict(rows[:90])
    assert set(got.query_id) == set(sound) and (got.groupby("query_id").size() == 20).all()
    m = np.array([sound[i] for i in sound])
    ids = np.array(list(sound))
    score = m @ m[0]
    score[ids == 0] = -np.inf
    order = np.lexsort((ids, -np.round(score, 9)))
    assert list(got[got.query_id == 0].sort_values("rank").vec_id) == list(ids[order][:20])
    copy = got[got.query_id == 105].sort_values("rank")
    score = np.where(ids == 105, -np.inf, m @ sound[105])
    order = np.lexsort((ids, -np.round(score, 9)))
    assert list(copy.vec_id) == list(ids[order][:20])
    few = nearest(vectors.filter("vec_id < 7"), queries.filter("query_id < 7"), k=20).toPandas()
    assert (few.groupby("query_id").size() == 6).all()
    assert nearest(vectors.limit(0), queries).count() == 0
