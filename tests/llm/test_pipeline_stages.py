"""Every stage on odd rows and on an empty table, and what each keeps, against plain Python."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

SPACE = re.compile(r"[\x20\x09-\x0D]")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    good = [(i, " ".join(f"good{(i * 7 + j) % 97}" for j in range(30)), "en", "ab"[i % 2], 1) for i in range(60)]
    bad = [(100 + i, "BUY!! NOW!! " * (i % 5 + 2), "en", "b", 1) for i in range(60)]
    odd = [(None, "good1 good2 good3", None, None, None), (300, None, "en", None, 0), (301, "", None, "a", 0), (302, " \t", "en", "b", 2), (303, good[3][1] + " ", "en", "a", 1), (304, good[4][1], "de", "c", 1)]
    return good + bad + odd + [good[5], good[5], (305, "good3 good4 " * 60_000, "en", "a", 1)]


def test_stages_on_odd_rows(spark, tmp_path):
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(60)] + [(None, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows(), SCHEMA).withColumns({c: F.lit("clash") for c in ("key", "size", "rate", "copies", "part", "score", "component_id", "piece")})
    before, held = docs, []
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        after = stage(spark, before, str(tmp_path)).persist()
        held.append(after)
        kept = [r.asDict() for r in after.collect()]
        if name == "packing":
            assert {r["doc_id"] for r in kept} == {r.doc_id for r in before.select("doc_id").collect()}
            break
        assert after.columns == docs.columns, name
        told = [r.asDict() for r in before.collect()]
        assert all(r in told for r in kept), name
        if name == "quality":
            assert {r["doc_id"] for r in kept} >= set(range(60)) and not {r["doc_id"] for r in kept} & set(range(100, 160))
        if name == "exact duplicates":
            groups: dict = {}
            for r in told:
                groups.setdefault(SPACE.sub("", r["text"] or ""), []).append((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
            assert sorted((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == sorted(min(g) for g in groups.values())
        before = after
    for df in held:
        df.unpersist()
