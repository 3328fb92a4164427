"""The queries that SQL expresses, and the pipeline, on the small tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))

from compare import connect, differences  # noqa: E402

import corpus_pipeline  # noqa: E402
from hazardspark.llm.queries import QUERIES, SQL  # noqa: E402

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="needs the synthetic tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert differences(QUERIES[name](spark, DATA), connect(DATA), SQL[name]) is None


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    start, before, held = docs.columns, docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, DATA).persist()
        assert after.columns == start, name
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        assert {r.doc_id for r in after.select("doc_id").collect()} <= ids
        held.append(after)
        before = after
    packed = corpus_pipeline.run(spark, DATA)
    assert packed.count() > 0 and {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}
    for df in held:
        df.unpersist()
