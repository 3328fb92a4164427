"""A training-data pipeline over ``documents``: quality, exact and near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the docs of the next. All but the last return the
columns of ``documents``.

Results for odd rows: a null text is an empty one; a null doc_id is kept like
any other by quality, mixing and packing, comes last among exact copies, and is
never a near duplicate; of repeated rows one stays after exact duplicates, and
rows that share a doc_id but not a text stay or go together as near duplicates;
texts of any length are read whole; ties go to the smallest doc_id; other columns
pass through; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hazardspark.llm.exact_dedup import keep_first
from hazardspark.llm.mixing import mix_documents
from hazardspark.llm.ngram_join import jaccard_components
from hazardspark.llm.packing import pack_documents
from hazardspark.llm.quality import keep_good
from hazardspark.llm.shared import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest doc_id, of each group linked by sets of five-word shingles of a similarity of 0.8 or more."""
    found = jaccard_components(docs, size=5, percent=80)
    others = stored(found.filter("doc_id <> component_id").select("doc_id").distinct(), "others")
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in a training sequence."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("exact duplicates", exact_duplicates),
    ("near duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold exact and near duplicates and the packed ids against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
