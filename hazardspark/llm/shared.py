"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (tests), a local one is made and set."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        of = spark.sparkContext._jsc.sc().getCheckpointDir()
        known = of.get() if of.isDefined() else None
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(known)
    return known


def stored(df: DataFrame, name: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends, and a lost executor costs no recomputation.

    batch_rows: rows per Arrow batch at most; fewer where rows are large.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark, batch_rows):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_parts(spark: SparkSession) -> int:
    """How many ways shuffles are dealt in this session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


PART_BYTES = 8 << 20


def part_count(docs: DataFrame) -> int:
    """How many parts of documents to deal: some per core, and as many as keep a part, which a task holds whole, to some megabytes of text."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-total // PART_BYTES))


def dealt(doc_id: Column, n: int) -> Column:
    """The part, of ``n``, that a document belongs to; ``dealt_np`` is its numpy twin."""
    return F.pmod(F.xxhash64(doc_id.cast("long")), F.lit(n).cast("long")).cast("int")


def dealt_np(doc_id: np.ndarray, n: int) -> np.ndarray:
    return np.mod(hash_np(doc_id), n).astype(np.int32)


# The five primes of the public 64-bit xxHash.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def hash_np(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a column of longs."""
    turn = lambda v, r: (v << np.uint64(r)) | (v >> np.uint64(64 - r))
    with np.errstate(over="ignore"):
        h = np.uint64(42 + 8) + P5
        h = turn(h ^ (turn(np.asarray(x).astype(np.int64).view(np.uint64) * P2, 31) * P1), 27) * P1 + P4
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Fewer rows per Arrow batch than by default while a table is written: texts are long, and a task holds a batch several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def with_nulls(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever else the table holds, with a null text as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
