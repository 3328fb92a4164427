"""Sharding by extendible hashing.

A document's place is a 32-bit hash of its doc_id. A directory of hash prefixes
starts with one shard that holds everything; a shard over the byte limit splits
on one more bit, and only such shards do. What cannot split stays as it is: a
single document over the limit, or rows with one hash.

Byte counts are aggregated per prefix at a depth that follows from the total
(some cells per shard), every coarser level is a sum of cells, and only rows of
cells that are still too large are counted again further down. Nothing is
collected but the total.

Results for odd rows: null text counts as empty; a null doc_id hashes as the
empty string; repeated rows share a shard; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

BITS = 32


def shard(docs: DataFrame, limit: int = 16 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, bytes, depth, prefix, shard_bytes, shard_docs.

    (depth, prefix) names the shard: the first ``depth`` bits of the hash.
    """
    place = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")
    size = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long")
    rows = stored(docs.select("doc_id", size.alias("bytes"), place.alias("place")), "places")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    parts, todo, low = [], rows, 0
    high = min(BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + 3))
    while True:
        cell = F.shiftright("place", BITS - high)
        cells = todo.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
        levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
        sums = levels.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | (F.col("depth") == BITS)
        first = F.min(F.when(fits, F.struct("depth", "prefix", "shard_bytes", "shard_docs"))).alias("s")
        leaf = stored(levels.select("cell", "depth", "prefix").join(sums, ["depth", "prefix"]).groupBy("cell").agg(first), "leaves")
        done = todo.withColumn("cell", cell).join(leaf.filter("s is not null"), "cell")
        parts.append(done.select("doc_id", "bytes", "s.depth", "s.prefix", "s.shard_bytes", "s.shard_docs"))
        large = leaf.filter("s is null").select("cell")
        if high == BITS or large.isEmpty():
            break
        todo = todo.withColumn("cell", cell).join(large, "cell", "left_semi").drop("cell")
        low, high = high + 1, min(BITS, high + 6)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS place
  FROM documents),
l AS (SELECT d.*, depth::INTEGER AS depth, place >> ({BITS} - depth)::BIGINT AS prefix FROM d, range(0, {BITS} + 1) r(depth)),
s AS (SELECT *, sum(bytes) OVER w AS shard_bytes, count(*) OVER w AS shard_docs FROM l WINDOW w AS (PARTITION BY depth, prefix)),
f AS (SELECT * FROM s WHERE shard_bytes <= {16 << 20} OR shard_docs = 1 OR depth = {BITS})
SELECT doc_id, bytes, depth, prefix, shard_bytes::BIGINT AS shard_bytes, shard_docs
FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""
