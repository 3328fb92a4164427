"""Mixing sources to target weights, in DataFrame operations alone.

Words are summed per source; targets follow from the sums; a source's rate is
its target over its sum. Each document is then emitted floor(rate) times plus
once more if a uniform number drawn from a hash of its doc_id is below the
fraction of the rate, so reruns agree and no task needs another's state.

Targets: weights 5, 2, 1 (repeating) go to the sources in code-point order, null
last. Together they share ``total_share`` of all words by weight; no target
exceeds ``cap`` times its source, and what is over is shared again by weight.
That is a common level for words per weight with some sources held at their
cap, so it is found from running sums over the sources in the order in which
they reach their caps.

Results for odd rows: null or empty text has size 0 and is taken 0 words;
a null source is a source; repeated rows draw the same number; a null doc_id
draws as the empty string; other columns are ignored, or kept by
``mix_documents``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

WEIGHTS = (5.0, 2.0, 1.0)
WORD = "[^\\x20\\x09-\\x0D]+"
SEED = "mix-1"
SALTS = 16


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a hash of the id."""
    name = F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sized: DataFrame, total_share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target and rate; one row per source."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int"))
    sums = sums.withColumn("weight", weight).withColumn("top", F.lit(cap) * F.col("source_size"))
    order = Window.orderBy((F.col("top") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    held = F.coalesce(F.sum("top").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    free = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    whole = F.sum("source_size").over(Window.partitionBy(F.lit(0))).cast("double") * F.lit(total_share)
    sums = sums.withColumn("level", (whole - held) / free)
    level = F.max(F.when(F.col("level") <= F.col("top") / F.col("weight"), F.col("level"))).over(Window.partitionBy(F.lit(0)))
    sums = sums.withColumn("target", F.least("top", level * F.col("weight")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return sums.select("source", "source_size", "target", rate.alias("rate"))


def rated(sized: DataFrame, **how) -> DataFrame:
    """``sized`` (doc_id, source, size) with source_size, target and the copies of each document.

    A source may hold a third of all rows, so the join deals every source over
    several tasks.
    """
    known = targets(sized, **how).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    known = known.withColumnRenamed("source", "of_source").withColumnRenamed("salt", "of_salt")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    joined = sized.withColumn("salt", salt).join(known, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("salt") == F.col("of_salt")))
    whole = F.floor("rate")
    extra = F.when(uniform(F.col("doc_id")) < F.col("rate") - whole, 1).otherwise(0)
    return joined.withColumn("copies", (whole + extra).cast("int"))


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), words_of(F.col("text")).alias("size"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted), copies."""
    sized = stored(sizes(docs), "sizes")
    return rated(sized, **how).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken."""
    known = stored(targets(stored(sizes(docs), "sizes"), **how).select(F.col("source").alias("__of_source"), F.col("rate").alias("__rate")), "rates")
    known = known.withColumn("__of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(docs["doc_id"]), F.lit(SALTS)).cast("int")
    joined = docs.join(known, docs["source"].cast("string").eqNullSafe(F.col("__of_source")) & (salt == F.col("__of_salt")))
    extra = F.when(uniform(docs["doc_id"]) < F.col("__rate") - F.floor("__rate"), 1).otherwise(0)
    copies = (F.floor("__rate") + extra).cast("int")
    taken = joined.withColumn("__of_copy", F.explode(F.array_repeat(F.lit(1), copies)))
    return taken.select(*[docs[c] for c in docs.columns])


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("copies")


OP4_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight,
             2.0::DOUBLE * source_size AS top FROM s),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
                 - coalesce(sum(top) OVER (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT source, source_size, least(top, weight * max(CASE WHEN lev <= top / weight THEN lev END) OVER ()) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM t),
j AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.rate,
             (('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM j
"""
