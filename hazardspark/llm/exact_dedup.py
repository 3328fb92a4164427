"""Exact dedup over an extendible-hash index on shared files, in DataFrame operations alone.

The index holds one row per document: a 60-bit key (a hash of the normalised
text), the digest, the length and the doc_id. A directory of key prefixes starts
with one bucket and doubles while a bucket holds more than ``capacity`` rows of
several keys; only overfull buckets split, as deep as it takes. A bucket of one
key that many copies share cannot split and is chained over several pages. The
index is written in key ranges, so a task that reads a file owns a range.

Owners count the rows of each key in their range, page by page. A key of one row
stands alone. The rows of every other key are a chain: their normalised bytes
are compared (grouped by key and text, in each task before the shuffle, so a
text that a third of the rows share moves once per task). Two texts of one key
stay apart.

Results for odd rows: null counts as empty text; empty texts are equal to each
other; of repeated rows (same doc_id, same text) one stays; a null doc_id comes
after all others; texts of any length are compared whole; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import n_parts, stored

SPACES = " \t\n\x0b\f\r"
KEY_BITS = 60
HOT_SHARE = 1024  # keys with over 1/1024 of the rows; there are fewer than 1024 of them


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), SPACES, "")


def key_of(norm: Column) -> Column:
    """The index key of a normalised text."""
    return F.shiftrightunsigned(F.xxhash64(norm), 64 - KEY_BITS)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_code, norm and key, for each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.length(text).alias("n_code"), normalised(F.col("text")).alias("norm"))
    return rows.withColumn("key", key_of(F.col("norm")))


def placed(entries: DataFrame, capacity: int) -> DataFrame:
    """``entries`` (with key) with bucket, the least key of its range, and pages.

    Keys are counted per prefix at a depth that follows from the number of rows;
    coarser depths are sums of these cells, and only rows of cells that are
    still overfull are counted again further down.
    """
    total = entries.count()
    todo, parts, low = entries, [], 0
    high = min(KEY_BITS, max(1, math.ceil(math.log2(max(1, total / capacity))) + 2))
    while True:
        cell = F.shiftright("key", KEY_BITS - high)
        cells = todo.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"), F.max("key").alias("most"))
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
        sums = levels.groupBy("depth", "prefix").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
        fits = (F.col("n") <= capacity) | (F.col("least") == F.col("most")) | (F.col("depth") == KEY_BITS)
        ends = sums.select("depth", "prefix", F.when(fits, F.struct("depth", "prefix", "n")).alias("s"))
        found = stored(levels.select("cell", "depth", "prefix").join(ends, ["depth", "prefix"]).groupBy("cell").agg(F.min("s").alias("s")), "directory")
        done = todo.withColumn("cell", cell).join(found.filter("s is not null"), "cell")
        bucket = F.expr(f"shiftleft(s.prefix, {KEY_BITS} - s.depth)")
        parts.append(done.select(*entries.columns, bucket.alias("bucket"), F.ceil(F.col("s.n") / capacity).alias("pages")))
        overfull = found.filter("s is null").select("cell")
        if high == KEY_BITS or overfull.isEmpty():
            break
        todo = todo.withColumn("cell", cell).join(overfull, "cell", "left_semi").drop("cell")
        low, high = high + 1, min(KEY_BITS, high + 8)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def build_index(docs: DataFrame, capacity: int = 100_000) -> DataFrame:
    """The index as a table of the shared folder, in key ranges: bucket, page, key, text_sha256, n_code, doc_id."""
    digest = F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")
    entries = stored(_rows(docs).select("doc_id", "n_code", digest, "key"), "entries")
    paged = placed(entries, capacity).withColumn("page", F.pmod(F.xxhash64("doc_id", "n_code"), F.col("pages")).cast("int"))
    paged = paged.select("bucket", "page", "key", "text_sha256", "n_code", "doc_id")
    # by doc_id as well, so that the copies of one text may fill several files
    owned = paged.repartitionByRange(n_parts(docs.sparkSession), "bucket", "page", "key", "doc_id").sortWithinPartitions("bucket", "page", "key")
    return stored(owned, "index")


def _chains(docs: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different texts of every key of several rows, and one row per such key.

    texts: key, norm, group_size, keep_id, keep_code. keys: the same figures,
    and clash: whether the key stands for several texts.
    """
    counted = index.groupBy("bucket", "page", "key").agg(F.count(F.lit(1)).alias("n"))
    shared = stored(counted.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key"), "shared-keys")
    alike = _rows(docs).join(shared, "key", "left_semi").groupBy("key", "norm", "n_code").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("id"))
    first = F.max_by("id", "n_code").alias("keep_id")
    texts = stored(alike.groupBy("key", "norm").agg(F.sum("n").alias("group_size"), first, F.max("n_code").alias("keep_code")), "chains")
    keys = texts.groupBy("key").agg((F.count(F.lit(1)) > 1).alias("clash"), *[F.min(c).alias(c) for c in ("group_size", "keep_id", "keep_code")])
    return texts, stored(keys, "chained-keys")


def resolve(docs: DataFrame, index: DataFrame) -> DataFrame:
    """One row per different row of the index: text_sha256, doc_id, n_code, repeats, group_size, keep_id, and whether it stays."""
    texts, keys = _chains(docs, index)
    spot = ["key", "text_sha256", "doc_id", "n_code"]
    rows = index.groupBy(*spot).agg(F.count(F.lit(1)).cast("int").alias("repeats"))
    total = index.count()
    hot = F.broadcast(keys.filter(F.col("group_size") * HOT_SHARE > total))  # under HOT_SHARE rows
    cold = keys.join(hot.select("key"), "key", "left_anti")
    known = rows.join(hot, "key", "left")
    warm = known.filter("clash is not null")
    rest = known.filter("clash is null").drop("clash", "group_size", "keep_id", "keep_code").join(cold, "key", "left")
    out = warm.unionByName(rest)
    alone = F.col("clash").isNull()
    size = F.when(alone, F.col("repeats").cast("long")).otherwise(F.col("group_size"))
    keep, code = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")), F.when(alone, F.col("n_code")).otherwise(F.col("keep_code"))
    told = out.filter(alone | ~F.col("clash")).select(*spot, "repeats", size.alias("group_size"), keep.alias("keep_id"), code.alias("keep_code"))
    if not keys.filter("clash").isEmpty():
        both = _rows(docs).join(keys.filter("clash").select("key"), "key", "left_semi").join(texts, ["key", "norm"])
        digest = F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")
        apart = both.groupBy("key", digest, "doc_id", "n_code", "group_size", "keep_id", "keep_code").agg(F.count(F.lit(1)).cast("int").alias("repeats"))
        told = told.unionByName(apart)
    return told.withColumn("stays", (F.col("n_code") == F.col("keep_code")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_dedup(docs: DataFrame, capacity: int = 100_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are so without space, tab, LF, VT, FF and CR. The
    row with the most code points stays, then the one of smallest doc_id.
    """
    found = resolve(docs, build_index(docs, capacity))
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), "repeats")))
    return each.select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, capacity: int = 100_000) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = resolve(docs, build_index(docs, capacity))
    stay = stored(found.filter("stays").select(F.col("doc_id").alias("__stay_id"), F.col("text_sha256").alias("__stay_sha"), F.col("n_code").alias("__stay_code"), "repeats"), "stay")
    digest = F.sha2(normalised(docs["text"]).cast("binary"), 256)
    length = F.length(F.coalesce(docs["text"].cast("string"), F.lit("")))
    here = docs["doc_id"].eqNullSafe(F.col("__stay_id")) & (digest == F.col("__stay_sha")) & (length == F.col("__stay_code"))
    single = docs.join(stay.filter("repeats = 1"), here, "left_semi")
    repeated = stay.filter("repeats > 1")
    if repeated.isEmpty():
        return single
    again = docs.join(repeated, here, "left_semi")
    columns = again.columns
    one = again.withColumn("__digest", F.sha2(normalised(again["text"]).cast("binary"), 256)).dropDuplicates(["doc_id", "__digest"])
    return single.unionByName(one.select(*[F.col(f"`{c}`") for c in columns]))


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_code,
         sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY n_code DESC, doc_id NULLS LAST) AS place
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_code DESC, doc_id NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM k
"""
