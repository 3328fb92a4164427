"""Survival cohorts derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line: site (region of the customer), time (quantity), event (returned), covariates.

    The dimension tables follow from the keys; Spark broadcasts those that are
    small enough by their measured size.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lines = read("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_discount", "l_tax")
    orders = read("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = read("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = read("nation").select("n_nationkey", "n_regionkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("n_regionkey").cast("long").alias("site"),
        F.col("l_quantity").cast("double").alias("time"),
        (F.col("l_returnflag") == "R").cast("int").alias("event"),
        F.col("l_discount").cast("double").alias("x1"),
        F.col("l_tax").cast("double").alias("x2"),
        F.col("c_mktsegment").alias("seg"),
        F.col("o_orderpriority").alias("prio"),
        F.col("l_returnflag").alias("flag"),
    )


SHIPMENTS_SQL = """shipments AS (
  SELECT n_regionkey::BIGINT AS site, l_quantity::DOUBLE AS time, (l_returnflag = 'R')::INTEGER AS event,
         l_discount::DOUBLE AS x1, l_tax::DOUBLE AS x2, c_mktsegment AS seg, o_orderpriority AS prio, l_returnflag AS flag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event with a successor: site (user modulo 3), time (hours to the user's next event), event (that is a purchase), value."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    nexts = events.withColumn("next_ts", F.lead("ts").over(order)).withColumn("next_type", F.lead("event_type").over(order))
    return nexts.filter("next_ts is not null").select(
        F.pmod("user_id", F.lit(3)).cast("long").alias("site"),
        ((micros(F.col("next_ts")) - micros(F.col("ts"))).cast("double") / F.lit(3.6e9)).alias("time"),
        (F.col("next_type") == "purchase").cast("int").alias("event"),
        F.col("value").cast("double").alias("value"),
    )


LAGS_SQL = """lags AS (
  SELECT site, time, event, value FROM (
    SELECT (user_id % 3)::BIGINT AS site,
           (epoch_us(lead(ts) OVER w) - epoch_us(ts))::DOUBLE / 3.6e9::DOUBLE AS time,
           (lead(event_type) OVER w = 'purchase')::INTEGER AS event, value::DOUBLE AS value
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE time IS NOT NULL)"""


# The true coefficients, the hazard and the end of censoring of the simulated study.
TRUTH = {"x1": 0.5, "x2": -0.3}
HAZARD, CENSORED_BY = 0.02, 60.0
REPETITIONS, NODES = 2, 3


def _uniform(salt: str):
    """A number in (0, 1) per order line, from the first 32 bits of a digest of its key."""
    digest = F.md5(F.concat(F.lit(salt), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with survival times drawn from a known model: repetition, site, time (to a tenth), event, x1, x2.

    Discount and tax, standardised, are the covariates; exponential times follow them with the coefficients of TRUTH, and
    censoring is uniform. All draws are digests of the line's key, so the cohort is the same in every engine.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    x1, x2 = (F.col("l_discount").cast("double") - 0.05) / 0.0316, (F.col("l_tax").cast("double") - 0.04) / 0.0258
    ends = -F.log(_uniform("event")) / (F.lit(HAZARD) * F.exp(F.lit(TRUTH["x1"]) * F.col("x1") + F.lit(TRUTH["x2"]) * F.col("x2")))
    drawn = lines.withColumns({"x1": x1, "x2": x2}).withColumns({"ends": ends, "leaves": _uniform("censoring") * CENSORED_BY})
    return drawn.select(
        F.pmod("l_orderkey", F.lit(REPETITIONS)).cast("int").alias("repetition"),
        F.pmod(F.expr(f"l_orderkey div {REPETITIONS}"), F.lit(NODES)).cast("long").alias("site"),
        (F.floor(F.least("ends", "leaves") * 10).cast("double") / 10).alias("time"),
        (F.col("ends") <= F.col("leaves")).cast("int").alias("event"),
        "x1",
        "x2",
    )


def _uniform_sql(salt: str) -> str:
    return f"((('0x' || substr(md5('{salt}' || l_orderkey || '/' || l_linenumber), 1, 8))::BIGINT)::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE"


SIMULATED_SQL = f"""simulated AS MATERIALIZED (
  SELECT (l_orderkey % {REPETITIONS})::INTEGER AS repetition, (l_orderkey // {REPETITIONS} % {NODES})::BIGINT AS site,
         floor(least(ends, leaves) * 10) / 10.0::DOUBLE AS time, (ends <= leaves)::INTEGER AS event, x1, x2 FROM (
    SELECT *, -ln({_uniform_sql("event")}) / ({HAZARD}::DOUBLE * exp({TRUTH["x1"]}::DOUBLE * x1 + {TRUTH["x2"]}::DOUBLE * x2)) AS ends, {_uniform_sql("censoring")} * {CENSORED_BY}::DOUBLE AS leaves FROM (
      SELECT l_orderkey, l_linenumber, (l_discount::DOUBLE - 0.05::DOUBLE) / 0.0316::DOUBLE AS x1, (l_tax::DOUBLE - 0.04::DOUBLE) / 0.0258::DOUBLE AS x2 FROM lineitem)))"""
