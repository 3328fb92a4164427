"""Station tables and result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_station(spark: SparkSession, path: str, site: int, schema: StructType | str | None = None) -> DataFrame:
    """One station's table with its site; CSV needs a schema, Parquet has its own."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        if schema is None:
            raise ValueError("a CSV station is read with a schema, not a guess")
        df = spark.read.csv(path, schema=schema, header=True)
    return df.withColumn("site", F.lit(site).cast("long"))


def read_stations(spark: SparkSession, paths: dict[int, str], schema: StructType | str | None = None) -> DataFrame:
    """All stations as one table; a column that a station lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read_station(spark, p, s, schema) for s, p in paths.items()])


def write_partitioned(df: DataFrame, path: str) -> None:
    """A table partitioned by site, so that a request for some sites reads only theirs."""
    df.write.mode("overwrite").partitionBy("site").parquet(path)
