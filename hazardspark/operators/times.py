"""Time guards: bins, tail cut, merging of small event counts, and the grid.

Rows carry site, time and event. Guards differ by site, so each takes a small
DataFrame of settings (site, bin_width, risk_change, time_events, ...); its
size is the number of sites a request names.
"""

from __future__ import annotations

from dataclasses import fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.exact import exact_sums
from ..functions.scan import scanned

KINDS = {"int": pa.int32(), "float": pa.float64(), "str": pa.string()}


def settings_frame(spark: SparkSession, settings: dict[int, Settings]) -> DataFrame:
    columns = {"site": pa.array(sorted(settings), pa.int64())}
    for f in fields(Settings):
        columns[f.name] = pa.array([getattr(settings[s], f.name) for s in sorted(settings)], KINDS[f.type.split(" ")[0]])
    return spark.createDataFrame(pa.table(columns))


def bin_times(time: Column, width: Column | float | None) -> Column:
    """floor(time / width) * width; without a positive width the time itself."""
    if width is None:
        return time
    width = width if isinstance(width, Column) else F.lit(float(width))
    return F.when(width > 0, F.floor(time / width).cast("double") * width).otherwise(time)


def kth_largest(rows: DataFrame, k: int, value: str = "time", by: str = "site") -> DataFrame:
    """site, cut: the k-th largest value with duplicates counted; no row for a site of fewer rows.

    Spark limits each partition to its k largest rows per site before the
    shuffle, so no site is sorted as a whole.
    """
    order = Window.partitionBy(by).orderBy(F.desc(value))
    top = rows.select(by, value).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return top.filter(F.col("place") == k).select(by, F.col(value).alias("cut"))


def tail_cuts(rows: DataFrame, settings: DataFrame, most: int | None = None) -> DataFrame:
    """site, cut: the k-th largest time of every site whose k is over 1; null where a site has fewer rows. most: the largest k, if known."""
    k = settings.filter("risk_change > 1").select("site", "risk_change")
    most = most or k.agg(F.max("risk_change")).first()[0]
    if most is None:
        return k.select("site", F.lit(None).cast("double").alias("cut"))
    order = Window.partitionBy("site").orderBy(F.desc("time"))
    top = rows.select("site", "time").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    at = top.join(F.broadcast(k), (top["site"] == k["site"]) & (top["place"] == k["risk_change"])).select(top["site"], F.col("time").alias("cut"))
    return k.select("site").join(at, "site", "left")


def clamp_tail(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Times beyond the cut become the cut and are censored; rows at the cut keep their event."""
    cut = rows.join(F.broadcast(cuts), "site", "left")
    late = F.col("cut").isNotNull() & (F.col("time") > F.col("cut"))
    return cut.withColumn("event", F.when(late, 0).otherwise(F.col("event"))).withColumn("time", F.when(late, F.col("cut")).otherwise(F.col("time"))).drop("cut")


def event_counts(rows: DataFrame, n_terms: int = 0, widest: list[float] | None = None, n: int = 0) -> DataFrame:
    """site, time, freq: events at each time; and sums (z0, ...) and sums of squares (q0, ...) of the terms over them.

    widest, n: no term is over the former in absolute value, and there are n rows at most; the sums then are
    exact, in two parts each (the second as z0__low, ...), to be added when all is summed.
    """
    x = [F.col(f"x{i}") for i in range(n_terms)]
    if widest is None:
        sums = [a for i in range(n_terms) for a in (F.sum(x[i]).alias(f"z{i}"), F.sum(x[i] * x[i]).alias(f"q{i}"))]
    else:
        sums, _ = exact_sums([a for i in range(n_terms) for a in ((f"z{i}", f"x{i}", widest[i]), (f"q{i}", f"(x{i} * x{i})", widest[i] ** 2))], n)
    return rows.filter("event = 1").groupBy("site", "time").agg(F.count(F.lit(1)).alias("freq"), *sums)


def merge_small(counts: DataFrame, least: Column | int, most: int | None = None) -> DataFrame:
    """site, time, freq, merged: the time under which each event time is released.

    Times are gathered in ascending order until their events reach ``least``;
    the group is released at its largest time. A rest that stays short joins
    the group before it, or is released alone if there is none. One sorted array
    per site is scanned: its length is that of the site's event times. Sites of
    more than ``most`` groups' worth of times have no row.
    """
    least = least if isinstance(least, Column) else F.lit(least)
    counts = counts.withColumn("least", least)
    packed = counts.groupBy("site").agg(F.max("least").alias("least"), F.array_sort(F.collect_list(F.struct("time", "freq"))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).alias("group"))

    def step(state, x):
        held = state["held"] + x["freq"]
        full = held >= F.col("least")
        after = F.struct(F.when(full, F.lit(0).cast("long")).otherwise(held).alias("held"), (state["group"] + full.cast("int")).alias("group"))
        return after, state["group"]

    within = F.lit(True) if most is None else F.size("all") <= most * F.col("least")
    folded = packed.withColumn("fold", F.when(within, scanned(F.col("all"), start, step, "int")))
    each = folded.select("site", "fold.state.held", "fold.state.group", F.explode(F.when(within, F.arrays_zip("all", F.col("fold.out").alias("g")))).alias("x"))
    each = each.select("site", F.col("x.all.time").alias("time"), F.col("x.all.freq").alias("freq"), F.col("x.g").alias("g"), "held", "group")
    short = (F.col("g") == F.col("group")) & (F.col("held") > 0) & (F.col("group") > 0)
    each = each.withColumn("into", F.when(short, F.col("g") - 1).otherwise(F.col("g")))
    # the time of a group is that of its own members, before a short rest joined it
    last = F.max(F.when(F.col("g") == F.col("into"), F.col("time"))).over(Window.partitionBy("site", "into"))
    return each.withColumn("merged", last).select("site", "time", "freq", "merged")


def suppressed_counts(counts: DataFrame, least: Column | int) -> DataFrame:
    """site, time, freq after merging."""
    return merge_small(counts, least).groupBy("site", F.col("merged").alias("time")).agg(F.sum("freq").alias("freq"))


def move_events(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """Event rows at the time under which their events are released; censored rows keep theirs."""
    known = merged.select(F.col("site").alias("of_site"), F.col("time").alias("of_time"), "merged")
    moved = rows.join(known, (rows["event"] == 1) & (rows["site"] == known["of_site"]) & (rows["time"] == known["of_time"]), "left")
    return moved.withColumn("time", F.coalesce("merged", "time")).drop("of_site", "of_time", "merged")


def pooled_grid(counts: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """time, freq: events of all sites (of one ``by``) at each released time."""
    return counts.groupBy(*by, "time").agg(F.sum("freq").alias("freq"))
