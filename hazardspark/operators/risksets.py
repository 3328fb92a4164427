"""Risk-set sums over an event-time grid, and the guards on what a site releases.

A row is at risk at every grid point up to its time. Instead of joining rows
with the grid points they are at risk at, each row gets the last such point as
its slot, rows are summed per (site, slot), and the sums are accumulated from
the last slot backwards. Slots are set once; every evaluation is then one
partial aggregation to at most (sites x grid points) rows. Sums do not depend on
how rows are partitioned (``functions.exact``), so neither does what is released.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import WIRE_FIGURES
from ..functions.exact import exact_sums
from ..functions.rounding import round_figures
from ..functions.scan import scanned

BLOCK_SUMS = 24  # sums of one aggregation, twice as many columns; more go to further ones, which compiled code still holds


def as_of(time: Column, grid: Column, points: int) -> Column:
    """The index of the largest grid time up to ``time``, -1 before the first; grid: an ascending array of at most ``points``.

    A search in halving steps.
    """
    steps = [1 << i for i in range(max(points, 1).bit_length() - 1, -1, -1)]
    further = lambda at, s: F.when((at + s <= F.size(grid)) & (F.get(grid, at + s - 1) <= time), at + s).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further) - 1


def assign_slots(rows: DataFrame, grid: list[float]) -> DataFrame:
    """``rows`` with slot: the index of the last grid time up to ``time``, -1 before the first."""
    # one text, which Spark makes one array of when it plans; a literal per time would have to be analysed and compiled
    points = F.split(F.lit(",".join(repr(float(t)) for t in grid)), ",") if grid else F.array()
    return rows.withColumn("slot", as_of(F.col("time").cast("double"), points.cast("array<double>"), len(grid)))


def names(terms: int) -> list[str]:
    """s0, s1_i and s2_i_j for i <= j."""
    return ["s0", *[f"s1_{i}" for i in range(terms)], *[f"s2_{i}_{j}" for i in range(terms) for j in range(i, terms)]]


@dataclass(frozen=True)
class Bounds:
    """No weight is over ``weight``, no term over ``terms``, in absolute value, and there are ``n`` rows at most."""

    weight: float
    terms: tuple[float, ...]
    n: int

    def of(self, name: str) -> float:
        out = self.weight
        for i in name.split("_")[1:]:
            out *= self.terms[int(i)]
        return out

    @classmethod
    def found(cls, rows: DataFrame) -> Bounds:
        """By one pass over rows with _w, _x0, ..."""
        p = sum(c.startswith("_x") for c in rows.columns)
        most = rows.agg(*[F.max(F.abs(c)) for c in ["_w", *[f"_x{i}" for i in range(p)]]], F.count(F.lit(1))).first()
        return cls(most[0] or 1.0, tuple(x or 1.0 for x in most[1:-1]), most[-1])


def slot_sums(rows: DataFrame, xs: list[Column], weight: Column, groups: list[Column] = [], bounds: Bounds | None = None) -> DataFrame:  # noqa: B006
    """Per (site, slot): n, ng_k for each group, and the weighted sums of ``names``. Without ``bounds`` a pass looks for them."""
    rows = rows.filter("slot >= 0").withColumns({"_w": weight, **{f"_x{i}": x for i, x in enumerate(xs)}})
    bounds = bounds or Bounds.found(rows)
    p = len(xs)
    products = ["_w", *[f"(_w * _x{i})" for i in range(p)], *[f"(_w * _x{i} * _x{j})" for i in range(p) for j in range(i, p)]]
    named = [(c, e, bounds.of(c)) for c, e in zip(names(p), products)]
    counts = [F.count(F.lit(1)).alias("n"), *[F.count_if(g).alias(f"ng_{k}") for k, g in enumerate(groups)]]
    kept = ["n", *[f"ng_{k}" for k in range(len(groups))]]
    sums, joined = exact_sums(named[:BLOCK_SUMS], bounds.n)
    out = rows.groupBy("site", "slot").agg(*counts, *sums).select("site", "slot", *kept, *joined)
    if len(named) <= BLOCK_SUMS:
        return out
    # further blocks meet as arrays, by a union and not by joins, whose planning grows out of hand with so many columns
    first = [c for c, *_ in named[:BLOCK_SUMS]]
    blocks = out.select("site", "slot", *kept, F.lit(0).alias("block"), F.array(*first).alias("part"))
    for lo in range(BLOCK_SUMS, len(named), BLOCK_SUMS):
        sums, joined = exact_sums(named[lo : lo + BLOCK_SUMS], bounds.n)
        more = rows.groupBy("site", "slot").agg(*sums).select("site", "slot", F.lit(lo // BLOCK_SUMS).alias("block"), F.array(*joined).alias("part"))
        blocks = blocks.unionByName(more, allowMissingColumns=True)
    together = blocks.groupBy("site", "slot").agg(*[F.max(c).alias(c) for c in kept], F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda x: x["part"])).alias("all"))
    return together.selectExpr("site", "slot", *kept, *[f"get(all, {i}) AS {c}" for i, (c, *_) in enumerate(named)])


def at_risk(sums: DataFrame, sites: DataFrame, n_slots: int | None = None, keep: tuple[str, ...] = (), times: str | None = None) -> DataFrame:
    """Sums over all rows at risk, for every site and slot; ``sites`` has a column site, and n_slots if that differs by site.

    keep: further columns of ``sites``. times: one of them by which the sums are multiplied.

    Accumulated in the order of slots, so alike in every run.
    """
    values = [c for c in sums.columns if c not in ("site", "slot")]
    by = f" * {times}" if times else ""
    last = F.col("n_slots") - 1 if n_slots is None else F.lit(n_slots - 1)
    every = sites.select("site", *keep, F.explode(F.sequence(F.lit(0), last)).alias("slot"))
    back = "over (partition by site order by slot desc rows between unbounded preceding and current row)"
    total = [f"sum(coalesce(`{c}`, 0)) {back}{by} as `{c}`" for c in values]
    return every.join(sums, ["site", "slot"], "left").selectExpr("site", "slot", *keep, *total)


def effective_slots(risk: DataFrame, settings: DataFrame, n_groups: int = 0) -> DataFrame:
    """site, slot, effective: the slot whose risk set a site releases at each slot.

    The first slot is always released. A later one is held back, at what was
    released before, while the risk set has lost some rows but fewer than k, is
    smaller than the floor, or either is so for a category or for the rest
    beside it. It depends on counts alone, so it is the same in every
    evaluation of a fit.
    """
    counts = F.struct("slot", "n", F.array(*[F.col(f"ng_{k}") for k in range(n_groups)]).cast("array<long>").alias("g"))
    packed = risk.groupBy("site").agg(F.array_sort(F.collect_list(counts)).alias("all"))
    packed = packed.join(F.broadcast(settings.select("site", "risk_change", "risk_size")), "site")
    k, floor = F.col("risk_change"), F.col("risk_size")
    first = F.element_at("all", 1)
    start = F.struct(F.lit(0).alias("h"), first["n"].alias("n"), first["g"].alias("g"))

    def few(lost: Column) -> Column:
        return (lost > 0) & (lost < k)

    def low(size: Column) -> Column:
        return F.coalesce(size < floor, F.lit(False))

    def step(state, x):
        lost = state["n"] - x["n"]
        hold = few(lost) | low(x["n"])
        if n_groups:
            pairs = F.arrays_zip(state["g"].alias("was"), x["g"].alias("now"))
            hold = hold | F.exists(pairs, lambda p: few(p["was"] - p["now"]) | few(lost - (p["was"] - p["now"])) | low(p["now"]) | low(x["n"] - p["now"]))
        hold = hold & (k > 1)
        own = F.when(hold, state["h"]).otherwise(x["slot"])
        return F.struct(own.alias("h"), F.when(hold, state["n"]).otherwise(x["n"]).alias("n"), F.when(hold, state["g"]).otherwise(x["g"]).alias("g")), own

    rest = F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0)))
    walked = packed.select("site", F.concat(F.array(F.lit(0)), scanned(rest, start, step, "int")["out"]).alias("out"))
    return walked.select("site", F.posexplode("out").alias("slot", "effective"))


def released(risk: DataFrame, effective: DataFrame, settings: DataFrame, terms: int) -> DataFrame:
    """What each site releases per slot: held sums, rounded as it is set, then to what the exchange carries.

    settings: with site and figures, unless ``risk`` has the latter.
    """
    held = risk.withColumnRenamed("slot", "effective").join(effective, ["site", "effective"])
    if "figures" not in held.columns:
        held = held.join(F.broadcast(settings.select("site", "figures")), "site")
    own = F.transform(F.array(*names(terms)), lambda x: round_figures(x, F.col("figures")))
    sent = F.transform(own, lambda x: round_figures(x, WIRE_FIGURES))
    kept = [c for c in risk.columns if c not in ("site", "slot", "n", *names(terms)) and not c.startswith("ng_")]
    return held.select("site", "slot", *kept, sent.alias("sums")).selectExpr("site", "slot", *kept, *[f"get(sums, {i}) AS {c}" for i, c in enumerate(names(terms))])


def pooled(release: DataFrame, terms: int, by: list[str] = [], bounds: Bounds | None = None, scale: str | None = None, sites: int = 1) -> DataFrame:  # noqa: B006
    """Sums of all sites per (by, slot), and odd: a site whose released sizes no risk sets can have (null: none).

    bounds, scale: of what ``release`` sums, the latter a power of two; with them the sums over ``sites`` are exact.
    """
    order = Window.partitionBy("site").orderBy("slot")
    s0, before = F.col("s0"), F.lag("s0").over(order)
    odd = s0.isNull() | F.isnan(s0) | (F.abs(s0) == float("inf")) | (s0 < 0) | F.coalesce(s0 > before, F.lit(False)) | ((F.col("slot") == 0) & (s0 <= 0))
    checked = release.withColumn("odd", F.when(odd, F.col("site")))
    if bounds is None:
        return checked.groupBy(*by, "slot").agg(*[F.sum(c).alias(c) for c in names(terms)], F.min("odd").alias("odd"))
    # a released sum has as many addends as its site has rows, and may be rounded up
    sums, joined = exact_sums([(c, c, 2.0 * bounds.n * bounds.of(c)) for c in names(terms)], sites, scale)
    return checked.groupBy(*by, "slot").agg(*sums, F.min("odd").alias("odd")).select(*by, "slot", *joined, "odd")


def held_event_share(release: DataFrame, counts: DataFrame, settings: DataFrame) -> DataFrame:
    """site, share: events at slots past the first that were released with the first risk set, over all events.

    release: site, slot, s0 at weight 1; counts: site, slot, freq. 0 where k is up to 1.
    """
    first = F.first_value("s0").over(Window.partitionBy("site").orderBy("slot"))
    both = release.select("site", "slot", "s0", first.alias("first")).join(counts, ["site", "slot"], "left")
    freq = F.coalesce("freq", F.lit(0))
    held = F.sum(F.when((F.col("slot") > 0) & (F.col("s0") == F.col("first")), freq).otherwise(0))
    shares = both.groupBy("site").agg(held.alias("held"), F.sum(freq).alias("total"))
    guarded = F.col("risk_change") > 1
    return shares.join(F.broadcast(settings.select("site", "risk_change")), "site").select(
        "site", F.when(guarded & (F.col("total") > 0), F.col("held") / F.col("total")).otherwise(F.lit(0.0)).alias("share")
    )
