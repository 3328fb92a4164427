"""From station rows to the rows of an analysis, guarded in a fixed order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..config import Settings
from ..errors import AlgorithmError, PrivacyViolation, UserInputError
from ..functions.keys import Key
from ..operators import guards
from ..operators.encode import coerce_numbers, complete, encode, group_masks, q, recode_outcome, selected
from ..operators.times import bin_times, clamp_tail, event_counts, merge_small, move_events, settings_frame, tail_cuts
from ..request import FitRequest


def site_ids(found: list, df: DataFrame, request: FitRequest) -> list[int]:
    """The sites of a request; all that the table has if it names none. found: rows with the sites that have rows."""
    known = sorted(r.site for r in found if r.site is not None)
    if request.sites is None:
        if not known:
            raise UserInputError("the table holds no site")
        return known
    unknown = sorted(set(request.sites) - set(known))
    if unknown:
        known = sorted(r[0] for r in df.select("site").distinct().collect() if r[0] is not None)
        raise UserInputError(f"unknown sites {unknown}; known are {known}")
    return list(request.sites)


def coded(df: DataFrame, request: FitRequest, key: Key | None = None) -> DataFrame:
    """All rows, coerced, recoded and encoded, and _keep: that a row is selected and complete. site must be a column.

    The order matters: selection sees recoded times, and nothing is counted
    but rows to keep. They are marked, not filtered, so that one pass counts
    them and finds the sites, and no condition is computed twice.
    """
    missing = [c for c in request.columns if c not in df.columns]
    if missing:
        raise UserInputError(f"column '{missing[0]}' is not in the table")
    df = df.select("site", *[q(c) for c in request.columns])
    df = coerce_numbers(df, [request.time])
    df = coerce_numbers(df, request.covariates.plain)
    df = recode_outcome(df, request.outcome, request.codes) if request.codes else _outcome(df, request.outcome)
    df, admits = selected(df, request.selection)
    df = df.withColumn("_keep", admits)
    df = encode(df, request.covariates, key)
    guards.check_terms(df, request.covariates, request.time, request.outcome)
    return df.withColumn("_keep", F.col("_keep") & complete(df, [request.time, request.outcome, *request.covariates.terms]))


def clean(df: DataFrame, request: FitRequest, key: Key | None = None) -> DataFrame:
    """Rows of the analysis: coerced, recoded, selected, encoded, complete."""
    return coded(df, request, key).filter("_keep").drop("_keep")


def _outcome(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, q(name).cast("int")) if dict(df.dtypes)[name] == "boolean" else df


@dataclass
class Prepared:
    """rows: site, time, event, x0..; cut but not moved. groups: conditions of categories, as 0/1 columns k0.. .

    merged: the time under which each event time of a site is released. widest: a power of two that no value
    of each term is over. n_rows: of the largest site.
    """

    rows: DataFrame
    n_terms: int
    n_groups: int
    sites: list[int]
    settings: dict[int, Settings]
    knobs: DataFrame
    counts: DataFrame
    merged: DataFrame
    widest: list[float]
    n_rows: int

    @property
    def moved(self) -> DataFrame:
        """Rows for risk sets: events stand at the times under which they are released."""
        # the cap of the grid bounds what a site has in merged; rows must not move for it
        return move_events(self.rows, F.broadcast(self.merged)) if any(s.time_events > 1 for s in self.settings.values()) else self.rows

    @property
    def released_counts(self) -> DataFrame:
        return self.merged.groupBy("site", F.col("merged").alias("time")).agg(F.sum("freq").alias("freq"))


def plain_rows(df: DataFrame, request: FitRequest) -> DataFrame:
    """site, time, event, x0.. and, for each category, k0.. (0 or 1)."""
    return _narrow(df, request).withColumn("event", F.col("event").cast("int"))


def _narrow(df: DataFrame, request: FitRequest, *more: str) -> DataFrame:
    terms = [q(t).cast("double").alias(f"x{i}") for i, t in enumerate(request.covariates.terms)]
    masks = [m.cast("int").alias(f"k{i}") for i, (_, m) in enumerate(group_masks(request.covariates))]
    return df.select(F.col("site").cast("long").alias("site"), q(request.time).cast("double").alias("time"), q(request.outcome).cast("double").alias("event"), *terms, *masks, *more)


@contextmanager
def prepare(
    df: DataFrame,
    request: FitRequest,
    settings: Settings | dict[int, Settings] | Callable[[int], Settings],
    row_hook: Callable[[DataFrame], DataFrame] | None = None,
    key: Key | None = None,
    grid_cap: int = 1000,
    copies: int = 1,
    copied: Callable[[int | Column, int | Column], int | Column] | None = None,
) -> Iterator[Prepared]:
    """All checks and time guards of a fit; what is cached is given up in the end, whatever happens.

    One query counts, and fills the cache of rows while it does; the rest is left to the first query that needs it.

    row_hook may only take rows away; it runs before anything is counted, and
    after the columns are checked, so it cannot hide what is wrong with them.

    copies: the analysis takes each row as often, at the site that ``copied`` makes of its own and the copy's number
    (both numbers or columns). Rows are cached and counted once, before; each copy then has partitions of its own, so no
    task holds several.
    """
    held: list[DataFrame] = []

    def keep(x: DataFrame) -> DataFrame:
        held.append(x.persist())
        return x

    try:
        asked = df if request.sites is None else df.filter(F.col("site").isin(list(request.sites)))
        ready = coded(asked, request, key)
        guards.check_schema(ready, request.time, request.outcome)
        n_groups = len(group_masks(request.covariates))
        masks = [F.col(f"k{i}") == 1 for i in range(n_groups)]
        n_terms = len(request.covariates.terms)
        counted = lambda x: guards.sizes(x, "time", "event", request.covariates, F.col("_keep"), masks, n_terms).collect()
        narrow = keep(_narrow(ready, request, "_keep"))
        found = counted(narrow)
        guards.check_values(found, request.time, request.outcome)
        sites = site_ids(found, df, request)
        if row_hook is not None:
            narrow = keep(_narrow(row_hook(ready.filter("_keep").drop("_keep")), request).withColumn("_keep", F.lit(True)))
            found = counted(narrow)
        if copies > 1:
            found = [Row(**r.asDict() | {"site": copied(r.site, i)}) for i in range(copies) for r in found]
            sites = sorted(copied(s, i) for i in range(copies) for s in sites)
            # a product with a partition per copy: neither side moves, and the plan does not grow with the copies
            each = df.sparkSession.range(0, copies, 1, copies).select(F.col("id").alias("_copy")).hint("shuffle_replicate_nl")
            narrow = narrow.crossJoin(each).withColumn("site", copied(F.col("site"), F.col("_copy"))).drop("_copy")
        if callable(settings):
            settings = {s: settings(s) for s in sites}
        by = settings if isinstance(settings, dict) else dict.fromkeys(sites, settings)
        absent = [s for s in sites if s not in by]
        if absent:
            raise AlgorithmError(f"no settings for site {absent[0]}")
        by = {s: by[s] for s in sites}
        guards.check_sizes(found, sites, request.covariates, by)
        own = {r.site: r for r in found if r.site in by}
        knobs = settings_frame(df.sparkSession, by)
        rows = narrow.filter("_keep").drop("_keep").withColumn("event", F.col("event").cast("int"))
        if any(s.bin_width for s in by.values()):
            width = rows.join(F.broadcast(knobs.select("site", "bin_width")), "site")
            rows = width.withColumn("time", bin_times(F.col("time"), F.col("bin_width"))).drop("bin_width")
        most = max(s.risk_change for s in by.values())
        if most > 1:
            if any(own[s].rows < k.risk_change for s, k in by.items() if k.risk_change > 1):
                raise PrivacyViolation("a site has fewer rows than the least risk-set change")
            rows = clamp_tail(rows, keep(tail_cuts(rows, knobs, most)))
        widest, n_rows = [max(r[f"w{i}"] for r in own.values()) for i in range(n_terms)], max(r.rows for r in own.values())
        counts = keep(event_counts(rows, n_terms, widest, n_rows))
        many = counts.select("site", "time", "freq").join(F.broadcast(knobs.select("site", "time_events")), "site")
        merged = keep(merge_small(many, F.col("time_events"), grid_cap))
        yield Prepared(rows, n_terms, n_groups, sites, by, knobs, counts, merged, widest, n_rows)
    finally:
        for x in held:
            x.unpersist()
