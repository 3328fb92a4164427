"""Validation of columns and thresholds on sizes: one aggregate row per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Settings
from ..errors import PrivacyThresholdViolation, UserInputError
from ..request import Covariates
from .encode import group_masks, q


def _numeric(df: DataFrame, name: str, also_bool: bool = False) -> bool:
    kind = df.schema[name].dataType
    return isinstance(kind, T.NumericType) or also_bool and isinstance(kind, T.BooleanType)


def check_terms(df: DataFrame, covariates: Covariates, time: str, outcome: str) -> None:
    """Sources exist and are not time or outcome; terms exist and are numeric."""
    for name in covariates.columns:
        if name not in df.columns:
            raise UserInputError(f"explanatory variable '{name}' is not a column")
        if name in (time, outcome):
            raise UserInputError(f"explanatory variable '{name}' is the time or outcome column")
    for term in covariates.terms:
        if term not in df.columns or not _numeric(df, term):
            raise UserInputError(f"model term '{term}' is not numeric")


def check_schema(df: DataFrame, time: str, outcome: str) -> None:
    for name, what, flag in ((time, "time", False), (outcome, "outcome", True)):
        if name not in df.columns:
            raise UserInputError(f"{what} column '{name}' is not a column")
        if not _numeric(df, name, flag):
            raise UserInputError(f"{what} column '{name}' is not numeric")


def sizes(df: DataFrame, time: str, outcome: str, covariates: Covariates, where: Column | None = None, masks: list[Column] | None = None, terms: int = 0) -> DataFrame:
    """Per site: rows, events, rows and events of each category (g0, e0, ...), and what is wrong with the columns.

    where: only rows that fulfil it count; sites without one are still told. masks: the categories, by default
    those of ``covariates``. terms: for so many, x0.., the power of two that none is over (w0, ...), nothing finer.
    """
    where = F.lit(True) if where is None else where
    t, e = (F.when(where, q(c).cast("double")) for c in (time, outcome))
    aggs = [
        F.count_if(where).alias("rows"),
        F.count_if(e == 1).alias("events"),
        F.max(F.isnan(t) | (F.abs(t) == float("inf"))).alias("unbounded"),
        F.min(t).alias("first"),
        F.max(~e.isin(0.0, 1.0)).alias("odd_outcome"),
    ]
    for i in range(terms):
        size = F.max(F.when(where, F.abs(F.col(f"x{i}"))))
        aggs.append(F.when(size > 0, F.pow(F.lit(2.0), F.ceil(F.log2(size)) + 1)).otherwise(1.0).alias(f"w{i}"))
    for i, mask in enumerate([m for _, m in group_masks(covariates)] if masks is None else masks):
        aggs += [F.count_if(where & mask).alias(f"g{i}"), F.count_if(where & mask & (e == 1)).alias(f"e{i}")]
    return df.groupBy("site").agg(*aggs)


def check_values(rows: list, time: str, outcome: str) -> None:
    """Times are finite and not negative, outcomes 0 or 1; ``rows`` are those of ``sizes``."""
    if any(r.unbounded for r in rows):
        raise UserInputError(f"time column '{time}' holds infinite values")
    if any(r.first is not None and r.first < 0 for r in rows):
        raise UserInputError(f"time column '{time}' holds negative values")
    if any(r.odd_outcome for r in rows):
        raise UserInputError(f"outcome column '{outcome}' must hold 0 and 1 only")


def large_enough(rows: int, events: int, settings: Settings) -> bool:
    """More rows and events than the threshold, and rows up to the admission bound."""
    return rows > settings.threshold and rows >= settings.admission and events > settings.threshold


def admitted(rows: list, sites: list[int], settings: dict[int, Settings]) -> dict[int, bool]:
    """Which sites are large enough as a whole."""
    by = {r.site: r for r in rows}
    return {s: large_enough(by[s].rows if s in by else 0, by[s].events if s in by else 0, settings[s]) for s in sites}


def check_sizes(rows: list, sites: list[int], covariates: Covariates, settings: dict[int, Settings]) -> None:
    """Every site, then every category at it, is large enough; messages name bounds, never counts."""
    by, whole = {r.site: r for r in rows}, admitted(rows, sites, settings)
    for site in sites:
        own, s = by.get(site), settings[site]
        if not whole[site]:
            raise PrivacyThresholdViolation(f"site {site}: sample size threshold not met (over {s.threshold} rows and events, {s.admission} rows at least)")
        for i, (name, _) in enumerate(group_masks(covariates)):
            if not large_enough(own[f"g{i}"], own[f"e{i}"], s):
                raise PrivacyThresholdViolation(f"site {site}: category '{name}' is too small (over {s.threshold} rows and events, {s.admission} rows at least)")
