"""How far the guards move the estimates: the same rows fitted under several guards, in repetitions, at once."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame

from ..config import Limits, Settings
from ..errors import UserInputError
from .fit import cox_fits

METRICS = "k int, binned boolean, mean_dev_vs_k1 double, max_dev_vs_k1 double, mean_dev_vs_true double, coverage double, repetitions int"


@dataclass(frozen=True)
class Estimate:
    """Coefficients of one fit, and whether its 95 % intervals hold the true ones."""

    repetition: int
    k: int
    binned: bool
    coef: np.ndarray
    covers: bool


def configurations(ks: list[int], widths: list[float | None], base: Settings) -> list[Settings]:
    """One for each k and width; the first is the guard-free one, whether asked for or not."""
    asked = [(k, w) for k in ks for w in widths]
    every = [(1, None), *[c for c in asked if c != (1, None)]]
    return [replace(base, risk_change=k, bin_width=w) for k, w in every]


def bias_fits(df: DataFrame, time: str, outcome: str, truth: dict[str, float], configs: list[Settings], limits: Limits | None = None, repetition: str = "repetition") -> list[Estimate]:
    """One estimate per repetition (a column of integers from 0) and configuration; all of them are one batch of fits."""
    n = len(configs)
    found = [r[0] for r in df.select(repetition).distinct().collect()]
    if any(r is None or r < 0 for r in found):
        raise UserInputError("repetitions are numbered from 0")
    settings = {r * n + i: s for r in found for i, s in enumerate(configs)}
    out = []
    for fit, got in cox_fits(df, repetition, time, outcome, list(truth), settings, limits, copies=n).items():
        rows = [got["model"][t] for t in truth]
        inside = all(math.log(r["lower_CI"]) <= b <= math.log(r["upper_CI"]) for r, b in zip(rows, truth.values()))
        s = configs[fit % n]
        out.append(Estimate(fit // n, s.risk_change, s.bin_width is not None, np.array([r["Coef"] for r in rows]), inside))
    return out


def bias_metrics(estimates: list[Estimate], truth: dict[str, float]) -> list[tuple]:
    """Rows of METRICS: by k and binning the largest deviation of a fit, as mean and maximum over repetitions, and coverage.

    Deviations from k = 1 compare with the fit of the same repetition without guards or bins; with k = 1 itself they are 0.
    """
    free = {e.repetition: e.coef for e in estimates if e.k == 1 and not e.binned}
    beta, out = np.array(list(truth.values())), []
    for k, binned in sorted({(e.k, e.binned) for e in estimates}):
        own = sorted((e for e in estimates if (e.k, e.binned) == (k, binned)), key=lambda e: e.repetition)
        moved = [float(np.max(np.abs(e.coef - free[e.repetition]))) if k != 1 else 0.0 for e in own]
        off = [float(np.max(np.abs(e.coef - beta))) for e in own]
        out.append((k, binned, math.fsum(moved) / len(own), max(moved), math.fsum(off) / len(own), sum(e.covers for e in own) / len(own), len(own)))
    return out


def bias_study(df: DataFrame, time: str, outcome: str, truth: dict[str, float], ks: list[int], width: float, base: Settings | None = None, limits: Limits | None = None, repetition: str = "repetition") -> DataFrame:
    """METRICS of every k, with bins of ``width`` and without; truth: the coefficient of each numeric covariate."""
    configs = configurations(ks, [None, width], base or Settings())
    got = bias_fits(df, time, outcome, truth, configs, limits, repetition)
    asked = set(ks)
    return df.sparkSession.createDataFrame([r for r in bias_metrics(got, truth) if r[0] in asked], METRICS)
