"""Rounding to significant figures, half to even, in Spark and in numpy.

Only whole powers of ten are used, which are exact, so both agree to the bit.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def round_figures(x: Column, figures: Column | int) -> Column:
    """x to so many figures; null figures leave it as it is."""
    figures = F.lit(figures) if not isinstance(figures, Column) else figures
    shift = figures - 1 - F.floor(F.log10(F.abs(x)))
    up, down = F.pow(F.lit(10.0), shift), F.pow(F.lit(10.0), -shift)
    rounded = F.when(x == 0, F.lit(0.0)).when(shift >= 0, F.rint(x * up) / up).otherwise(F.rint(x / down) * down)
    return F.when(figures.isNull(), x).otherwise(rounded)


def round_figures_np(x, figures: int | None = 2) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    if figures is None:
        return x
    out = np.zeros_like(x)
    some = x != 0
    with np.errstate(divide="ignore", invalid="ignore"):
        shift = figures - 1 - np.floor(np.log10(np.abs(x[some])))
        power = 10.0 ** np.abs(shift)
        out[some] = np.where(shift >= 0, np.rint(x[some] * power) / power, np.rint(x[some] / power) * power)
    return out
