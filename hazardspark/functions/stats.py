"""Tails of the normal and chi-square distributions."""

from __future__ import annotations

import math


def two_sided_p(z: float) -> float:
    """Twice the normal tail beyond |z|."""
    return math.erfc(abs(z) / math.sqrt(2)) if not math.isnan(z) else math.nan


def chi_square_tail(x: float, freedom: int) -> float:
    """P(X > x) for an integer number of degrees of freedom."""
    if math.isnan(x):
        return math.nan
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    half = x / 2
    if freedom % 2 == 0:
        terms = (i * math.log(half) - math.lgamma(i + 1) for i in range(freedom // 2))
        return min(1.0, sum(math.exp(t - half) for t in terms))
    terms = ((i - 0.5) * math.log(half) - math.lgamma(i + 0.5) for i in range(1, (freedom - 1) // 2 + 1))
    return min(1.0, math.erfc(math.sqrt(half)) + sum(math.exp(t - half) for t in terms))
