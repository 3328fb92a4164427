"""Sums of doubles that do not depend on the order of their addends.

Each addend is cut into parts: a multiple of a power of two so large that every
sum of such parts is a double without rounding; of what is left, a multiple of a
smaller one, for which the same holds; and so on. Each part is summed as plain
doubles, in any order and over any partitions, and the sums are added once at
the end. There are as many parts as it takes for what none of them holds to be
below 2^-BITS of the bound.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: 1.5 * 2^52, which rounds what is added to it to a whole number.
ROUNDER = 1.5 * 2.0**52
BITS = 64


def above(x: float) -> float:
    """The least power of two that is not below a positive x; 1 for anything else."""
    if not (x > 0 and math.isfinite(x)):
        return 1.0
    mantissa, exponent = math.frexp(x)
    return math.ldexp(1.0, exponent - (mantissa == 0.5))


def units(bound: float, n: int) -> list[float]:
    """The powers of two for n addends of at most ``bound``."""
    step = above(float(max(n, 1))) * 2.0**-51
    out = [above(bound) * step]
    while out[-1] > above(bound) * 2.0**-BITS:
        out.append(out[-1] * step)
    return out


def parts(x: str, bound: float, n: int, scale: str | None = None) -> list[str]:
    """The parts of an addend, as SQL; scale: a power of two, by which the bound is multiplied."""
    out = []
    for u in units(bound, n):
        rounder = f"{u * ROUNDER!r}D" if scale is None else f"({u * ROUNDER!r}D * {scale})"
        out.append(f"(({x} + {rounder}) - {rounder})")
        x = f"({x} - {out[-1]})"
    return out


def total(name: str, columns: list[str]) -> Column:
    """The sum of the summed parts of ``name`` among ``columns``, the smallest first."""
    own = [c for c in columns if c == name or c.startswith(f"{name}__")]
    out = own[-1]
    for c in own[-2::-1]:
        out = f"({c} + {out})"
    return F.expr(out).alias(name)


def exact_sums(named: list[tuple[str, str, float]], n: int, scale: str | None = None) -> tuple[list[Column], list[Column]]:
    """Aggregates of (name, addend as SQL, bound), and the columns that make one sum of the parts of each."""
    aggregates, joined = [], []
    for name, x, bound in named:
        own = parts(x, bound, n, scale)
        labels = [name, *[f"{name}__{i}" for i in range(1, len(own))]]
        aggregates += [F.expr(f"sum({p})").alias(c) for p, c in zip(own, labels)]
        joined.append(total(name, labels))
    return aggregates, joined
