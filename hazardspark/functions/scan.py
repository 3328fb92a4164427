"""Running a rule with a state along an array, inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def scanned(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """A struct of the last state and ``out``, what each step told; step: (state, item) to (new state, told), the latter of Spark type ``kind``.

    An array grows by a copy, so what is told is gathered per block of items, and
    the blocks are joined: copying is then by blocks, not by items.
    """
    empty = F.array().cast(f"array<{kind}>")

    def inner(s: Column, x: Column) -> Column:
        state, told = step(s["state"], x)
        return F.struct(state.alias("state"), F.concat(s["out"], F.array(told.cast(kind))).alias("out"))

    def outer(s: Column, block: Column) -> Column:
        within = F.aggregate(block, F.struct(s["state"].alias("state"), empty.alias("out")), inner)
        joined = lambda w: F.struct(w["state"].alias("state"), F.concat(s["out"], w["out"]).alias("out"))
        return F.get(F.transform(F.array(within), joined), 0)  # computed once

    last = F.greatest((F.ceil(F.size(items) / BLOCK) - 1).cast("int"), F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))
    return F.aggregate(blocks, F.struct(start.alias("state"), empty.alias("out")), outer)
