"""Compaction of a De Bruijn graph whose edges are repeated runs of k-mers.

A k-mer of words is an edge between the (k-1)-mers at its ends. ``runs`` deals
k-mers in runs that nothing branches off, so an edge here is one such run, and
the node between two runs that follow one another in a text is the k-1 words
they share. Only edges that repeat are kept. A node is nonbranching if all
occurrences of the edge before it go on to one same edge, and all occurrences
of that one come from it. A join on edge names contracts such nodes: an edge that
comes after one is inner to a path, and since that holds for all its occurrences,
the edges of a path stand side by side wherever it occurs. A path is an edge that
is not inner with the inner ones behind it; one pass over the edges of each
document adds them up. Each occurrence of a path is one span of words, with the
coordinates of the first as its source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runs import EDGE, PACKED, batch, span_rows, unpack_all
from .shared import stored

#: Spans packed at a time.
SPANS_PACKED = 1 << 17
EDGES_AS_ROWS = "name long, doc long, place int, n int, source long, at int"


def _along():
    return Window.partitionBy("doc").orderBy("place", "name")


def edge_rows(packed: DataFrame) -> DataFrame:
    """One row per occurrence of a repeated edge: name, doc, place, n (windows), and its first occurrence (source, at)."""

    def run(batches):
        for b in batches:
            name, doc, place, n, source, at = unpack_all(b.column(b.schema.get_field_index("payload")), *EDGE)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (name.view(np.int64), doc, place, n, source, at)], ["name", "doc", "place", "n", "source", "at"])

    return packed.mapInArrow(run, EDGES_AS_ROWS)


def nonbranching(edges: DataFrame) -> DataFrame:
    """name, next: pairs of edges that meet in a node of in-degree and out-degree one, in all their occurrences."""
    order = _along()
    after = F.when(F.lead("place").over(order) == F.col("place") + F.col("n"), F.lead("name").over(order))
    before = F.when(F.lag("place").over(order) + F.lag("n").over(order) == F.col("place"), F.lag("name").over(order))
    steps = edges.select("name", after.alias("after"), before.alias("before"))
    only = lambda c: F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1))), F.min(c))
    degrees = stored(steps.groupBy("name").agg(only("after").alias("next"), only("before").alias("previous")), "degrees")
    to = degrees.filter("previous is not null").select(F.col("name").alias("next"), F.col("previous").alias("back"))
    return degrees.filter("next is not null").join(to, "next").filter("back = name").select("name", "next")


def paths(edges: DataFrame, links: DataFrame) -> DataFrame:
    """The edges that begin a path, with n: windows from there to the end of the path."""
    inner = links.select(F.col("next").alias("name"), F.lit(True).alias("inner"))
    order = _along()
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    begins = edges.join(inner, "name", "left").withColumns({"before": before, "whole": whole}).filter("inner is null")
    n = (F.coalesce(F.lead("before").over(order), F.col("whole")) - F.col("before")).cast("int")
    return begins.withColumn("n", n).drop("inner", "before", "whole")


def compact(packed: DataFrame, n_parts: int) -> DataFrame:
    """Spans of all but the first occurrences of every path, packed for the parts of their documents."""
    edges = stored(edge_rows(packed), "edges")
    links = stored(nonbranching(edges), "links")
    later = paths(edges, links).filter("doc <> source or place <> at").select("doc", "place", "n", "source", "at")

    def run(batches):
        have, size = [], 0
        for b in batches:
            have.append([c.to_numpy() for c in b.columns])
            size += len(b)
            if size >= SPANS_PACKED:
                yield batch(span_rows(n_parts, *(np.concatenate(x) for x in zip(*have))))
                have, size = [], 0
        if size:
            yield batch(span_rows(n_parts, *(np.concatenate(x) for x in zip(*have))))

    return later.mapInArrow(run, PACKED)
