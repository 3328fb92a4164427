"""Places in an order that no single task sees: prefix sums over range partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import n_parts, stored


def places(rows: DataFrame, group: str, keys: list, name: str = "place") -> DataFrame:
    """``rows`` (stored) with ``name``: the place, from 0, of each row among those of its group, in the order of ``keys``.

    group is not null. Rows are dealt by ranges of (group, keys), so a group that
    holds a third of them is spread like any other. Each task counts along its
    own range; what a group has in ranges before is added from one row per
    range. Of rows alike in group and keys the order is open.
    """
    spark = rows.sparkSession
    n = n_parts(spark)
    ranged = rows.repartitionByRange(n, group, *keys).sortWithinPartitions(group, *keys)
    schema = ranged.withColumns({"__part": F.lit(0), "__here": F.lit(0).cast("long")}).schema

    def run(batches):
        part, last, count = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            column = b.column(b.schema.get_field_index(group))
            same = column.slice(1).to_numpy(zero_copy_only=False) == column.slice(0, b.num_rows - 1).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.append(True, ~same))
            here = np.arange(b.num_rows) - np.repeat(first, np.diff(np.append(first, b.num_rows)))
            if column[0].as_py() == last:
                here[: first[1] if len(first) > 1 else b.num_rows] += count
            last, count = column[-1].as_py(), int(here[-1]) + 1
            yield b.append_column("__part", pa.array(np.full(b.num_rows, part, np.int32))).append_column("__here", pa.array(here))

    counted = stored(ranged.mapInArrow(run, schema), "places")
    # a group goes on into a later range only from the end of its own: one row per range says how far it came there
    ends = counted.groupBy("__part").agg(F.min(group).alias("opens"), F.max(group).alias("closes"), F.max_by("__here", F.struct(group, "__here")).alias("at"))
    ends = stored(ends.select("__part", "opens", "closes", (F.col("at") + 1).alias("n")), "range-ends")
    ahead = ends.alias("a").join(ends.alias("b"), (F.col("a.opens") == F.col("b.closes")) & (F.col("b.__part") < F.col("a.__part")))
    ahead = ahead.groupBy(F.col("a.__part").alias("__part"), F.col("a.opens").alias("__opens")).agg(F.sum("b.n").alias("__ahead"))
    known = counted.join(F.broadcast(ahead), (counted["__part"] == ahead["__part"]) & (counted[group] == ahead["__opens"]), "left")  # at most one row per range
    return known.select(*[counted[c] for c in rows.columns], (counted["__here"] + F.coalesce("__ahead", F.lit(0))).alias(name))
