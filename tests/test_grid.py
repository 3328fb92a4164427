"""Risk sets on an event-time grid of more points than a fit allows."""

from hazardspark import queries
from hazardspark.operators import times


def test_slots_of_a_long_grid(spark):
    rows = spark.createDataFrame([("a", float(i), 1) for i in range(1500)], "site string, time double, event int")
    slotted, slots, grid = queries._slotted(rows, times.event_counts(rows))
    assert grid == [float(i) for i in range(1500)]
    assert slots.count() == 1500
    assert {(r.time, r.slot) for r in slotted.collect()} == {(float(i), i) for i in range(1500)}
