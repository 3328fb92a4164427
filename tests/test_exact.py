"""Sums that do not depend on order, and fits whose every bit does not depend on partitions."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardspark.config import OPEN, Settings
from hazardspark.functions.exact import above, exact_sums, units
from hazardspark.operators import risksets
from hazardspark.plans.bias import Estimate, bias_metrics, bias_study, configurations
from hazardspark.plans.fit import cox_fit, cox_fits
from test_fit import frame, simulated


def test_powers():
    assert [above(x) for x in (1.0, 1.5, 2.0, 0.3, 0.0, -1.0, math.inf)] == [1.0, 2.0, 2.0, 0.5, 1.0, 1.0, 1.0]
    for n in (1, 1000, 10**6, 10**9, 10**12):
        own = units(3.0, n)
        assert own[-1] <= 4.0 * 2.0**-64 and all(math.frexp(u)[0] == 0.5 for u in own)
        # every sum of n parts stays below 2^53 units
        assert all(n * (b + u) < 2.0**53 * u for b, u in zip([3.0, *own], own))


@pytest.mark.parametrize("spread", [1, 1e-9, 1e12])
def test_sums_are_exact_and_alike(spark, spread):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(size=3000) * spread, rng.normal(size=3000), np.full(500, 0.1), [spread, -spread]])
    bound = float(np.abs(values).max())
    aggregates, joined = exact_sums([("x", "v", bound), ("y", "(v * v)", bound**2)], len(values))
    seen = set()
    for parts in (1, 2, 7, 30):
        shuffled = rng.permutation(values)
        df = spark.createDataFrame([(float(v),) for v in shuffled], "v double").repartition(parts)
        seen.add(tuple(df.agg(*aggregates).select(*joined).first()))
    assert len(seen) == 1
    x, y = seen.pop()
    assert x == pytest.approx(math.fsum(values), rel=1e-13, abs=bound * 1e-15) and y == pytest.approx(math.fsum(values * values), rel=1e-13)


def test_slots_equal_a_search(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 8, 9, 1000):
        grid = np.unique(np.round(rng.uniform(0, 50, n), 2)).tolist()
        times = np.concatenate([np.round(rng.uniform(-1, 52, 300), 2), grid, [0.0, -0.0]])
        got = risksets.assign_slots(spark.createDataFrame([(float(t),) for t in times], "time double"), grid).collect()
        assert [r.slot for r in got] == (np.searchsorted(grid, times, side="right") - 1).tolist()
    assert [r.slot for r in risksets.assign_slots(spark.range(1).selectExpr("1.0D AS time"), []).collect()] == [-1]


def test_many_terms_equal_numpy(spark):
    """Twenty terms are summed in blocks."""
    rng = np.random.default_rng(9)
    n, p = 300, 20
    x, w, slot = rng.normal(size=(n, p)), rng.uniform(0, 1, n), rng.integers(-1, 4, n)
    rows = [(1, int(s), float(v), *map(float, r)) for s, v, r in zip(slot, w, x)]
    df = spark.createDataFrame(rows, "site long, slot int, w double, " + ", ".join(f"x{i} double" for i in range(p)))
    got = {r.slot: r for r in risksets.slot_sums(df, [F.col(f"x{i}") for i in range(p)], F.col("w"), [F.col("x0") > 0]).collect()}
    assert set(got) == {0, 1, 2, 3} and len(got[0].asDict()) == 4 + 1 + p + p * (p + 1) // 2
    for s, r in got.items():
        at = slot == s
        second = (x[at] * w[at, None]).T @ x[at]
        assert r.n == at.sum() and r.ng_0 == (x[at, 0] > 0).sum() and r.s0 == pytest.approx(w[at].sum(), rel=1e-12)
        assert all(r[f"s2_{i}_{j}"] == pytest.approx(second[i, j], rel=1e-9, abs=1e-12) for i in range(p) for j in range(i, p))


def without_given(result):
    return json.dumps({k: v for k, v in result.items() if k != "provenance"}, sort_keys=True)


def test_reruns_release_the_same_bits(spark):
    """Twenty runs over other partitions and orders, guards on and off."""
    rows = [(s, round(t, 1), e, a, b * 1e4 + 3e5) for s, t, e, a, b in simulated(rows=250)]
    rng = np.random.default_rng(0)
    for settings, runs in ((Settings(), 10), (OPEN, 10)):
        seen = set()
        for i in range(runs):
            df = frame(spark, [rows[j] for j in rng.permutation(len(rows))]).repartition(1 + i % 7)
            seen.add(without_given(cox_fit(df, "time", "event", ["x1", "x2"], settings=settings, rounds=3)))
        assert len(seen) == 1


def test_no_python_in_a_fit(spark, monkeypatch):
    """No plan that a fit runs has a Python worker, and few queries run before the first round."""
    from pyspark.sql.classic.dataframe import DataFrame

    plans, rounds = [], []
    for name in ("collect", "toPandas", "first"):
        def told(self, *a, _run=getattr(DataFrame, name), _name=name, **k):
            plans.append(self._jdf.queryExecution().toString())
            rounds.append(_name)
            return _run(self, *a, **k)

        monkeypatch.setattr(DataFrame, name, told)
    rows = [(s, t, e, a, b, "hi" if a > 0 else "lo") for s, t, e, a, b in simulated(rows=400)]
    df = frame(spark, rows, "site long, time double, event int, x1 double, x2 double, c string")
    cox_fit(df, "time", "event", ["x1", {"c": {"categories": {"h": ["hi"], "l": ["lo"]}, "reference": "l"}}], settings=Settings(bin_width=2.0))
    assert plans and not any("Python" in p or "Arrow" in p or "Pandas" in p for p in plans)
    assert rounds.index("toPandas") <= 3


def test_a_batch_equals_its_fits(spark):
    """Several guards over the same rows, and other rows, at once and one by one."""
    first, second = simulated(rows=300), simulated(seed=5, rows=260)
    settings = {0: Settings(), 1: Settings(bin_width=3.0), 4: OPEN}
    rows = [(f, *r) for f in (0, 1) for r in first] + [(4, *r) for r in second] + [(9, *r) for r in second]
    got = cox_fits(frame(spark, rows, "fit int, site long, time double, event int, x1 double, x2 double"), "fit", "time", "event", ["x1", "x2"], settings)
    assert sorted(got) == [0, 1, 4]
    for f, own in ((0, first), (1, first), (4, second)):
        alone = cox_fit(frame(spark, own), "time", "event", ["x1", "x2"], settings=settings[f])
        # bounds differ with the batch, so the last bits of what is summed may
        for term in ("x1", "x2"):
            assert got[f]["model"][term] == pytest.approx(alone["model"][term], rel=1e-7, abs=1e-9)
        assert got[f]["n_events"] == alone["n_events"] and got[f]["privacy_guards"] == alone["privacy_guards"] and got[f]["n_iterations"] == alone["n_iterations"]


def test_bias_metrics():
    truth = {"a": 1.0, "b": -1.0}
    made = [Estimate(r, k, w, np.array(c), ok) for r, k, w, c, ok in (
        (0, 1, False, [1.1, -1.0], True), (0, 1, True, [1.2, -1.0], True), (0, 5, False, [1.1, -1.3], False),
        (1, 1, False, [0.9, -1.0], True), (1, 1, True, [0.9, -1.1], False), (1, 5, False, [1.0, -1.0], True),
    )]
    rows = {r[:2]: r[2:] for r in bias_metrics(made, truth)}
    assert rows[1, False] == pytest.approx((0, 0, 0.1, 1.0, 2)) and rows[1, True] == pytest.approx((0, 0, 0.15, 0.5, 2))
    assert rows[5, False] == pytest.approx((0.2, 0.3, 0.15, 0.5, 2))
    assert [(s.risk_change, s.bin_width) for s in configurations([5, 1], [None, 2.0], Settings())] == [(1, None), (5, None), (5, 2.0), (1, 2.0)]


def test_bias_study_on_simulated_rows(spark):
    """Without guards the estimates are near the truth; guards move them, the more the stronger."""
    rng = np.random.default_rng(20)
    rows = []
    for rep in range(2):
        for site in range(3):
            x = rng.normal(size=(400, 2))
            ends, leaves = rng.exponential(50 / np.exp(x @ [0.5, -0.3])), rng.uniform(0, 60, 400)
            rows += [(rep, site, float(np.floor(min(t, c) * 10) / 10), int(t <= c), *map(float, v)) for t, c, v in zip(ends, leaves, x)]
    df = spark.createDataFrame(rows, "repetition int, site long, time double, event int, x1 double, x2 double")
    got = {(r.k, r.binned): r for r in bias_study(df, "time", "event", {"x1": 0.5, "x2": -0.3}, [1, 10], 5.0).collect()}
    assert sorted(got) == [(1, False), (1, True), (10, False), (10, True)] and all(r.repetitions == 2 for r in got.values())
    assert got[1, False].mean_dev_vs_true < 0.15 and got[1, False].max_dev_vs_k1 == 0 < got[10, False].mean_dev_vs_k1 <= got[10, False].max_dev_vs_k1


def test_no_task_of_a_study_holds_several_copies(spark, monkeypatch):
    """Six guards over the same rows: what is cached of them has no larger partitions than they have themselves."""
    from pyspark.sql.classic.dataframe import DataFrame

    largest, persist = [], DataFrame.persist

    def told(self, *a, **k):
        out = persist(self, *a, **k)
        if "x0" in self.columns:  # rows, not counts
            largest.append(self.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(DataFrame, "persist", told)
    rows = [(rep, *r) for rep in range(2) for r in simulated(seed=rep, rows=300)]
    df = frame(spark, rows, "repetition int, site long, time double, event int, x1 double, x2 double").repartition(2)
    most = df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    got = bias_study(df, "time", "event", {"x1": 0.5, "x2": -0.3}, [1, 5, 10], 5.0)
    assert got.count() == 6 and most < len(rows) and largest == [most, most]
