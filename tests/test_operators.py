"""Encoding, thresholds, time guards and risk sets, against plain loops over random rows."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hazardspark.config import OPEN, Settings
from hazardspark.errors import PrivacyThresholdViolation, UserInputError
from hazardspark.operators import guards, risksets, times
from hazardspark.operators.encode import coerce_numbers, drop_incomplete, encode, recode_outcome, select_rows
from hazardspark.request import parse_covariates
from loops import merge, shown_slots

SEX = {"sex": {"categories": {"M": ["M"], "F": ["F"]}, "reference": "M"}}


def column(df, name):
    return [r[0] for r in df.orderBy("i").select(f"`{name}`").collect()]


def numbered(spark, values, kind="string", name="v"):
    return spark.createDataFrame(list(enumerate(values)), f"i int, {name} {kind}")


def test_recoding(spark):
    codes = {"event": ["ncit:C99799", "ncit:C99798"], "censored": ["ncit:C37987", "ncit:C141463"], "missing": ["ncit:C54031"]}
    base = "http://ncicb.nci.nih.gov/xml/owl/EVS/Thesaurus.owl#"
    df = numbered(spark, [base + "C99799", base + "C37987", base + "C54031", "ncit:C99798", base + "C141463", None])
    assert column(recode_outcome(df, "v", codes), "v") == [1, 0, None, 1, 0, None]
    df = numbered(spark, [2, 1, 1, 2, 9], "int")
    assert column(recode_outcome(df, "v", {"event": ["2"], "censored": [1.0], "missing": []}), "v") == [1, 0, 0, 1, None]


def test_encoding(spark):
    covariates = parse_covariates([SEX])
    assert column(encode(numbered(spark, list("MFMF"), name="sex"), covariates), "sex[F]") == [0, 1, 0, 1]
    assert column(encode(numbered(spark, ["M", "unknown", "F"], name="sex"), covariates), "sex[F]") == [0, None, 1]
    scored = parse_covariates([{"stage": {"scores": {"I": 1, "II": 2}}}])
    assert column(encode(numbered(spark, ["I", "II", "unknown", "III"], name="stage"), scored), "stage") == [1, 2, None, None]
    with pytest.raises(UserInputError):
        encode(numbered(spark, ["M"], name="sex").withColumn("sex[F]", F.lit(1)), covariates)
    with pytest.raises(UserInputError):
        encode(numbered(spark, ["M"]), covariates)
    upper = lambda c, kind: F.concat(F.lit("s:"), F.upper(c))
    assert column(encode(numbered(spark, ["m", "f"], name="sex"), covariates, upper), "sex[F]") == [0, 1]


def test_incomplete_rows(spark):
    rng = np.random.default_rng(11)
    odd = [None, math.nan, math.inf, -2.5, 7.0]
    rows = [(i, odd[rng.integers(5)], odd[rng.integers(5)], [None, "t"][rng.integers(2)]) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c string")
    whole = lambda x: x is not None and x == x
    for names in (["a"], ["a", "b"], ["c", "b", "not a column"]):
        want = [r[0] for r in rows if all(whole(r[1 + "abc".index(n)]) for n in names if n in "abc")]
        assert column(drop_incomplete(df, names), "i") == want
    assert drop_incomplete(df, ["not a column"]).count() == 80
    assert column(coerce_numbers(numbered(spark, ["12", "twelve", "1999-12-31"]), ["v", "not a column"]), "v") == [12.0, None, None]


def test_selection(spark):
    ages = numbered(spark, [float(x) for x in range(30, 230)], "double", "age")
    assert select_rows(ages, {"age": {"start": 40, "end": 60}}).count() == 21
    assert select_rows(ages.withColumn("age", F.when(F.col("i") > 5, F.col("age"))), {"age": {"end": 40}}).count() == 5
    assert select_rows(ages, {"age": ["40", 41, "x"]}).count() == 2
    with pytest.raises(UserInputError):
        select_rows(ages, {"sex": ["M"]})


def sized(spark, rows, events, site=1):
    return spark.createDataFrame([(site, float(i), int(i < events), "MF"[i % 2]) for i in range(rows)], "site long, time double, event int, sex string")


def test_thresholds(spark):
    def check(rows, events, settings):
        df = sized(spark, rows, events)
        found = guards.sizes(df, "time", "event", parse_covariates(["x"])).collect()
        guards.check_sizes(found, [1], parse_covariates(["x"]), {1: settings})

    plain = Settings(risk_change=1, row_factor=1, risk_size=None)
    for n, ok in ((9, False), (10, False), (11, True)):
        if ok:
            check(n, n, plain)
        else:
            with pytest.raises(PrivacyThresholdViolation):
                check(n, n, plain)
    with pytest.raises(PrivacyThresholdViolation):
        check(49, 40, Settings(risk_size=None))
    check(50, 40, Settings(risk_size=None))
    with pytest.raises(PrivacyThresholdViolation) as refused:
        check(50, 10, Settings(risk_size=None))
    assert "50 rows at least" in str(refused.value)
    with pytest.raises(PrivacyThresholdViolation):
        guards.check_sizes([], [7], parse_covariates(["x"]), {7: OPEN})


def test_category_thresholds(spark):
    covariates = parse_covariates([SEX])
    for rows, ok in ((298, False), (300, True)):
        df = encode(sized(spark, rows, rows), covariates)
        found = guards.sizes(df, "time", "event", covariates).collect()
        if ok:
            guards.check_sizes(found, [1], covariates, {1: Settings()})
        else:
            with pytest.raises(PrivacyThresholdViolation, match="sex"):
                guards.check_sizes(found, [1], covariates, {1: Settings()})


def test_column_checks(spark):
    covariates = parse_covariates(["x"])

    def found(rows):
        return guards.sizes(spark.createDataFrame([(1, *r) for r in rows], "site long, time double, event double"), "time", "event", covariates).collect()

    guards.check_values(found([(0.0, 1.0), (2.0, 0.0)]), "time", "event")
    for bad in ([(math.inf, 1.0)], [(-1.0, 1.0)], [(1.0, 2.0)]):
        with pytest.raises(UserInputError):
            guards.check_values(found(bad), "time", "event")
    df = spark.createDataFrame([("1", 1, "2020")], "time string, event int, x string")
    for time, outcome in (("nosuch", "event"), ("time", "event"), ("event", "time")):
        with pytest.raises(UserInputError):
            guards.check_schema(df, time, outcome)
    for covs, t in ((["y"], "time"), (["x"], "time"), (["time"], "time")):
        with pytest.raises(UserInputError):
            guards.check_terms(df, parse_covariates(covs), t, "event")


def test_bins(spark):
    got = column(numbered(spark, [1.5, 7.3, 12.8, 20.0, -3.2, 5.0], "double").withColumn("v", times.bin_times(F.col("v"), 10.0)), "v")
    assert got == [0, 0, 10, 20, -10, 0]
    assert column(numbered(spark, [1.5], "double").withColumn("v", times.bin_times(F.col("v"), F.lit(None).cast("double"))), "v") == [1.5]


def rows_of(spark, time, event=None, site=1):
    event = event if event is not None else [1] * len(time)
    return spark.createDataFrame([(site, float(t), int(e)) for t, e in zip(time, event)], "site long, time double, event int")


def test_tail_cut(spark):
    """The k-th largest time with duplicates; beyond it rows are censored there; sites have a k of their own."""
    rng = np.random.default_rng(12)
    ks = {4: 3, 6: 7, 8: 1, 9: 9}
    rows = [(s, float(rng.integers(0, 25)), int(rng.integers(0, 2))) for s in ks for _ in range(40 if s != 9 else 5)]
    df = spark.createDataFrame(rows, "site long, time double, event int")
    knobs = times.settings_frame(spark, {s: Settings(risk_change=k, threshold=12) for s, k in ks.items()})
    own = lambda s: [r for r in rows if r[0] == s]
    want = {s: sorted(t for _, t, _ in own(s))[-k] if len(own(s)) >= k else None for s, k in ks.items() if k > 1}
    cuts = times.tail_cuts(df, knobs)
    assert {r.site: r.cut for r in cuts.collect()} == want
    assert {r.site: r.cut for r in times.kth_largest(df, 7).collect()} == {s: sorted(t for _, t, _ in own(s))[-7] for s in (4, 6, 8)}
    limit = {s: want.get(s) if want.get(s) is not None else math.inf for s in ks}
    clamped = sorted((s, min(t, limit[s]), int(e and t <= limit[s])) for s, t, e in rows)
    assert sorted(map(tuple, times.clamp_tail(df, cuts).select("site", "time", "event").collect())) == clamped


def merged(spark, time, freq, m):
    df = spark.createDataFrame([(1, float(t), f) for t, f in zip(time, freq)], "site long, time double, freq long")
    return [r.merged for r in times.merge_small(df, m).orderBy("time").collect()]


def test_merging_equals_a_loop(spark):
    rng = np.random.default_rng(3)
    for least, top, n in ((1, 4, 12), (2, 4, 60), (4, 3, 35), (9, 5, 60), (50, 3, 8), (7, 7, 1)):
        freq = rng.integers(1, top, n).tolist() if top > 1 else [1] * n
        when = sorted(rng.choice(500, n, replace=False).tolist())
        want = merge(when, freq, least)
        assert merged(spark, when, freq, least) == want
        df = spark.createDataFrame([(1, float(t), f) for t, f in zip(when, freq)], "site long, time double, freq long")
        total = {t: sum(f for f, w in zip(freq, want) if w == t) for t in set(want)}
        assert {r.time: r.freq for r in times.suppressed_counts(df, least).collect()} == total


def test_merging_a_hundred_thousand_times(spark):
    rng = np.random.default_rng(31)
    freq = rng.integers(1, 4, 100_000).tolist()
    df = spark.createDataFrame(pa.table({"site": pa.array([1] * 100_000, pa.int64()), "time": np.arange(100_000.0), "freq": pa.array(freq, pa.int64())}))
    got = times.merge_small(df, 5).orderBy("time").toPandas()["merged"].tolist()
    assert got == merge(np.arange(100_000.0).tolist(), freq, 5)


def test_moving_events(spark):
    rng = np.random.default_rng(14)
    when, event = rng.integers(0, 30, 70).tolist(), (rng.random(70) < 0.4).astype(int).tolist()
    df = rows_of(spark, when, event)
    points = sorted({t for t, e in zip(when, event) if e})
    to = dict(zip(points, merge(points, [sum(e for t, e in zip(when, event) if t == p) for p in points], 4)))
    moved = times.move_events(df, times.merge_small(times.event_counts(df), 4))
    assert sorted((r.time, r.event) for r in moved.collect()) == sorted((float(to[t]) if e else float(t), e) for t, e in zip(when, event))


def release(spark, time, grid, k, floor, group=None, x=None):
    """What a site releases, by the Spark operators."""
    rows = spark.createDataFrame([(1, float(t), int(g), float(v)) for t, g, v in zip(time, group or [0] * len(time), x or [0.0] * len(time))], "site long, time double, g int, x double")
    knobs = times.settings_frame(spark, {1: Settings(risk_change=k, risk_size=floor, threshold=max(10, k), figures=None)})
    slotted = risksets.assign_slots(rows, [float(t) for t in grid])
    masks = [F.col("g") == 1] if group else []
    sums = risksets.slot_sums(slotted, [F.col("x")], F.lit(1.0), masks)
    risk = risksets.at_risk(sums, knobs, len(grid))
    got = risksets.released(risk, risksets.effective_slots(risk, knobs, len(masks)), knobs, 1).orderBy("slot").collect()
    return [r.s0 for r in got], [r.s1_0 for r in got], [r.s2_0_0 for r in got]


def test_held_risk_sets_equal_a_loop(spark):
    """Sizes, weighted sums and group holds of random sites."""
    rng = np.random.default_rng(15)
    held = 0
    for case in range(12):
        n, k, floor = int(rng.integers(15, 120)), [1, 2, 3, 6][case % 4], [None, 4, 12][case % 3]
        when = rng.integers(0, 30, n).tolist()
        grid = sorted(rng.choice(28, 9, replace=False).tolist())
        group = (rng.random(n) < 0.35).astype(int).tolist() if case % 2 else None
        x = rng.integers(-3, 4, n).astype(float).tolist()
        at = [[i for i in range(n) if when[i] >= t] for t in grid]
        slots = shown_slots([len(a) for a in at], [[sum(group[i] for i in a) for a in at]] if group else [], k, floor)
        held += sum(s != i for i, s in enumerate(slots))
        s0, s1, s2 = release(spark, when, grid, k, floor, group, x)
        assert s0 == [len(at[s]) for s in slots]
        assert s1 == [sum(x[i] for i in at[s]) for s in slots] and s2 == [sum(x[i] ** 2 for i in at[s]) for s in slots]
    assert held > 20


def test_risk_sets_equal_masks(spark):
    rng = np.random.default_rng(5)
    n, p = 400, 2
    time, x = rng.integers(0, 40, n).astype(float), rng.normal(size=(n, p))
    site = rng.integers(0, 3, n)
    grid = np.unique(rng.integers(2, 38, 15)).astype(float)
    beta = np.array([0.4, -0.7])
    rows = spark.createDataFrame([(int(s), float(t), float(a), float(b)) for s, t, (a, b) in zip(site, time, x)], "site long, time double, x0 double, x1 double")
    xs = [F.col("x0"), F.col("x1")]
    sums = risksets.slot_sums(risksets.assign_slots(rows, grid.tolist()), xs, F.exp(0.4 * xs[0] - 0.7 * xs[1]))
    risk = {(r.site, r.slot): r for r in risksets.at_risk(sums, rows.select("site").distinct(), len(grid)).collect()}
    for s in range(3):
        for j, t in enumerate(grid):
            at = (site == s) & (time >= t)
            w = np.exp(x[at] @ beta)
            r = risk[s, j]
            assert r.n == at.sum() and r.s0 == pytest.approx(w.sum(), rel=1e-12)
            assert r.s1_1 == pytest.approx((w * x[at, 1]).sum(), rel=1e-9, abs=1e-12) and r.s2_0_1 == pytest.approx((w * x[at, 0] * x[at, 1]).sum(), rel=1e-9, abs=1e-12)


def test_odd_releases_are_told(spark):
    def odd(sizes):
        df = spark.createDataFrame([(4, i, float(s)) for i, s in enumerate(sizes)], "site long, slot int, s0 double")
        return any(r.odd == 4 for r in risksets.pooled(df, 0).collect())

    assert all(odd(x) for x in ([9, 2, 2.5], [4, 2, -0.5], [0, 0], [8, math.nan, 3], [math.inf, 1]))
    assert not any(odd(x) for x in ([9, 9, 2, 0], [1.5]))
