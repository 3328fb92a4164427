"""The whole fit: independent likelihood, invariances, guards, refusals."""

import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from hazardspark.config import OPEN, Limits, Settings
from hazardspark.errors import AlgorithmError, PrivacyThresholdViolation, UserInputError
from hazardspark.plans.curves import survival_curves
from hazardspark.operators import risksets
from hazardspark.operators.times import pooled_grid
from hazardspark.functions.rounding import round_figures_np
from hazardspark.plans.fit import Design, Evaluator, check_answers, check_sent, cox_fit, derivatives, guard_summary, log_likelihood, model_frame, model_results, optimise, pooled_arrays, standardisation
from hazardspark.plans.prepare import prepare
from hazardspark.request import FitRequest
from loops import breslow, held_share, shown_slots

TRUE = np.array([0.6, -0.25])


def simulated(seed=41, rows=200, sites=3):
    """Weibull times whose scale follows two covariates, censored row by row."""
    rng = np.random.default_rng(seed)
    x = np.stack([rng.uniform(-1.5, 1.5, sites * rows), rng.gamma(2.0, 0.5, sites * rows)], axis=1)
    risk = np.exp(x @ TRUE)
    ends = 40 * (rng.standard_exponential(len(x)) / risk) ** (1 / 1.4)
    leaves = rng.uniform(5, 90, len(x))
    return [(i % sites, float(min(t, c)), int(t <= c), float(a), float(b)) for i, (t, c, (a, b)) in enumerate(zip(ends, leaves, x))]


def frame(spark, rows, schema="site long, time double, event int, x1 double, x2 double"):
    return spark.createDataFrame(rows, schema)


def sums_at(x, w, at):
    """Risk-set sums over rows: at[j, i] tells that row i is at risk at point j."""
    return at @ w, at @ (w[:, None] * x), np.einsum("ji,i,ia,ib->jab", at.astype(float), w, x, x)


def test_derivatives_are_those_of_the_likelihood():
    rng = np.random.default_rng(6)
    x, freq, z = rng.normal(size=(50, 3)), rng.integers(1, 5, 8).astype(float), rng.normal(size=3)
    at = np.arange(50)[None, :] >= np.arange(8)[:, None] * 5
    beta = np.array([0.3, -0.2, 0.1])
    value = lambda b: log_likelihood(b, z, freq, sums_at(x, np.exp(x @ b), at)[0])
    slope = lambda b: derivatives(*sums_at(x, np.exp(x @ b), at), freq, z)[0]
    g, h = derivatives(*sums_at(x, np.exp(x @ beta), at), freq, z)
    step = 1e-5 * np.eye(3)
    assert np.allclose(g, [(value(beta + d) - value(beta - d)) / 2e-5 for d in step], atol=1e-6)
    assert np.allclose(h, [(slope(beta + d) - slope(beta - d)) / 2e-5 for d in step], atol=1e-6)
    s0, s1, s2 = sums_at(x, np.exp(x @ beta), at)
    for bad in (np.where(np.arange(8) == 3, 0, s0), np.where(np.arange(8) == 3, np.nan, s0), s0[:-1]):
        with pytest.raises(AlgorithmError):
            derivatives(bad, s1, s2, freq, z)
        with pytest.raises(AlgorithmError):
            log_likelihood(beta, z, freq, bad)


def test_results_follow_from_the_hessian():
    rng = np.random.default_rng(7)
    root = rng.normal(size=(3, 3))
    information = root @ root.T + np.eye(3)
    beta, scale = np.array([0.4, -1.1, 0.05]), np.array([2.0, 0.5, 10.0])
    out = model_results(beta, -information, scale, ["u", "v", "w"], -321.5)
    spread = np.diag(1 / scale) @ np.linalg.inv(information) @ np.diag(1 / scale)
    assert np.allclose(out["covariance"], spread) and out["aic"] == 643 + 6 and not out["warnings"]
    for i, term in enumerate("uvw"):
        row, se = out["model"][term], math.sqrt(spread[i, i])
        assert row["Coef"] == pytest.approx(beta[i] / scale[i]) and row["SE"] == pytest.approx(se) and row["Z"] == pytest.approx(beta[i] / scale[i] / se)
        assert row["lower_CI"] == pytest.approx(math.exp(row["Coef"] - 1.96 * se)) and row["upper_CI"] == pytest.approx(math.exp(row["Coef"] + 1.96 * se))
    assert ["v" in w for w in model_results(np.array([1, 44.0, 1]), -information, scale, ["u", "v", "w"], 0.0)["warnings"]] == [True]
    flat = model_results(beta, np.zeros((3, 3)), scale, ["u", "v", "w"], math.nan)
    assert all(math.isnan(r["SE"]) for r in flat["model"].values()) and not np.any(flat["covariance"]) and flat["aic"] is None and len(flat["warnings"]) == 3
    values = rng.normal(5, 3, (400, 2))
    centre, scale = standardisation(values.sum(axis=0), (values**2).sum(axis=0), 400)
    assert np.allclose(centre, values.mean(axis=0), rtol=0.05) and np.allclose(scale, values.std(axis=0), rtol=0.05) and all(len(f"{c:g}".replace(".", "")) <= 2 for c in (*centre, *scale))
    assert standardisation(np.array([12.0]), np.array([36.0]), 4)[1].tolist() == [1.0]


def test_curves():
    freq, s0, grid = [3, 0, 5, 2], [20.0, 16.0, 12.5, 8.0], [0.51234, 0.51249, 2.75, 1234.5]
    jumps = np.cumsum([f / s for f, s in zip(freq, s0)])
    hazard, curves = survival_curves(freq, s0, grid, [0.7], [2.0], [4.0], ["x"], [{"x": 6.0}, {}], None)
    assert [float(t) for t in hazard] == grid and np.allclose(list(hazard.values()), jumps)
    assert np.allclose(list(curves["1"].values()), np.exp(-jumps * math.exp(0.7))) and curves["2"] == curves["0"]
    hazard, curves = survival_curves(freq, s0, grid, [0.7], [2.0], [4.0], ["x"], [], 3)
    assert list(hazard) == ["0.512", "2.75", "1230.0"] and hazard["0.512"] == pytest.approx(jumps[1]) and curves["0"]["0.512"] == pytest.approx(math.exp(-jumps[1]))


def test_optimiser_halves_an_overshooting_step():
    """A likelihood in one coefficient whose first full step is too long."""
    visits = []

    def evaluate(beta):
        visits.append(beta.copy())
        b = 0.2 if len(visits) == 2 else float(beta[0])
        w = math.exp(b)
        s0 = np.array([1 + w]) if len(visits) != 2 else np.array([1e6])
        return s0, np.array([[w]]), np.array([[[w]]])

    path = optimise(evaluate, np.array([10.0]), np.array([6.0]), 1e-12)
    assert path.converged and path.beta[0] == pytest.approx(math.log(1.5), abs=1e-5)
    assert np.allclose(visits[2], visits[1] / 2)
    short = optimise(evaluate, np.array([10.0]), np.array([6.0]), 1e-12, rounds=1)
    assert not short.converged and short.rounds == 1


def test_unguarded_fit_is_the_breslow_fit(spark):
    rows = simulated()
    got = cox_fit(frame(spark, rows), "time", "event", ["x1", "x2"], settings=OPEN)
    beta, se, ll = breslow(rows)
    for name, b, s in zip(("x1", "x2"), beta, se):
        term = got["model"][name]
        assert term["Coef"] == pytest.approx(b, abs=2e-6) and term["SE"] == pytest.approx(s, abs=1e-5)
        assert term["Z"] == pytest.approx(term["Coef"] / term["SE"], abs=1e-9)
    assert all(abs(b - t) < 4 * s for b, t, s in zip(beta, TRUE, se))
    assert got["converged"] and got["n_iterations"] <= 10 and got["aic"] == pytest.approx(-2 * got["log_likelihood"] + 4)
    null = -sum(math.log(sum(q[1] >= r[1] for q in rows)) for r in rows if r[2])
    assert got["lr_statistic"] == pytest.approx(2 * (ll - null), rel=1e-4)
    assert list(got) == ["model", "overall_p_value", "aic", "degrees_of_freedom", "warnings", "converged", "n_iterations", "convergence_tolerance", "log_likelihood", "log_likelihood_null", "lr_statistic", "lr_p_value", "n_events", "covariance", "algorithm_version", "variables_to_stratify", "provenance", "baseline_cumulative_hazard", "survival_curves", "curve_time_sig_figs", "privacy_guards"]
    # one site holding all rows fits the same
    pooled = cox_fit(frame(spark, [(9, *r[1:]) for r in rows]), "time", "event", ["x1", "x2"], settings=OPEN)
    assert all(pooled["model"][n]["Coef"] == pytest.approx(got["model"][n]["Coef"], abs=1e-6) for n in ("x1", "x2"))
    # and so do covariates moved and stretched, and rows beside that are not complete
    moved = [(s, t, e, a * 50 + 1000, b) for s, t, e, a, b in rows] + [(1, None, 1, 1.0, 1.0), (2, 3.0, 1, math.nan, 1.0), (0, 3.0, None, 1.0, 1.0)]
    again = cox_fit(frame(spark, moved), "time", "event", ["x1", "x2"], settings=OPEN)
    assert again["model"]["x1"]["Coef"] * 50 == pytest.approx(got["model"]["x1"]["Coef"], abs=1e-5)
    assert [r.term for r in model_frame(spark, got).collect()] == ["x1", "x2"]


def test_default_guards(spark):
    rows, s = simulated(rows=400), Settings()
    df = frame(spark, rows)
    got = cox_fit(df, "time", "event", ["x1", "x2"], settings=s)
    sites = {k: held_share([r for r in rows if r[0] == k], s.risk_change, s.risk_size, s.time_events) for k in range(3)}
    grid = sorted({t for _, points in sites.values() for t in points})
    shares = []
    for moved, _ in sites.values():
        slots = shown_slots([sum(t >= g for t, _ in moved) for g in grid], [], s.risk_change, s.risk_size)
        late = {g for i, g in enumerate(grid) if i and sum(t >= grid[slots[i]] for t, _ in moved) == sum(t >= grid[0] for t, _ in moved)}
        shares.append(sum(e for t, e in moved if t in late) / sum(e for _, e in moved))
    assert got["privacy_guards"]["max_held_event_fraction"] == pytest.approx(max(shares), abs=1e-12)
    free = cox_fit(df, "time", "event", ["x1", "x2"], settings=Settings.at("standard", risk_change=1))
    assert all(abs(got["model"][n]["Coef"] - free["model"][n]["Coef"]) <= 0.1 for n in ("x1", "x2"))
    assert got["privacy_guards"]["active"] and any("approximate" in w for w in got["warnings"])
    sizes = list(got["baseline_cumulative_hazard"].values())
    assert sizes == sorted(sizes)


def test_only_pooled_sums_of_guarded_sites_are_seen(spark):
    """An evaluation equals the sum over sites of held and rounded loops."""
    rows = simulated(rows=300)
    by = {0: Settings(), 1: Settings(figures=4), 2: Settings(risk_change=9, risk_size=90)}
    centre, scale, beta = np.array([0.1, 1.2]), np.array([1.2, 0.9]), np.array([0.3, -0.4])
    with prepare(frame(spark, rows), FitRequest.of("time", "event", ["x1", "x2"]), by) as ready:
        grid = [r.time for r in pooled_grid(ready.released_counts).orderBy("time").collect()]
        slotted = risksets.assign_slots(ready.moved, grid)
        knobs = ready.knobs.withColumn("n_slots", F.lit(len(grid)))
        effective = risksets.effective_slots(risksets.at_risk(risksets.slot_sums(slotted, [], F.lit(1.0)), knobs), knobs)
        s0, s1, s2 = Evaluator(slotted, effective, by, {0: Design(ready.sites, grid, centre, scale)}, (16.0, 16.0), {0: 20.0}, ready.n_rows)({0: beta})[0]
        moved = ready.moved.toPandas()
    total = np.zeros((len(grid), 7))
    for site, s in by.items():
        own = moved[moved.site == site]
        x = (own[["x0", "x1"]].to_numpy() - centre) / scale
        at = own.time.to_numpy()[None, :] >= np.array(grid)[:, None]
        a0, a1, a2 = sums_at(x, np.exp(x @ beta), at)
        slots = shown_slots(at.sum(axis=1).tolist(), [], s.risk_change, s.risk_size)
        total += round_figures_np(round_figures_np(np.hstack([a0[:, None], a1, a2.reshape(-1, 4)])[slots], s.figures), 7)
    # a sum on the edge of its last figure may round either way
    close = lambda got, want: np.allclose(got, want, rtol=2e-3, atol=1e-9) and np.mean(np.isclose(got, want, rtol=1e-9)) > 0.97
    assert close(s0, total[:, 0]) and close(s1, total[:, 1:3]) and close(s2.reshape(-1, 4), total[:, 3:])


def test_what_sites_and_the_coordinator_send_is_checked():
    whole = np.array([[9.0, 1, 1], [4.0, 1, 1]])
    assert pooled_arrays(whole, np.array([0, 1]), [], 2, 1)[2].shape == (2, 1, 1)
    for sums, slots, odd in ((whole, [0, 1], [3.0]), (whole[:1], [0], []), (whole, [0, 2], []), (np.where(whole == 4, np.inf, whole), [0, 1], [])):
        with pytest.raises(AlgorithmError):
            pooled_arrays(sums, np.array(slots), odd, 2, 1)
    one = np.ones(1)
    check_sent([1.0, 2.5], one, one, {1: OPEN})
    for grid, centre, scale in (([], one, one), ([2.0, 2.0], one, one), ([1.0, math.inf], one, one), ([1.0], one * math.nan, one), ([1.0], one, 0 * one)):
        with pytest.raises(AlgorithmError):
            check_sent(grid, centre, scale, {1: OPEN})
    with pytest.raises(UserInputError):
        check_sent([1.0, 2.5], one, one, {1: OPEN, 2: Settings(bin_width=1.0)})
    for answer in ({"events": -1, "z0": 1.0, "q0": 1.0}, {"events": 3, "z0": math.nan, "q0": 1.0}, {"events": 3, "z0": 1.0, "q0": -1.0}, {"events": 3, "z0": None, "q0": 1.0}):
        with pytest.raises(AlgorithmError, match="site 8"):
            check_answers({8: Row(**answer)}, 1)


def test_hooks_cannot_hide_bad_columns(spark):
    before = set(spark.sparkContext._jsc.getPersistentRDDs())
    rows = simulated(rows=200)
    for bad in ((0, -3.0, 1, 0.0, 0.0), (1, math.inf, 0, 0.0, 0.0), (2, 3.0, 2, 0.0, 0.0)):
        with pytest.raises(UserInputError):
            cox_fit(frame(spark, [*rows, bad]), "time", "event", ["x1"], settings=OPEN, row_hook=lambda d: d.filter("time >= 0 and time < 1e6 and event < 2"))
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= before


def held_site(early, events, n):
    x = np.linspace(-1, 1, n)
    rows = [(1.0, 0)] * early + events
    return [(1, t, e, float(v), 0.0) for (t, e), v in zip(rows, x)]


def test_held_events_abort_or_warn(spark):
    heavy = held_site(190, [(2.0 + t / 2, 1) for t in range(20)], 210)
    with pytest.raises(UserInputError, match="exceeds the configured cap 0.5"):
        cox_fit(frame(spark, heavy), "time", "event", ["x1"], settings=Settings())
    some = held_site(190, [(2.0, 1)] * 15 + [(3.0 + t / 2, 1) for t in range(12)], 217)
    got = cox_fit(frame(spark, some), "time", "event", ["x1"], settings=Settings())
    assert got["privacy_guards"]["max_held_event_fraction"] == pytest.approx(8 / 23) and any("0.348" in w for w in got["warnings"])


def test_collinear_terms_do_not_converge(spark):
    rows = [(s, t, e, a, a) for s, t, e, a, _ in simulated()]
    got = cox_fit(frame(spark, rows), "time", "event", ["x1", "x2"], settings=OPEN)
    assert not got["converged"] or math.isnan(got["model"]["x1"]["SE"]) or abs(got["model"]["x1"]["SE"]) > 10
    assert got["warnings"]


def test_coded_rows_fit_like_numbers(spark):
    rng = np.random.default_rng(1)
    base = "http://ncicb.nci.nih.gov/xml/owl/EVS/Thesaurus.owl#"
    rows = [(s, t, e, a, int(rng.integers(0, 2))) for s, t, e, a, _ in simulated(rows=400)]
    plain = cox_fit(frame(spark, rows, "site long, time double, event int, x1 double, f int"), "time", "event", ["x1", "f"], settings=OPEN)
    text = [(s, repr(t), base + ("C99799" if e else "C37987"), f" {a!r} ", f"<{base}{'C16576' if f else 'C20197'}>") for s, t, e, a, f in rows]
    text += [(0, "1.0", base + "C54031", "1", base + "C16576"), (0, "x", base + "C99799", "1", base + "C16576"), (1, "2", base + "C99799", "1", base + "C00000")]
    coded = cox_fit(
        frame(spark, text, "site long, `ncit:T` string, `ncit:S` string, `ncit:A` string, `ncit:X` string"), "ncit:T",
        {"ncit:S": {"event": ["ncit:C99799"], "censored": ["ncit:C37987"], "missing": ["ncit:C54031"]}},
        ["ncit:A", {"ncit:X": {"categories": {"male": ["ncit:C20197"], "female": ["ncit:C16576"]}, "reference": "male"}}], settings=OPEN,
    )
    assert coded["model"]["ncit:A"]["Coef"] == pytest.approx(plain["model"]["x1"]["Coef"], abs=1e-9)
    assert coded["model"]["ncit:X[female]"]["Coef"] == pytest.approx(plain["model"]["f"]["Coef"], abs=1e-9)
    guarded = cox_fit(frame(spark, rows, "site long, time double, event int, x1 double, f int"), "time", "event", ["x1", {"f": {"categories": {"n": [0], "y": ["1"]}, "reference": "n"}}], settings=Settings(threshold=4, risk_change=3, risk_size=20, row_factor=5), limits=Limits(held_share=None))
    assert guarded["privacy_guards"]["active"] and math.isfinite(guarded["model"]["f[y]"]["Coef"])


def test_sites_settings_and_refusals(spark):
    df = frame(spark, simulated(rows=150))
    by = {0: Settings(), 1: Settings(bin_width=2.0, risk_change=3), 2: Settings.at("strict", row_factor=1, risk_size=40)}
    two = cox_fit(df, "time", "event", ["x1"], sites=[0, 2], settings=by, limits=Limits(held_share=None))
    assert two["privacy_guards"]["max_min_time_event_count"] == 5
    assert guard_summary({0: OPEN}) == ({"active": False, "max_min_risk_set_change": 1, "time_binning": False, "max_min_time_event_count": 1, "max_min_risk_set_size": None}, None)
    with pytest.raises(UserInputError, match="grid"):
        cox_fit(df, "time", "event", ["x1"], settings=by, limits=Limits(held_share=None))  # bins at one site only
    for kwargs, error in (
        ({"sites": [0, 8]}, UserInputError), ({"covariates": ["nosuch"]}, UserInputError), ({"limits": Limits(terms=1), "covariates": ["x1", "x2"]}, UserInputError),
        ({"limits": Limits(grid=5)}, UserInputError), ({"selection": {"x1": {"start": 0}}}, PrivacyThresholdViolation), ({"settings": {0: Settings()}}, AlgorithmError),
        ({"row_hook": lambda d: d.filter("site <> 1")}, PrivacyThresholdViolation), ({"time": "x1"}, UserInputError),
    ):
        with pytest.raises(error):
            cox_fit(**{"df": df, "time": "time", "outcome": "event", "covariates": ["x2"], "settings": Settings()} | kwargs)
    with pytest.raises(PrivacyThresholdViolation):
        cox_fit(frame(spark, simulated(rows=100)), "time", "event", ["x1"], settings=Settings())
