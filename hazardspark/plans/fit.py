"""Cox regression with Breslow ties over sites: Newton-Raphson on guarded risk-set sums.

Each evaluation is one Spark query: sums per (site, slot), accumulated to risk
sets, held back and rounded site by site, then pooled. Only the pooled sums, one
row per point of the grid, reach the driver. Coefficients go out as a row per
site, so every evaluation has the same plan. Everything that does not depend on
them (slots, held slots) is set once per fit.

Several fits run as one: each has sites of its own, and a round evaluates all
fits that are not done in a single query (``cox_fits``). A single fit is a batch
of one. Before the first round there are three queries: sizes (which fills the
cache of rows), event sums with the grid, and the held shares.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import HELD_WARNING, MAX_ROUNDS, STABLE_STEP_TOLERANCE, STEP_TOLERANCE, Limits, Settings, load_limits, load_settings
from ..errors import AlgorithmError, UserInputError
from ..functions.exact import above, total
from ..functions.keys import Key
from ..functions.rounding import round_figures_np
from ..functions.stats import chi_square_tail, two_sided_p
from ..operators import risksets
from ..operators.times import pooled_grid
from ..request import FitRequest
from .curves import survival_curves
from .prepare import Prepared, prepare


def event_sums(counts: DataFrame, n_terms: int) -> DataFrame:
    """Per site: events, sums and sums of squares of the terms over event rows, and event times. counts: ``times.event_counts`` with terms."""
    names = [f"{c}{i}" for c in "zq" for i in range(n_terms)]
    every = [c for c in counts.columns if c.split("__")[0] in names]
    summed = counts.groupBy("site").agg(F.sum("freq").alias("events"), *[F.sum(c).alias(c) for c in every], F.count(F.lit(1)).alias("times"))
    return summed.select("site", "events", *[total(c, every) for c in names], "times")


def standardisation(z: np.ndarray, squares: np.ndarray, events: float) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scale over event rows, to two figures; a term without spread has scale 1."""
    centre = z / events
    spread = np.sqrt(np.maximum(squares / events - centre**2, 0))
    return round_figures_np(centre, 2), round_figures_np(np.where(spread > 0, spread, 1.0), 2)


def derivatives(s0, s1, s2, freq, z) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the partial log-likelihood."""
    s0, s1, s2, freq = (np.asarray(a, dtype=float) for a in (s0, s1, s2, freq))
    if len(s0) != len(freq):
        raise AlgorithmError("risk-set sums and event counts differ in length")
    if not (s0 > 0).all():
        raise AlgorithmError("a risk-set sum is not positive; the risk sets are inconsistent")
    mean = s1 / s0[:, None]
    spread = s2 / s0[:, None, None] - mean[:, :, None] * mean[:, None, :]
    return np.asarray(z, dtype=float) - freq @ mean, -np.einsum("t,tij->ij", freq, spread)


def log_likelihood(beta, z, freq, s0) -> float:
    s0 = np.asarray(s0, dtype=float)
    if len(s0) != len(freq):
        raise AlgorithmError("risk-set sums and event counts differ in length")
    if not ((s0 > 0) & np.isfinite(s0)).all():
        raise AlgorithmError("a risk-set sum is not positive; there is no log-likelihood")
    return float(np.dot(beta, z) - np.dot(np.asarray(freq, dtype=float), np.log(s0)))


def model_results(beta, hessian, scale, terms: list[str], loglik: float) -> dict:
    """Estimates, errors, tests and warnings; warnings judge the standardised space, estimates are in the original one."""
    beta, scale = np.asarray(beta, dtype=float), np.asarray(scale, dtype=float)
    p = len(beta)
    try:
        covariance = np.linalg.inv(-hessian)
        with np.errstate(invalid="ignore"):
            se = np.sqrt(np.diag(covariance))
    except np.linalg.LinAlgError:
        covariance, se = np.zeros((p, p)), np.full(p, np.nan)
    z = np.array([b / s if s > 0 else math.nan for b, s in zip(beta, se)])
    warnings = [
        f"covariate '{t}' may perfectly predict the event (coefficient {b}, standard error {s}); results may be unreliable"
        for t, b, s in zip(terms, beta, se)
        if not (math.isfinite(b) and math.isfinite(s)) or abs(b) > 10 or abs(s) > 10
    ]
    coef, error = beta / scale, se / scale
    with np.errstate(over="ignore"):
        table = {
            t: {"Coef": c, "Exp(coef)": float(np.exp(c)), "SE": e, "lower_CI": float(np.exp(c - 1.96 * e)), "upper_CI": float(np.exp(c + 1.96 * e)), "Z": v, "p-value": two_sided_p(v)}
            for t, c, e, v in zip(terms, coef.tolist(), error.tolist(), z.tolist())
        }
    wald = float(beta @ (-hessian) @ beta)
    return {
        "model": table,
        "overall_p_value": chi_square_tail(wald, p),
        "aic": -2 * loglik + 2 * p if math.isfinite(loglik) else None,
        "covariance": (covariance / np.outer(scale, scale)).tolist(),
        "warnings": warnings,
    }


@dataclass
class Design:
    """What is set once per fit: its sites, grid, centres and scales."""

    sites: list[int]
    grid: list[float]
    centre: np.ndarray
    scale: np.ndarray


ONE_TASK_BYTES = 64 << 20


@dataclass
class Evaluator:
    """Pooled risk-set sums at given coefficients, from rows that carry their slot.

    effective: as ``risksets`` has it; settings: by site.
    terms: what no standardised term is over, in absolute value; reach: what the root of the sum of their squares is not
    over, by fit; n: rows of a site, at most.
    """

    rows: DataFrame
    effective: DataFrame
    settings: dict[int, Settings]
    designs: dict[int, Design]
    terms: tuple[float, ...]
    reach: dict[int, float]
    n: int

    @property
    def bounds(self) -> risksets.Bounds:
        """Of what is summed: weights are scaled to 1 at most."""
        return risksets.Bounds(1.0, self.terms, self.n)

    def most(self, fit: int, beta: np.ndarray) -> float:
        """A power of two that no weight of a fit is over."""
        score = min(float(np.linalg.norm(beta)) * self.reach[fit], float(np.abs(beta) @ np.array(self.terms)))
        return above(math.exp(min(score, 600.0)) * 1.001)

    def sent(self, betas: dict[int, np.ndarray]) -> DataFrame:
        """A row per site of the given fits: fit, b, c, d per term, points of the grid, figures, and the power of two that no weight there is over."""
        p = len(self.terms)
        rows: dict = {c: [] for c in ("site", "fit", "n_slots", "figures", "most")} | {f"{c}{i}": [] for c in "bcd" for i in range(p)}
        for fit, beta in betas.items():
            own = self.designs[fit]
            most = self.most(fit, beta)
            for site in own.sites:
                rows["site"].append(site)
                rows["fit"].append(fit)
                rows["most"].append(most)
                rows["n_slots"].append(len(own.grid))
                rows["figures"].append(self.settings[site].figures)
                for i in range(p):
                    for c, x in zip("bcd", (beta[i], own.centre[i], own.scale[i])):
                        rows[f"{c}{i}"].append(float(x))
        kinds = {"site": pa.int64(), "fit": pa.int64(), "n_slots": pa.int32(), "figures": pa.int32()}
        return self.rows.sparkSession.createDataFrame(pa.table({c: pa.array(v, kinds.get(c, pa.float64())) for c, v in rows.items()}))

    def release(self, betas: dict[int, np.ndarray]) -> DataFrame:
        """Per (site, slot) what the site releases: held sums, rounded; with fit and most."""
        p = len(self.terms)
        sent = self.sent(betas)
        rows = self.rows.join(F.broadcast(sent.drop("n_slots", "figures")), "site")  # a row per site
        xs = [f"(x{i} - c{i}) / d{i}" for i in range(p)]
        score = " + ".join(["0.0D", *[f"b{i} * ({x})" for i, x in enumerate(xs)]])
        sums = risksets.slot_sums(rows, [F.expr(x) for x in xs], F.expr(f"exp({score}) / most"), [], self.bounds)
        sites = sum(len(self.designs[f].sites) for f in betas)
        longest = max(len(self.designs[f].grid) for f in betas)
        # what is left is small: one task then accumulates, holds, rounds and pools without moving it again
        small = 8 * sites * longest * len(risksets.names(p)) <= ONE_TASK_BYTES
        sums = sums.drop("n").repartition(1) if small else sums.drop("n").repartition("site")
        risk = risksets.at_risk(sums, sent, None, ("fit", "most", "figures"), "most")
        return risksets.released(risk, self.effective, sent, p)

    def __call__(self, betas: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        p = len(self.terms)
        sites = max(len(self.designs[f].sites) for f in betas)
        release = self.release(betas)
        got = risksets.pooled(release, p, ["fit", "most"], self.bounds, "most", sites).toPandas().sort_values(["fit", "slot"])
        out = {}
        for fit in betas:
            own = got[got["fit"] == fit]
            out[fit] = pooled_arrays(own[risksets.names(p)].to_numpy(float), own["slot"].to_numpy(), own["odd"].dropna().tolist(), len(self.designs[fit].grid), p)
        return out


def pooled_arrays(sums: np.ndarray, slots: np.ndarray, odd: list, points: int, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """s0, s1 and s2 of pooled rows, once they are found to be complete, finite and possible."""
    if odd:
        raise AlgorithmError(f"site {int(min(odd))}: released risk-set sizes must be finite, not negative, positive at first, and never grow")
    if len(slots) != points or (slots != np.arange(points)).any():
        raise AlgorithmError("the pooled risk-set sums do not cover the grid")
    if not np.isfinite(sums).all():
        raise AlgorithmError("a pooled risk-set sum is not finite")
    s2 = np.empty((points, p, p))
    upper = np.triu_indices(p)
    s2[:, upper[0], upper[1]] = s2[:, upper[1], upper[0]] = sums[:, 1 + p :]
    return sums[:, 0], sums[:, 1 : 1 + p], s2


def check_sent(grid: list[float], centre: np.ndarray, scale: np.ndarray, settings: dict[int, Settings]) -> None:
    """What goes out to sites: a finite, growing grid on the bins of every site, finite centres, positive scales."""
    points = np.asarray(grid, dtype=float)
    if not len(points) or not np.isfinite(points).all() or (np.diff(points) <= 0).any():
        raise AlgorithmError("the event-time grid must be finite and strictly increasing")
    if not np.isfinite(centre).all() or not (np.isfinite(scale) & (scale > 0)).all():
        raise AlgorithmError("centres must be finite and scales positive")
    for width in {s.bin_width for s in settings.values() if s.bin_width}:
        if not np.allclose(points / width, np.round(points / width)):
            raise UserInputError("the grid does not lie on the time bins of every site")


def check_answers(answers: dict, terms: int) -> None:
    """What sites answer first: events counted, sums finite, sums of squares not negative."""
    for site, r in answers.items():
        z, squares = ([r[f"{c}{i}"] for i in range(terms)] for c in "zq")
        if r.events is None or r.events < 0 or not all(x is not None and math.isfinite(x) for x in (*z, *squares)) or any(x < 0 for x in squares):
            raise AlgorithmError(f"site {site}: sums must be finite and counts not negative")


@dataclass
class Path:
    """Where the optimiser ended."""

    beta: np.ndarray
    hessian: np.ndarray
    s0: np.ndarray
    loglik: float
    null: float
    rounds: int
    converged: bool
    tolerance: float
    cause: str | None
    visited: list = field(default_factory=list)


def newton(freq, z, tolerance: float, rounds: int = MAX_ROUNDS) -> Generator[np.ndarray, tuple, Path]:
    """Newton-Raphson with step halving towards the last accepted point; a halved try uses up a round.

    Yields coefficients, takes the pooled sums there, and ends with a ``Path``.
    A log-likelihood that falls by more than ``tolerance`` is a try to take
    back. The point converges if the next step is within STEP_TOLERANCE, or
    within STABLE_STEP_TOLERANCE after two evaluations without progress; that
    step is not taken.
    """
    beta = np.zeros(len(z))
    best: tuple | None = None
    null, step, still = math.nan, None, 0
    converged, reached, cause, n = False, STEP_TOLERANCE, None, 0
    visited = []
    for n in range(1, rounds + 1):
        s0, s1, s2 = yield beta
        here = log_likelihood(beta, z, freq, s0)
        visited.append((beta.copy(), here))
        if n == 1:
            null = here
        if best is not None and here < best[3] - tolerance:
            step = step * 0.5
            beta = best[0] - step
            continue
        gradient, hessian = derivatives(s0, s1, s2, freq, z)
        still = still + 1 if best is not None and abs(here - best[3]) <= tolerance else 0
        best = (beta, hessian, s0, here)
        try:
            step = np.linalg.solve(hessian, gradient)
        except np.linalg.LinAlgError as error:
            cause = f"the Hessian is singular: {error}"
            break
        size = float(np.max(np.abs(step)))
        if not math.isfinite(size):
            cause = "the Newton step is not finite"
            break
        if size <= STEP_TOLERANCE:
            converged = True
            break
        if still >= 2 and size <= STABLE_STEP_TOLERANCE:
            converged, reached = True, STABLE_STEP_TOLERANCE
            break
        if n == rounds:
            break
        beta = beta - step
    if best is None:
        raise AlgorithmError("no evaluation was accepted")
    return Path(*best, null, n, converged, reached, cause, visited)


def optimise_all(evaluate: Callable, runs: dict[int, Generator]) -> dict[int, Path]:
    """Drives all runs together: one evaluation a round of those that are not done."""
    asked, done = {fit: next(run) for fit, run in runs.items()}, {}
    while asked:
        got, again = evaluate(asked), {}
        for fit, sums in got.items():
            try:
                again[fit] = runs[fit].send(sums)
            except StopIteration as end:
                done[fit] = end.value
        asked = again
    return done


def optimise(evaluate: Callable, freq, z, tolerance: float, rounds: int = MAX_ROUNDS) -> Path:
    """One run by itself; evaluate: from coefficients to pooled sums."""
    return optimise_all(lambda asked: {0: evaluate(asked[0])}, {0: newton(freq, z, tolerance, rounds)})[0]


def guard_summary(settings: dict[int, Settings]) -> tuple[dict, str | None]:
    """Which guards were on at any site, and the warning that says so."""
    all_of = settings.values()
    k, m = max(s.risk_change for s in all_of), max(s.time_events for s in all_of)
    binning = any(s.bin_width for s in all_of)
    floors = [s.risk_size for s in all_of if s.risk_size is not None]
    floor = max(floors) if floors else None
    active = k > 1 or binning or m > 1
    out = {"active": active, "max_min_risk_set_change": k, "time_binning": binning, "max_min_time_event_count": m, "max_min_risk_set_size": floor}
    if not active:
        return out, None
    also = f", risk sets of {floor} rows at least" if floor is not None and k > 1 else ""
    return out, f"privacy guards were active (risk-set change of {k} at least, time bins {'on' if binning else 'off'}, {m} events per time at least{also}); the estimates are approximate"


def jitter(events: dict[int, int], settings: dict[int, Settings]) -> float:
    """How far rounding at the sites may move a log-likelihood."""
    return max(1e-12, sum(n * 10.0 ** (1 - settings[s].released_figures) for s, n in events.items()))


def cox_fit(
    df: DataFrame,
    time: str,
    outcome: object,
    covariates: object,
    sites: object = None,
    profiles: object = None,
    selection: object = None,
    settings: Settings | dict[int, Settings] | None = None,
    limits: Limits | None = None,
    row_hook: Callable[[DataFrame], DataFrame] | None = None,
    key: Key | None = None,
    rounds: int = MAX_ROUNDS,
) -> dict:
    """Fit a model over the sites of ``df`` (column site); see FitRequest for the request's form.

    Returns the model table by term, tests, the baseline hazard, curves, and
    what guards were on. Raises one of ``errors`` if the request, a site or the
    held share of events does not allow a fit.
    """
    spark = df.sparkSession
    request = FitRequest.of(time, outcome, covariates, sites, profiles, selection)
    limits = limits or load_limits(spark)
    terms = request.covariates.terms
    if len(terms) > limits.terms:
        raise UserInputError(f"the model has more than {limits.terms} terms")
    settings = settings if settings is not None else load_settings(spark)
    with prepare(df, request, settings, row_hook, key, limits.grid) as ready:
        return _fitted(ready, request, limits, rounds, dict.fromkeys(ready.sites, 0))[0]


FIT_SHIFT = 32


def copied_site(copies: int) -> Callable:
    """Makes, of a site in fit f, that in fit f * copies + i; sites as ``cox_fits`` numbers them."""
    one = 1 << FIT_SHIFT
    return lambda site, i: site + (site - site % one) * (copies - 1) + i * one


def cox_fits(
    df: DataFrame,
    by: str,
    time: str,
    outcome: object,
    covariates: object,
    settings: dict[int, Settings],
    limits: Limits | None = None,
    key: Key | None = None,
    rounds: int = MAX_ROUNDS,
    copies: int = 1,
) -> dict[int, dict]:
    """Many fits of one request in one go: column ``by`` (an integer from 0) says to which fit a row belongs, ``settings`` the guards of each.

    Returns the result of each fit, as ``cox_fit`` would give it for its rows alone. A round evaluates all fits in one
    query. A site, in a fit, is of its own; site ids must be from 0 and below 2^32. If one fit is refused, all are.

    copies: rows of number f in ``by`` belong to as many fits, f * copies and those after it. They are cached once before
    they are copied, and a copy has tasks of its own, so what a task reads does not grow with the copies.
    """
    spark = df.sparkSession
    request = FitRequest.of(time, outcome, covariates)
    limits = limits or load_limits(spark)
    if len(request.covariates.terms) > limits.terms:
        raise UserInputError(f"the model has more than {limits.terms} terms")
    asked = sorted({f // copies for f in settings})
    if len(settings) != copies * len(asked):
        raise UserInputError("each copy of a fit needs settings")
    each = F.shiftleft(F.col(f"`{by}`").cast("long"), FIT_SHIFT) + F.col("site").cast("long")
    within = (F.col("site") >= 0) & (F.col("site") < 1 << FIT_SHIFT) & F.col(f"`{by}`").isin(asked)
    df = df.filter(within).withColumn("site", each)
    with prepare(df, request, lambda site: settings[site >> FIT_SHIFT], None, key, limits.grid, copies, copied_site(copies)) as ready:
        return _fitted(ready, request, limits, rounds, {s: s >> FIT_SHIFT for s in ready.sites})


def _sums_and_grid(ready: Prepared, fits: DataFrame, p: int, most: int) -> tuple[dict, dict[int, list]]:
    """In one query: event sums by site, and the pooled grid of each fit as (time, freq); no more than ``most`` points."""
    sums = event_sums(ready.counts, p)
    grid = pooled_grid(ready.released_counts.join(F.broadcast(fits), "site"), ["fit"]).orderBy("fit", "time").limit(most)
    rows = sums.unionByName(grid, allowMissingColumns=True).collect()
    grids: dict[int, list] = {}
    for r in rows:
        if r.site is None:
            grids.setdefault(r.fit, []).append((r.time, r.freq))
    return {r.site: r for r in rows if r.site is not None}, {f: sorted(g) for f, g in grids.items()}


def _widths(rows: DataFrame, designs: dict[int, Design], p: int) -> DataFrame:
    """fit, m0.. and square: powers of two that no standardised term, and no sum of their squares, is over; nothing finer is told."""
    sent: dict = {"site": [], "fit": []} | {f"{c}{i}": [] for c in "cd" for i in range(p)}
    for fit, own in designs.items():
        for site in own.sites:
            for name, x in (("site", site), ("fit", fit), *((f"{c}{i}", float(v[i])) for c, v in (("c", own.centre), ("d", own.scale)) for i in range(p))):
                sent[name].append(x)
    kinds = {"site": pa.int64(), "fit": pa.int64()}
    each = rows.join(F.broadcast(rows.sparkSession.createDataFrame(pa.table({c: pa.array(v, kinds.get(c, pa.float64())) for c, v in sent.items()}))), "site")
    x = [F.abs((F.col(f"x{i}") - F.col(f"c{i}")) / F.col(f"d{i}")) for i in range(p)]
    square = sum((a * a for a in x), F.lit(0.0))

    def power(most):
        return F.when(most > 0, F.pow(F.lit(2.0), F.ceil(F.log2(most)) + 1)).otherwise(1.0)

    return each.groupBy("fit").agg(*[power(F.max(a)).alias(f"m{i}") for i, a in enumerate(x)], power(F.max(square)).alias("square"))


def _fitted(ready: Prepared, request: FitRequest, limits: Limits, rounds: int, fit_of: dict[int, int]) -> dict[int, dict]:
    spark, terms = ready.rows.sparkSession, request.covariates.terms
    p, fits = len(terms), sorted(set(fit_of.values()))
    sites = {f: [s for s in ready.sites if fit_of[s] == f] for f in fits}
    site_fits = spark.createDataFrame(pa.table({"site": pa.array(ready.sites, pa.int64()), "fit": pa.array([fit_of[s] for s in ready.sites], pa.int64())}))
    sums, grids = _sums_and_grid(ready, site_fits, p, (limits.grid + 1) * len(fits))
    require_all(ready.sites, sums)
    check_answers(sums, p)
    over = f"the event-time grid is over the cap of {limits.grid} points; use wider time bins"
    if any(r.times > limits.grid * ready.settings[s].time_events for s, r in sums.items()):
        raise UserInputError(over)
    designs, freqs, zs, tolerances = {}, {}, {}, {}
    for f in fits:
        if len(grids.get(f, [])) > limits.grid:
            raise UserInputError(over)
        grid, freq = [t for t, _ in grids.get(f, [])], np.array([n for _, n in grids.get(f, [])], dtype=float)
        events = float(freq.sum())
        if not events:
            raise UserInputError("there are no events to fit")
        # pooled in the order of sites
        z, squares = (np.array([math.fsum(sums[s][f"{c}{i}"] for s in sites[f]) for i in range(p)], dtype=float) for c in "zq")
        centre, scale = standardisation(z, squares, events)
        own = {s: ready.settings[s] for s in sites[f]}
        check_sent(grid, centre, scale, own)
        designs[f], freqs[f], zs[f] = Design(sites[f], grid, centre, scale), freq, (z - centre * events) / scale
        tolerances[f] = jitter({s: sums[s].events for s in own}, own)
    grid_of = pa.table({"site": pa.array(ready.sites, pa.int64()), "grid": pa.array([designs[fit_of[s]].grid for s in ready.sites], pa.list_(pa.float64()))})
    points = spark.createDataFrame(grid_of)  # sites x grid cap at most
    knobs = ready.knobs.join(F.broadcast(points.select("site", F.size("grid").alias("n_slots"))), "site")
    longest = max(len(d.grid) for d in designs.values())

    def slotted(x: DataFrame) -> DataFrame:
        return x.join(F.broadcast(points), "site").withColumn("slot", risksets.as_of(F.col("time"), F.col("grid"), longest)).drop("grid")

    rows = slotted(ready.moved).drop("time", "event").persist()
    groups = [F.col(f"k{i}") == 1 for i in range(ready.n_groups)]
    counted = risksets.slot_sums(rows, [], F.lit(1.0), groups, risksets.Bounds(1.0, (), ready.n_rows))
    risk = risksets.at_risk(counted, knobs.select("site", "n_slots")).persist()
    effective = risksets.effective_slots(risk, knobs, ready.n_groups).persist()
    try:
        counts = slotted(ready.released_counts)
        told = risksets.held_event_share(risksets.released(risk, effective, knobs, 0), counts, knobs).unionByName(_widths(rows, designs, p), allowMissingColumns=True).collect()
        shares = {r.site: r["share"] for r in told if r.fit is None}
        require_all(ready.sites, shares)
        held = {f: max(shares[s] for s in sites[f]) for f in fits}
        for f in fits:
            if limits.held_share is not None and held[f] > limits.held_share:
                raise UserInputError(f"the held-event fraction {held[f]:.3f} exceeds the configured cap {limits.held_share}: use larger sites or weaker risk-set guards")
        wide = {r.fit: r for r in told if r.fit is not None}
        terms_most = tuple(max(r[f"m{i}"] for r in wide.values()) for i in range(p))
        evaluate = Evaluator(rows, effective, ready.settings, designs, terms_most, {f: math.sqrt(r.square) for f, r in wide.items()}, ready.n_rows)
        paths = optimise_all(evaluate, {f: newton(freqs[f], zs[f], tolerances[f], rounds) for f in fits})
    finally:
        for x in (rows, risk, effective):
            x.unpersist()
    own = {f: {s: ready.settings[s] for s in sites[f]} for f in fits}
    sender = provenance(spark)
    return {f: _result(request, limits, terms, designs[f], freqs[f], paths[f], own[f], held[f], sender) for f in fits}


def provenance(spark: SparkSession) -> dict:
    """Who asks, as far as Spark knows: its user, the organisation that is configured, and the time."""
    return {"user": spark.sparkContext.sparkUser(), "organization": spark.conf.get("spark.hazard.organization", None), "timestamp": datetime.now(UTC).isoformat(timespec="seconds")}


def _result(request: FitRequest, limits: Limits, terms: list[str], design: Design, freq: np.ndarray, path: Path, settings: dict[int, Settings], held: float, sender: dict) -> dict:
    p, centre, scale, grid = len(terms), design.centre, design.scale, design.grid
    summary, warning = guard_summary(settings)
    summary["max_held_event_fraction"] = held
    held_warning = None
    if held > HELD_WARNING:
        held_warning = f"{held:.3f} of a site's events were scored against a held risk set, above {HELD_WARNING}; the estimates may be dominated by them"
    out = model_results(path.beta, path.hessian, scale, terms, path.loglik)
    cause = f"Newton-Raphson stopped: {path.cause}" if path.cause else None
    late = None if path.converged else f"Newton-Raphson did not converge in {path.rounds} rounds; errors and tests may be unreliable"
    ratio = 2 * (path.loglik - path.null)
    hazard, curves = survival_curves(freq, path.s0, grid, path.beta, centre, scale, terms, request.expanded_profiles, limits.curve_figures)
    return {
        "model": out["model"],
        "overall_p_value": out["overall_p_value"],
        "aic": out["aic"],
        "degrees_of_freedom": p,
        "warnings": [w for w in (*out["warnings"], cause, warning, held_warning, late) if w],
        "converged": path.converged,
        "n_iterations": path.rounds,
        "convergence_tolerance": path.tolerance,
        "log_likelihood": path.loglik,
        "log_likelihood_null": path.null,
        "lr_statistic": ratio,
        "lr_p_value": chi_square_tail(ratio, p),
        "n_events": int(freq.sum()),
        "covariance": out["covariance"],
        "algorithm_version": VERSION,
        "variables_to_stratify": request.selection,
        "provenance": {**sender, "input_arguments": request.given},
        "baseline_cumulative_hazard": hazard,
        "survival_curves": curves,
        "curve_time_sig_figs": limits.curve_figures,
        "privacy_guards": summary,
    }


VERSION = "0.1.0"


def require_all(sites: list[int], answered: dict) -> None:
    """Every site must have answered; a fit without one would be of other rows than asked for."""
    absent = [s for s in sites if s not in answered]
    if absent:
        raise AlgorithmError(f"site {absent[0]} did not answer")


def model_frame(spark, result: dict) -> DataFrame:
    """The model table of a result as a DataFrame, one row per term."""
    names = ["Coef", "Exp(coef)", "SE", "lower_CI", "upper_CI", "Z", "p-value"]
    rows = [(t, *[float(v[n]) for n in names]) for t, v in result["model"].items()]
    return spark.createDataFrame(rows, "term string, coef double, exp_coef double, se double, lower_ci double, upper_ci double, z double, p_value double")
