"""Registered queries over the star-schema tables, and their SQL for DuckDB.

Floating sums depend on the order of addition, so both sides round them to nine
significant figures; counts are BIGINT on both.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import OPEN, Settings
from .functions.keys import code_key, covariate_key, term_key, to_number
from .functions.rounding import round_figures
from .operators import guards, risksets, times
from .errors import AlgorithmError
from .operators.encode import complete, drop_incomplete, encode, recode_outcome, select_rows
from .plans.bias import bias_study
from .plans.cohorts import LAGS_SQL, REPETITIONS, SHIPMENTS_SQL, SIMULATED_SQL, TRUTH, lags, shipments, simulated
from .oracles import fit_sql, model_sql, sig, stage_one
from .plans.curves import survival_curves
from .plans.fit import cox_fit, derivatives, event_sums, log_likelihood, model_frame, require_all, standardisation
from .plans.prepare import plain_rows, prepare
from .request import FitRequest, parse_covariates
from .sources.tables import read_stations
from .sources.triples import flatten_patients

FIGURES = 9
BETA = (0.5, -0.3)
WEEK = 168.0
SEG = {"seg": {"categories": {s: [s] for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY")}, "reference": "BUILDING", "missing": ["HOUSEHOLD"]}}
PRIO = {"prio": {"scores": {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4}}}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its name, with its SQL if SQL can express it."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def fig(x: Column, figures: int = FIGURES) -> Column:
    return round_figures(x.cast("double"), figures)


SHIP, LAG = f"WITH {SHIPMENTS_SQL}", f"WITH RECURSIVE {LAGS_SQL}"


def _plain(spark, sf_dir: str) -> DataFrame:
    """Shipments as prepared rows with two terms."""
    return plain_rows(shipments(spark, sf_dir), FitRequest.of("time", "event", ["x1", "x2"]))


def _weekly(spark, sf_dir: str) -> DataFrame:
    """Lags in weekly bins, as prepared rows."""
    rows = plain_rows(lags(spark, sf_dir), FitRequest.of("time", "event", ["value"]))
    return rows.withColumn("time", times.bin_times(F.col("time"), WEEK))


WEEKLY_SQL = f"weekly AS (SELECT site, floor(time / {WEEK}::DOUBLE) * {WEEK}::DOUBLE AS time, event, value FROM lags WHERE time IS NOT NULL AND value IS NOT NULL)"


# --- sums and counts ----------------------------------------------------------


@query(f"{SHIP} SELECT site, count(*) AS events, {sig('sum(x1)')} AS z0, {sig('sum(x2)')} AS z1 FROM shipments WHERE event = 1 GROUP BY site")
def event_case_sums(spark, sf_dir):
    s = event_sums(times.event_counts(_plain(spark, sf_dir), 2), 2)
    return s.select("site", "events", fig(F.col("z0")).alias("z0"), fig(F.col("z1")).alias("z1"))


@query(f"{SHIP} SELECT site, {sig('sum(x1 * x1)')} AS q0, {sig('sum(x2 * x2)')} AS q1 FROM shipments WHERE event = 1 GROUP BY site")
def event_case_squares(spark, sf_dir):
    s = event_sums(times.event_counts(_plain(spark, sf_dir), 2), 2)
    return s.select("site", fig(F.col("q0")).alias("q0"), fig(F.col("q1")).alias("q1"))


@query(
    f"""{SHIP}, m AS (SELECT avg(x1) AS c0, avg(x2) AS c1, sqrt(greatest(avg(x1 * x1) - avg(x1) * avg(x1), 0)) AS s0,
 sqrt(greatest(avg(x2 * x2) - avg(x2) * avg(x2), 0)) AS s1 FROM shipments WHERE event = 1)
SELECT {sig('c0', 2)} AS centre0, {sig('c1', 2)} AS centre1, {sig('s0', 2)} AS scale0, {sig('s1', 2)} AS scale1 FROM m"""
)
def pooled_standardisation(spark, sf_dir):
    found = event_sums(times.event_counts(_plain(spark, sf_dir), 2), 2).collect()
    total = lambda c: sum(r[c] for r in found)
    centre, scale = standardisation(np.array([total("z0"), total("z1")]), np.array([total("q0"), total("q1")]), total("events"))
    return spark.createDataFrame([(*centre.tolist(), *scale.tolist())], "centre0 double, centre1 double, scale0 double, scale1 double")


@query(f"{SHIP} SELECT site, time, count(*) AS freq FROM shipments WHERE event = 1 GROUP BY site, time")
def event_time_counts(spark, sf_dir):
    return times.event_counts(_plain(spark, sf_dir))


@query(f"{SHIP} SELECT time, count(*) AS freq FROM shipments WHERE event = 1 GROUP BY time")
def pooled_event_grid(spark, sf_dir):
    return times.pooled_grid(times.event_counts(_plain(spark, sf_dir)))


@query(f"{LAG}, {WEEKLY_SQL} SELECT site, time, count(*) AS freq FROM weekly WHERE event = 1 GROUP BY site, time")
def binned_event_counts(spark, sf_dir):
    return times.event_counts(_weekly(spark, sf_dir))


@query(f"{SHIP} SELECT site, count(*) AS n_rows, sum(event)::BIGINT AS n_events FROM shipments GROUP BY site")
def sample_sizes(spark, sf_dir):
    request = FitRequest.of("time", "event", ["x1"])
    return guards.sizes(shipments(spark, sf_dir), "time", "event", request.covariates).select("site", F.col("rows").alias("n_rows"), F.col("events").alias("n_events"))


@query(
    f"""{SHIP}, c AS (SELECT * FROM shipments WHERE seg IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY'))
SELECT site, seg AS category, count(*) AS n_rows, sum(event)::BIGINT AS n_events FROM c GROUP BY site, seg"""
)
def category_sizes(spark, sf_dir):
    covariates = parse_covariates([SEG])
    coded = encode(shipments(spark, sf_dir), covariates)
    found = guards.sizes(coded, "time", "event", covariates, complete(coded, covariates.terms))
    names = [*covariates.categorical[0].labels, covariates.categorical[0].reference]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("category"), F.col(f"g{i}").alias("n_rows"), F.col(f"e{i}").alias("n_events")) for i, n in enumerate(names)]))
    return found.select("site", each.alias("c")).select("site", "c.*").filter("n_rows > 0")


@query(
    f"""{SHIP} SELECT site, count(*) > 10 AND count(*) >= 150 AND sum(event) > 10 AS admitted FROM shipments GROUP BY site"""
)
def site_admission(spark, sf_dir):
    request = FitRequest.of("time", "event", ["x1"])
    found = guards.sizes(shipments(spark, sf_dir), "time", "event", request.covariates).collect()
    sites = [r.site for r in found]
    return spark.createDataFrame(sorted(guards.admitted(found, sites, dict.fromkeys(sites, Settings())).items()), "site long, admitted boolean")


@query("SELECT r_regionkey::BIGINT AS site FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9990)")
def silent_sites(spark, sf_dir):
    """Sites that were asked but have no answer: a fit names them one by one."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    answers = read("customer").filter("c_acctbal > 9990").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    answered = {r[0]: r for r in answers.select("n_regionkey").distinct().collect()}
    silent = []
    for site in sorted(r[0] for r in read("region").select("r_regionkey").collect()):
        try:
            require_all([site], answered)
        except AlgorithmError:
            silent.append((site,))
    return spark.createDataFrame(silent, "site long")


# --- coercion, recoding, selection, encoding -----------------------------------


@query(f"{SHIP} SELECT site, count(*) AS n FROM shipments WHERE seg IN ('BUILDING', 'MACHINERY') AND prio IN ('1-URGENT', '2-HIGH') GROUP BY site")
def selected_values(spark, sf_dir):
    chosen = select_rows(shipments(spark, sf_dir), {"seg": ["BUILDING", " MACHINERY "], "prio": ["1-URGENT", "2-HIGH"]})
    return chosen.groupBy("site").agg(F.count(F.lit(1)).alias("n"))


@query(f"{SHIP} SELECT site, count(*) AS n, min(time) AS first, max(time) AS last FROM shipments WHERE time BETWEEN 10 AND 20 AND x1 >= 0.02 GROUP BY site")
def selected_range(spark, sf_dir):
    chosen = select_rows(shipments(spark, sf_dir), {"time": {"start": 10, "end": 20}, "x1": {"start": 0.02}})
    return chosen.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first"), F.max("time").alias("last"))


@query(f"{SHIP} SELECT CASE flag WHEN 'R' THEN 1.0::DOUBLE WHEN 'A' THEN 0.0::DOUBLE END AS outcome, count(*) AS n FROM shipments GROUP BY 1")
def outcome_recode(spark, sf_dir):
    coded = recode_outcome(shipments(spark, sf_dir), "flag", {"event": ["R"], "censored": [" A"], "missing": []})
    return coded.groupBy(F.col("flag").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


TEXTS = {"R": "concat('  ', cast(cast(time as int) as string), ' ')", "A": "'1.0d'", "N": "concat(cast(cast(time as int) as string), '.5e1')"}


@query(
    f"""{SHIP}, t AS (SELECT flag, trim(CASE flag WHEN 'R' THEN '  ' || time::INTEGER::VARCHAR || ' ' WHEN 'A' THEN '1.0d' ELSE time::INTEGER::VARCHAR || '.5e1' END) AS x FROM shipments)
SELECT flag, count(*) AS n, count(v) AS numbers, {sig('coalesce(sum(v), 0)')} AS total
FROM (SELECT flag, CASE WHEN regexp_full_match(x, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(x AS DOUBLE) END AS v FROM t) GROUP BY flag"""
)
def text_numbers(spark, sf_dir):
    text = F.expr(f"CASE flag WHEN 'R' THEN {TEXTS['R']} WHEN 'A' THEN {TEXTS['A']} ELSE {TEXTS['N']} END")
    value = to_number(text, "string")
    got = shipments(spark, sf_dir).select("flag", value.alias("v")).groupBy("flag")
    return got.agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("numbers"), fig(F.coalesce(F.sum("v"), F.lit(0.0))).alias("total"))


@query(
    f"""{SHIP} SELECT site, sum((seg = 'AUTOMOBILE')::INTEGER)::BIGINT AS automobile, sum((seg = 'FURNITURE')::INTEGER)::BIGINT AS furniture,
sum((seg = 'MACHINERY')::INTEGER)::BIGINT AS machinery, count(*) FILTER (seg = 'HOUSEHOLD') AS missing FROM shipments GROUP BY site"""
)
def categorical_encoding(spark, sf_dir):
    coded = encode(shipments(spark, sf_dir), parse_covariates([SEG]))
    total = lambda label: F.sum(F.col(f"`seg[{label}]`")).cast("long").alias(label.lower())
    return coded.groupBy("site").agg(*[total(x) for x in ("AUTOMOBILE", "FURNITURE", "MACHINERY")], F.count_if(F.col("`seg[MACHINERY]`").isNull()).alias("missing"))


@query(
    f"""{SHIP} SELECT site, sum(CASE left(prio, 1) WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 3 WHEN '4' THEN 4 END)::DOUBLE AS score,
count(*) FILTER (left(prio, 1) = '5') AS missing FROM shipments GROUP BY site"""
)
def scored_encoding(spark, sf_dir):
    coded = encode(shipments(spark, sf_dir), parse_covariates([PRIO]))
    return coded.groupBy("site").agg(F.sum("prio").alias("score"), F.count_if(F.col("prio").isNull()).alias("missing"))


@query(f"{SHIP} SELECT site, count(*) AS n FROM shipments WHERE seg <> 'HOUSEHOLD' AND left(prio, 1) <> '5' GROUP BY site")
def complete_rows(spark, sf_dir):
    covariates = parse_covariates([SEG, PRIO, "x1"])
    ready = drop_incomplete(encode(shipments(spark, sf_dir), covariates), ["time", "event", *covariates.terms, "unknown"])
    return ready.groupBy("site").agg(F.count(F.lit(1)).alias("n"))


@query(f"{SHIP} SELECT 's:' || prio AS prio_key, 'n:' || time::INTEGER::VARCHAR || '.0' AS time_key, count(*) AS n FROM shipments GROUP BY 1, 2")
def code_keys(spark, sf_dir):
    rows = shipments(spark, sf_dir)
    keys = rows.select(covariate_key(F.col("prio"), "string").alias("prio_key"), term_key(F.col("time"), "double").alias("time_key"))
    return keys.groupBy("prio_key", "time_key").agg(F.count(F.lit(1)).alias("n"))


NAMED = "CASE WHEN time % 3 = 0 THEN ' 0' || time::INTEGER::VARCHAR || '.0 ' WHEN time % 3 = 1 THEN '<' || flag || '>' ELSE ' http://snomed.info/id/' || flag END"


@query(f"{SHIP} SELECT CASE WHEN time % 3 = 0 THEN 'n:' || time::INTEGER::VARCHAR || '.0' ELSE 's:' || trim({NAMED}) END AS key, count(*) AS n FROM shipments GROUP BY 1")
def plain_code_keys(spark, sf_dir):
    """Keys of codes without ontology terms: numbers in any spelling are one, brackets and namespaces stay."""
    text = F.expr("CASE WHEN time % 3 = 0 THEN concat(' 0', cast(time as int), '.0 ') WHEN time % 3 = 1 THEN concat('<', flag, '>') ELSE concat(' http://snomed.info/id/', flag) END")
    return shipments(spark, sf_dir).select(code_key(text, "string").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s AS site, s_nationkey AS nation, count(*) AS n, count(b) AS known, count(*) FILTER (b IS NULL) AS lacking FROM (SELECT 1::BIGINT AS s, s_nationkey, NULL AS b FROM supplier UNION ALL SELECT 2, c_nationkey, c_mktsegment FROM customer) GROUP BY 1, 2")
def united_stations(spark, sf_dir):
    """Two stations as one table; a column that one lacks is null there."""
    tables = read_stations(spark, {1: f"{sf_dir}/supplier.parquet", 2: f"{sf_dir}/customer.parquet"})
    nation = F.coalesce("s_nationkey", "c_nationkey").alias("nation")
    return tables.select("site", nation, F.col("c_mktsegment").alias("b")).groupBy("site", "nation").agg(F.count(F.lit(1)).alias("n"), F.count("b").alias("known"), F.count_if(F.col("b").isNull()).alias("lacking"))


@query(f"{SHIP} SELECT site, time, count(*) AS freq FROM shipments WHERE event = 1 AND x1 > 0.05 AND seg <> 'HOUSEHOLD' GROUP BY site, time")
def hooked_rows(spark, sf_dir):
    """Event counts of rows that a hook has left, after coding and before anything is counted."""
    request = FitRequest.of("time", "event", ["x1", SEG])
    with prepare(shipments(spark, sf_dir), request, OPEN, row_hook=lambda df: df.filter("x1 > 0.05")) as ready:
        counts = [(r.site, r.time, r.freq) for r in ready.counts.select("site", "time", "freq").collect()]
    return spark.createDataFrame(counts, "site long, time double, freq long")


@query(f"SELECT l_orderkey, l_linenumber, {sig('l_extendedprice', 3)} AS three, {sig('l_extendedprice * (l_discount - 0.05)', 7)} AS seven FROM lineitem")
def rounded_figures(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select("l_orderkey", "l_linenumber", fig(F.col("l_extendedprice"), 3).alias("three"), fig(F.col("l_extendedprice") * (F.col("l_discount") - 0.05), 7).alias("seven"))


# --- time guards ---------------------------------------------------------------

K = 25
CUT_SQL = f"cuts AS (SELECT site, time AS cut FROM (SELECT site, time, row_number() OVER (PARTITION BY site ORDER BY time DESC) AS r FROM lags) WHERE r = {K})"
TAIL_SQL = "tail AS (SELECT l.site, CASE WHEN l.time > c.cut THEN c.cut ELSE l.time END AS time, CASE WHEN l.time > c.cut THEN 0 ELSE l.event END AS event, value FROM lags l JOIN cuts c USING (site))"


@query(f"{LAG}, {CUT_SQL} SELECT site, cut FROM cuts")
def tail_cutoff(spark, sf_dir):
    return times.kth_largest(lags(spark, sf_dir), K)


@query(f"{LAG}, {CUT_SQL}, {TAIL_SQL} SELECT site, count(*) AS n, sum(event)::BIGINT AS n_events, max(time) AS last FROM tail GROUP BY site")
def tail_censored(spark, sf_dir):
    rows = lags(spark, sf_dir)
    cut = times.clamp_tail(rows, times.kth_largest(rows, K))
    return cut.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("n_events"), F.max("time").alias("last"))


M = 8
MERGE_SQL = f"""f AS (SELECT site, time, count(*) AS freq, row_number() OVER (PARTITION BY site ORDER BY time) AS i FROM weekly WHERE event = 1 GROUP BY site, time),
walk AS (
  SELECT site, time, freq, i, 0::BIGINT AS g, CASE WHEN freq >= {M} THEN 0 ELSE freq END::BIGINT AS held, (freq >= {M})::BIGINT AS next FROM f WHERE i = 1
  UNION ALL
  SELECT f.site, f.time, f.freq, f.i, w.next, CASE WHEN w.held + f.freq >= {M} THEN 0 ELSE w.held + f.freq END::BIGINT, w.next + (w.held + f.freq >= {M})::BIGINT
  FROM walk w JOIN f ON f.site = w.site AND f.i = w.i + 1),
ends AS (SELECT site, max(next) AS groups, arg_max(held, i) AS rest FROM walk GROUP BY site),
into_group AS (SELECT w.*, CASE WHEN w.g = e.groups AND e.rest > 0 AND e.groups > 0 THEN w.g - 1 ELSE w.g END AS t FROM walk w JOIN ends e USING (site)),
merged AS (SELECT site, time, freq, max(CASE WHEN g = t THEN time END) OVER (PARTITION BY site, t) AS merged FROM into_group)"""


@query(f"{LAG}, {WEEKLY_SQL}, {MERGE_SQL} SELECT site, time, freq, merged FROM merged")
def merged_event_times(spark, sf_dir):
    return times.merge_small(times.event_counts(_weekly(spark, sf_dir)), M)


@query(f"{LAG}, {WEEKLY_SQL}, {MERGE_SQL} SELECT site, merged AS time, sum(freq)::BIGINT AS freq FROM merged GROUP BY site, merged")
def suppressed_event_counts(spark, sf_dir):
    return times.suppressed_counts(times.event_counts(_weekly(spark, sf_dir)), M)


@query(
    f"""{LAG}, {WEEKLY_SQL}, {MERGE_SQL} SELECT w.site, coalesce(m.merged, w.time) AS time, w.event, count(*) AS n
FROM weekly w LEFT JOIN merged m ON w.event = 1 AND m.site = w.site AND m.time = w.time GROUP BY 1, 2, 3"""
)
def moved_event_rows(spark, sf_dir):
    rows = _weekly(spark, sf_dir)
    moved = times.move_events(rows, times.merge_small(times.event_counts(rows), M))
    return moved.groupBy("site", "time", "event").agg(F.count(F.lit(1)).alias("n"))


# --- risk sets -----------------------------------------------------------------


def _slotted(rows: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame, list[float]]:
    """rows with their slot; slots (slot, time, freq); the grid. One pass over the events finds the grid."""
    found = sorted((r.time, r.freq) for r in times.pooled_grid(counts).collect())
    grid = [t for t, _ in found]
    points = {"slot": pa.array(range(len(grid)), pa.int32()), "time": pa.array(grid, pa.float64()), "freq": pa.array([n for _, n in found], pa.int64())}
    return risksets.assign_slots(rows, grid), rows.sparkSession.createDataFrame(pa.table(points)), grid


def _regions(spark, sf_dir) -> DataFrame:
    """The sites of shipments."""
    return spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("long").alias("site"))


def _risk(spark, sf_dir, beta=BETA) -> tuple[DataFrame, DataFrame]:
    rows = _plain(spark, sf_dir).persist()  # read for the grid, the bounds and the sums
    slotted, slots, grid = _slotted(rows, times.event_counts(rows))
    xs = [F.col("x0"), F.col("x1")]
    sums = risksets.slot_sums(slotted, xs, F.exp(beta[0] * xs[0] + beta[1] * xs[1]))
    return risksets.at_risk(sums, _regions(spark, sf_dir), len(grid)), slots


RISK_SQL = f"""g AS (SELECT DISTINCT time AS t FROM shipments WHERE event = 1),
b AS (SELECT site, time, count(*) AS n, sum(exp({BETA[0]} * x1 + {BETA[1]} * x2)) AS s0, sum(x1 * exp({BETA[0]} * x1 + {BETA[1]} * x2)) AS s1_0, sum(x2 * exp({BETA[0]} * x1 + {BETA[1]} * x2)) AS s1_1,
 sum(x1 * x1 * exp({BETA[0]} * x1 + {BETA[1]} * x2)) AS s2_0_0, sum(x1 * x2 * exp({BETA[0]} * x1 + {BETA[1]} * x2)) AS s2_0_1, sum(x2 * x2 * exp({BETA[0]} * x1 + {BETA[1]} * x2)) AS s2_1_1 FROM shipments GROUP BY site, time),
r AS (SELECT b.site, g.t AS time, sum(n)::BIGINT AS n, sum(s0) AS s0, sum(s1_0) AS s1_0, sum(s1_1) AS s1_1, sum(s2_0_0) AS s2_0_0, sum(s2_0_1) AS s2_0_1, sum(s2_1_1) AS s2_1_1
 FROM g JOIN b ON b.time >= g.t GROUP BY b.site, g.t)"""


@query(f"{SHIP}, {RISK_SQL} SELECT site, time, n FROM r")
def risk_set_sizes(spark, sf_dir):
    risk, slots = _risk(spark, sf_dir)
    return risk.join(F.broadcast(slots), "slot").filter("n > 0").select("site", "time", "n")


S = ["s0", "s1_0", "s1_1", "s2_0_0", "s2_0_1", "s2_1_1"]


@query(f"{SHIP}, {RISK_SQL} SELECT site, time, {', '.join(f'{sig(c)} AS {c}' for c in S)} FROM r")
def risk_set_sums(spark, sf_dir):
    risk, slots = _risk(spark, sf_dir)
    return risk.join(F.broadcast(slots), "slot").filter("n > 0").select("site", "time", *[fig(F.col(c)).alias(c) for c in S])


@query(f"{SHIP}, {RISK_SQL} SELECT time, {', '.join(f'{sig(f'sum({sig(c, 7)})')} AS {c}' for c in S)} FROM r GROUP BY time")
def exchanged_sums(spark, sf_dir):
    """Rounded per site to what is exchanged, then pooled."""
    risk, slots = _risk(spark, sf_dir)
    knobs = times.settings_frame(spark, dict.fromkeys([r[0] for r in _regions(spark, sf_dir).collect()], OPEN))
    same = risk.select("site", "slot", F.col("slot").alias("effective"))
    pooled = risksets.pooled(risksets.released(risk, same, knobs, 2), 2)
    return pooled.join(F.broadcast(slots), "slot").select("time", *[fig(F.col(c)).alias(c) for c in S])


LAG_SITES = (0, 1, 2)  # users modulo 3
GUARD = Settings(risk_change=8, risk_size=40, threshold=10, bin_width=WEEK, figures=None, time_events=1)
WALK_SQL = f"""c AS (SELECT DISTINCT time AS t FROM weekly WHERE event = 1),
n AS (SELECT s.site, c.t, count(w.time) AS n, count(w.time) FILTER (w.value > 50) AS g, row_number() OVER (PARTITION BY s.site ORDER BY c.t) - 1 AS slot
      FROM (SELECT DISTINCT site FROM weekly) s CROSS JOIN c LEFT JOIN weekly w ON w.site = s.site AND w.time >= c.t GROUP BY s.site, c.t)"""


def _holds(groups: bool) -> str:
    k, floor = GUARD.risk_change, GUARD.risk_size
    few = lambda x: f"(({x}) > 0 AND ({x}) < {k})"
    hold = f"{few('w.n - n.n')} OR n.n < {floor}"
    if groups:
        hold += f" OR {few('w.g - n.g')} OR {few('(w.n - n.n) - (w.g - n.g)')} OR n.g < {floor} OR n.n - n.g < {floor}"
    return f"""walk AS (SELECT site, slot, 0::BIGINT AS effective, n, g FROM n WHERE slot = 0 UNION ALL
  SELECT n.site, n.slot, CASE WHEN {hold} THEN w.effective ELSE n.slot END, CASE WHEN {hold} THEN w.n ELSE n.n END, CASE WHEN {hold} THEN w.g ELSE n.g END
  FROM walk w JOIN n ON n.site = w.site AND n.slot = w.slot + 1)"""


def _effective(spark, sf_dir, groups: bool) -> DataFrame:
    rows = _weekly(spark, sf_dir).withColumn("big", (F.col("x0") > 50).cast("int"))
    slotted, _, grid = _slotted(rows, times.event_counts(rows))
    masks = [F.col("big") == 1] if groups else []
    knobs = times.settings_frame(spark, dict.fromkeys(LAG_SITES, GUARD))
    risk = risksets.at_risk(risksets.slot_sums(slotted, [], F.lit(1.0), masks), knobs, len(grid))
    held = risksets.effective_slots(risk, knobs, len(masks))
    return held.select("site", F.col("slot").cast("long").alias("slot"), F.col("effective").cast("long").alias("effective"))


@query(f"{LAG}, {WEEKLY_SQL}, {WALK_SQL}, {_holds(False)} SELECT site, slot, effective FROM walk")
def held_risk_sets(spark, sf_dir):
    """Jump guard and floor: the slot that each release shows."""
    return _effective(spark, sf_dir, False)


@query(f"{LAG}, {WEEKLY_SQL}, {WALK_SQL}, {_holds(True)} SELECT site, slot, effective FROM walk")
def held_group_risk_sets(spark, sf_dir):
    """The same for a category and the rest beside it."""
    return _effective(spark, sf_dir, True)


@query(
    f"""{LAG}, {WEEKLY_SQL}, {WALK_SQL}, {_holds(False)},
e AS (SELECT site, time, count(*) AS freq FROM weekly WHERE event = 1 GROUP BY site, time)
SELECT w.site, {sig('coalesce(sum(CASE WHEN w.slot > 0 AND w.effective = 0 THEN e.freq END), 0)::DOUBLE / sum(e.freq)')} AS share
FROM walk w JOIN n USING (site, slot) LEFT JOIN e ON e.site = w.site AND e.time = n.t GROUP BY w.site"""
)
def held_event_shares(spark, sf_dir):
    rows = _weekly(spark, sf_dir)
    counts = times.event_counts(rows)
    slotted, slots, grid = _slotted(rows, counts)
    knobs = times.settings_frame(spark, dict.fromkeys(LAG_SITES, GUARD))
    risk = risksets.at_risk(risksets.slot_sums(slotted, [], F.lit(1.0)), knobs, len(grid))
    release = risksets.released(risk, risksets.effective_slots(risk, knobs), knobs, 0)
    shares = risksets.held_event_share(release, counts.join(F.broadcast(slots.select("slot", "time")), "time"), knobs)
    return shares.select("site", fig(F.col("share")).alias("share"))


# --- the fit -------------------------------------------------------------------

POOL_SQL = "p AS (SELECT r.time, sum(r.n) AS n, sum(s0) AS s0, sum(s1_0) AS s1_0, sum(s1_1) AS s1_1, sum(s2_0_0) AS s2_0_0, sum(s2_0_1) AS s2_0_1, sum(s2_1_1) AS s2_1_1 FROM r GROUP BY r.time), d AS (SELECT time, count(*) AS freq FROM shipments WHERE event = 1 GROUP BY time)"


def _pooled(spark, sf_dir) -> tuple[dict, np.ndarray]:
    """Columns of the pooled sums at BETA (a row per grid point, with time and freq), and the event sums."""
    risk, slots = _risk(spark, sf_dir)
    sums = risk.groupBy("slot").agg(*[F.sum(c).alias(c) for c in S]).join(F.broadcast(slots), "slot").toPandas().sort_values("slot")
    z = event_sums(times.event_counts(_plain(spark, sf_dir).persist(), 2), 2).agg(F.sum("z0"), F.sum("z1")).first()  # the same rows again
    return {c: sums[c].to_numpy() for c in sums}, np.array(z, dtype=float)


@query(
    f"""{SHIP}, {RISK_SQL}, {POOL_SQL}
SELECT {sig(f'(SELECT {BETA[0]} * sum(x1) + {BETA[1]} * sum(x2) FROM shipments WHERE event = 1) - sum(freq * ln(s0))')} AS loglik FROM p JOIN d USING (time)"""
)
def log_likelihood_at(spark, sf_dir):
    at, z = _pooled(spark, sf_dir)
    value = log_likelihood(BETA, z, at["freq"], at["s0"])
    return spark.createDataFrame([(value,)], "x double").select(fig(F.col("x")).alias("loglik"))


@query(
    f"""{SHIP}, {RISK_SQL}, {POOL_SQL}, z AS (SELECT sum(x1) AS z0, sum(x2) AS z1 FROM shipments WHERE event = 1)
SELECT {sig('any_value(z0) - sum(freq * s1_0 / s0)', 6)} AS g0, {sig('any_value(z1) - sum(freq * s1_1 / s0)', 6)} AS g1,
{sig('-sum(freq * (s2_0_0 / s0 - s1_0 * s1_0 / (s0 * s0)))', 6)} AS h00, {sig('-sum(freq * (s2_0_1 / s0 - s1_0 * s1_1 / (s0 * s0)))', 4)} AS h01,
{sig('-sum(freq * (s2_1_1 / s0 - s1_1 * s1_1 / (s0 * s0)))', 6)} AS h11 FROM p JOIN d USING (time), z"""
)
def gradient_and_hessian_at(spark, sf_dir):
    at, z = _pooled(spark, sf_dir)
    s1 = np.stack([at["s1_0"], at["s1_1"]], axis=1)
    s2 = np.stack([at["s2_0_0"], at["s2_0_1"], at["s2_0_1"], at["s2_1_1"]], axis=1).reshape(-1, 2, 2)
    g, h = derivatives(at["s0"], s1, s2, at["freq"], z)
    one = spark.createDataFrame([(*g.tolist(), float(h[0, 0]), float(h[0, 1]), float(h[1, 1]))], "g0 double, g1 double, h00 double, h01 double, h11 double")
    return one.select(*[fig(F.col(c), 4 if c == "h01" else 6).alias(c) for c in one.columns])


@query(f"{SHIP}, {RISK_SQL}, {POOL_SQL}, h AS (SELECT time, sum(freq / s0) OVER (ORDER BY time) AS hazard FROM p JOIN d USING (time)) SELECT time, {sig('hazard')} AS hazard FROM h")
def baseline_cumulative_hazard(spark, sf_dir):
    hazard, _ = _curves(spark, sf_dir, [], None)
    return spark.createDataFrame([(float(t), h) for t, h in hazard.items()], "time double, hazard double").select("time", fig(F.col("hazard")).alias("hazard"))


def _curves(spark, sf_dir, profiles: list[dict], figures: int | None) -> tuple[dict, dict]:
    at, _ = _pooled(spark, sf_dir)
    return survival_curves(at["freq"], at["s0"], at["time"], BETA, [0.0, 0.0], [1.0, 1.0], ["x1", "x2"], profiles, figures)


@query(
    f"""{SHIP}, {RISK_SQL}, {POOL_SQL}, h AS (SELECT time, sum(freq / s0) OVER (ORDER BY time) AS hazard FROM p JOIN d USING (time)),
f AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE), (1, 0.05::DOUBLE), (2, 0.1::DOUBLE)) v(profile, x))
SELECT profile, time, {sig(f'exp(-hazard * exp({BETA[0]} * x))')} AS survival FROM h CROSS JOIN f"""
)
def survival_by_profile(spark, sf_dir):
    _, curves = _curves(spark, sf_dir, [{"x1": x} for x in (0.05, 0.1)], None)
    rows = [(int(i), float(t), v) for i, curve in curves.items() for t, v in curve.items()]
    return spark.createDataFrame(rows, "profile int, time double, survival double").select("profile", "time", fig(F.col("survival")).alias("survival"))


@query(
    f"""{SHIP}, {RISK_SQL}, {POOL_SQL}, h AS (SELECT time, sum(freq / s0) OVER (ORDER BY time) AS hazard FROM p JOIN d USING (time))
SELECT {sig('time', 1)} AS rounded, {sig('arg_max(hazard, time)')} AS hazard FROM h GROUP BY 1"""
)
def rounded_curve_times(spark, sf_dir):
    """Times that round to one key: the largest counts."""
    hazard, _ = _curves(spark, sf_dir, [], 1)
    return spark.createDataFrame([(float(t), h) for t, h in hazard.items()], "rounded double, hazard double").select("rounded", fig(F.col("hazard")).alias("hazard"))


NEWTON_SQL = f"""{SHIP.replace('WITH', 'WITH RECURSIVE', 1)},
d AS (SELECT time, count(*) AS freq FROM shipments WHERE event = 1 GROUP BY time),
z AS (SELECT sum(x1) AS z FROM shipments WHERE event = 1),
v AS (SELECT time, x1, count(*) AS n FROM shipments GROUP BY time, x1),
step AS (
  SELECT 0 AS i, 0.0::DOUBLE AS beta, 0.0::DOUBLE AS ll, 0.0::DOUBLE AS info
  UNION ALL
  SELECT s.i + 1, s.beta + (z.z - q.mean) / q.spread, s.beta * z.z - q.logs, q.spread
  FROM step s, z, LATERAL (
    SELECT sum(freq * s1 / s0) AS mean, sum(freq * (s2 / s0 - s1 * s1 / (s0 * s0))) AS spread, sum(freq * ln(s0)) AS logs
    FROM (SELECT d.time, any_value(d.freq) AS freq, sum(v.n * exp(s.beta * v.x1)) AS s0, sum(v.n * v.x1 * exp(s.beta * v.x1)) AS s1, sum(v.n * v.x1 * v.x1 * exp(s.beta * v.x1)) AS s2
          FROM d JOIN v ON v.time >= d.time GROUP BY d.time)) q
  WHERE s.i < 8)"""


@query(
    f"""{NEWTON_SQL}
SELECT {sig('f.beta', 4)} AS coef, {sig('1 / sqrt(f.info)', 4)} AS se, {sig('-2 * f.ll + 2', 5)} AS aic, {sig('n.ll', 5)} AS loglik_null
FROM (SELECT * FROM step WHERE i = 8) f, (SELECT * FROM step WHERE i = 1) n"""
)
def one_covariate_model(spark, sf_dir):
    """A fit without guards; the exchange rounds sums to seven figures, so a few figures agree."""
    got = cox_fit(shipments(spark, sf_dir), "time", "event", ["x1"], settings=OPEN)
    term = got["model"]["x1"]
    one = spark.createDataFrame([(term["Coef"], term["SE"], got["aic"], got["log_likelihood_null"])], "coef double, se double, aic double, loglik_null double")
    return one.select(fig(F.col("coef"), 4).alias("coef"), fig(F.col("se"), 4).alias("se"), fig(F.col("aic"), 5).alias("aic"), fig(F.col("loglik_null"), 5).alias("loglik_null"))


def _shown(frame: DataFrame, figures: int = 3) -> DataFrame:
    """A model table to some figures, as many as do not depend on where the optimiser stops."""
    return frame.select("term", *[fig(F.col(c), figures).alias(c) for c in frame.columns if c != "term"])


def _base(columns: str, where: str = "TRUE", of: str = "shipments") -> str:
    return f"WITH RECURSIVE {LAGS_SQL if of == 'lags' else SHIPMENTS_SQL}, base AS (SELECT site, time, event, {columns} FROM {of} WHERE {where})"


PRIO_SCORE = "CASE left(prio, 1) WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 3 WHEN '4' THEN 4 END::DOUBLE"
LABELS = [s for s in SEG["seg"]["categories"] if s != SEG["seg"]["reference"]]
OF_SEG = ", ".join(f"(seg = '{s}')::INTEGER::DOUBLE AS x{i}" for i, s in enumerate(LABELS, 1)) + ", " + ", ".join(f"(seg = '{s}')::INTEGER AS k{i}" for i, s in enumerate([*LABELS, SEG["seg"]["reference"]]))


def flagship(spark, sf_dir):
    """A fit with the guards of the standard level, two numeric covariates and an ordinal one."""
    return model_frame(spark, cox_fit(shipments(spark, sf_dir), "time", "event", ["x1", "x2", PRIO], settings=Settings()))


@query(model_sql(fit_sql(_base(f"x1 AS x0, x2 AS x1, {PRIO_SCORE} AS x2", "left(prio, 1) <> '5'"), 3, 0, Settings()), ["x1", "x2", "prio"]))
def cox_model(spark, sf_dir):
    """The flagship, to some figures."""
    return _shown(flagship(spark, sf_dir))


@query(model_sql(fit_sql(_base(f"x1 AS x0, {OF_SEG}", "seg <> 'HOUSEHOLD' AND site IN (0, 1, 3) AND x2 BETWEEN 0.0 AND 0.06"), 4, 4, Settings(bin_width=2.0)), ["x1", *[f"seg[{s}]" for s in LABELS]]))
def cox_model_categories(spark, sf_dir):
    """Categories with group holds, in bins, for some sites and a selection of rows."""
    got = cox_fit(shipments(spark, sf_dir), "time", "event", ["x1", SEG], sites=[0, 1, 3], selection={"x2": {"start": 0.0, "end": 0.06}}, settings=Settings(bin_width=2.0))
    return _shown(model_frame(spark, got))


@query(model_sql(fit_sql(_base("value AS x0", "value IS NOT NULL", "lags"), 1, 0, Settings(bin_width=WEEK)), ["value"]))
def cox_model_lags(spark, sf_dir):
    """Continuous times in weekly bins, with the time guards at work."""
    return _shown(model_frame(spark, cox_fit(lags(spark, sf_dir), "time", "event", ["value"], settings=Settings(bin_width=WEEK))))


TWO_SQL = fit_sql(_base("x1 AS x0, x2 AS x1"), 2, 0, Settings())
PROFILES = [{"x1": 0.0}, {"x1": 0.1, "x2": 0.08}]


@query(
    f"""{TWO_SQL},
curve AS (SELECT {sig('t', 6)} AS time, sum(freq / s0) OVER (ORDER BY slot) AS hazard, t FROM ended),
once AS (SELECT time, arg_max(hazard, t) AS hazard FROM curve GROUP BY time),
who AS (SELECT '0' AS curve, 0.0::DOUBLE AS score UNION ALL SELECT '1', b_0 * (0.0 - c0) / d0 FROM last UNION ALL SELECT '2', b_0 * (0.1 - c0) / d0 + b_1 * (0.08 - c1) / d1 FROM last)
SELECT curve, time, {sig('exp(-hazard * exp(score))', 4)} AS survival FROM once, who"""
)
def cox_survival_curves(spark, sf_dir):
    """Curves of a guarded fit as rows: curve, time and survival."""
    got = cox_fit(shipments(spark, sf_dir), "time", "event", ["x1", "x2"], profiles=PROFILES, settings=Settings())
    rows = [(c, float(t), v) for c, curve in got["survival_curves"].items() for t, v in curve.items()]
    return spark.createDataFrame(rows, "curve string, time double, survival double").select("curve", "time", fig(F.col("survival"), 4).alias("survival"))


@query(
    f"""{TWO_SQL},
wald AS (SELECT *, -(b_0 * b_0 * h_0_0 + 2 * b_0 * b_1 * h_0_1 + b_1 * b_1 * h_1_1) AS wald, 2 * (ll - ll_null) AS ratio FROM last)
SELECT events::BIGINT AS n_events, {sig('-2 * ll + 4', 6)} AS aic, {sig('ll_null', 6)} AS loglik_null, {sig('exp(-wald / 2)', 2)} AS overall_p, {sig('exp(-ratio / 2)', 1)} AS lr_p,
TRUE AS converged, TRUE AS guards_active, 5 AS risk_change, 50 AS risk_size,
(SELECT {sig('coalesce(max(share), 0)')} FROM (SELECT h.site, sum(CASE WHEN h.slot > 0 AND h.effective = 0 THEN m.freq ELSE 0 END)::DOUBLE / sum(m.freq) AS share
  FROM eff h JOIN grid g ON g.slot = h.slot JOIN merged m ON m.site = h.site AND m.merged = g.t GROUP BY h.site)) AS held_share FROM wald"""
)
def cox_fit_summary(spark, sf_dir):
    """Tests, likelihoods and guards of a fit; twice the log-likelihoods' difference is smaller than their rounding, so few figures of its p value agree."""
    got = cox_fit(shipments(spark, sf_dir), "time", "event", ["x1", "x2"], settings=Settings())
    of = got["privacy_guards"]
    row = (got["n_events"], got["aic"], got["log_likelihood_null"], got["overall_p_value"], got["lr_p_value"], got["converged"], of["active"], of["max_min_risk_set_change"], of["max_min_risk_set_size"], of["max_held_event_fraction"])
    one = spark.createDataFrame([row], "n_events long, aic double, loglik_null double, overall_p double, lr_p double, converged boolean, guards_active boolean, risk_change int, risk_size int, held_share double")
    figures = {"aic": 6, "loglik_null": 6, "overall_p": 2, "lr_p": 1, "held_share": FIGURES}
    return one.select(*[fig(F.col(c), figures[c]).alias(c) if c in figures else c for c in one.columns])


@query(
    f"""{stage_one(_base("value AS x0", "value IS NOT NULL", "lags"), 1, Settings(bin_width=WEEK))}
SELECT m.site, m.merged AS time, sum(m.freq)::BIGINT AS freq, any_value(s.events) AS events, {sig('any_value(z0)')} AS z0, {sig('any_value(q0)')} AS q0 FROM merged m JOIN sums s USING (site) GROUP BY m.site, m.merged"""
)
def guarded_stage_one(spark, sf_dir):
    """What sites share first: sums, squares and suppressed counts of the weekly lags."""
    with prepare(lags(spark, sf_dir), FitRequest.of("time", "event", ["value"]), Settings(bin_width=WEEK)) as ready:
        counts = ready.released_counts.collect()
        sums = {r.site: (r.events, r.z0, r.q0) for r in event_sums(ready.counts, 1).collect()}
    shared = spark.createDataFrame([(r.site, r.time, r.freq, *sums[r.site]) for r in counts], "site long, time double, freq long, events long, z0 double, q0 double")
    return shared.select("site", "time", "freq", "events", fig(F.col("z0")).alias("z0"), fig(F.col("q0")).alias("q0"))


BIAS_KS, BIAS_WIDTH = (1, 5, 10), 5.0


def _bias_sql() -> str:
    """Every fit of the study, one by one, and the metrics over them."""
    fits = []
    for r in range(REPETITIONS):
        for k in BIAS_KS:
            for width in (None, BIAS_WIDTH):
                one = fit_sql(f"WITH RECURSIVE base AS (SELECT site, time, event, x1 AS x0, x2 AS x1 FROM simulated WHERE repetition = {r})", 2, 0, Settings(risk_change=k, bin_width=width))
                fits.append(f"SELECT {r} AS repetition, {k} AS k, {'TRUE' if width else 'FALSE'} AS binned, f.* FROM ({one} SELECT b_0 / d0 AS c0, b_1 / d1 AS c1, sqrt(-e_0_2) / d0 AS s0, sqrt(-e_1_3) / d1 AS s1 FROM last) f")
    each = ",\n".join(f"fit{i} AS MATERIALIZED ({f})" for i, f in enumerate(fits))
    b0, b1 = TRUTH.values()
    return f"""WITH {SIMULATED_SQL}, {each},
e AS ({' UNION ALL '.join(f'SELECT * FROM fit{i}' for i in range(len(fits)))}),
d AS (SELECT e.k, e.binned, CASE WHEN e.k = 1 THEN 0 ELSE greatest(abs(e.c0 - f.c0), abs(e.c1 - f.c1)) END AS moved, greatest(abs(e.c0 - {b0}), abs(e.c1 - ({b1}))) AS off,
  abs(e.c0 - {b0}) <= 1.96 * e.s0 AND abs(e.c1 - ({b1})) <= 1.96 * e.s1 AS covers FROM e JOIN e f ON f.repetition = e.repetition AND f.k = 1 AND NOT f.binned)
SELECT k::INTEGER AS k, binned, {sig('avg(moved)', 2)} AS mean_dev_vs_k1, {sig('max(moved)', 2)} AS max_dev_vs_k1, {sig('avg(off)', 3)} AS mean_dev_vs_true,
       avg(covers::INTEGER)::DOUBLE AS coverage, count(*)::INTEGER AS repetitions FROM d GROUP BY k, binned"""


@query(_bias_sql())
def bias_of_guards(spark, sf_dir):
    """Deviation and coverage by least risk-set change and binning, on lines with simulated times; all twelve fits are one batch."""
    got = bias_study(simulated(spark, sf_dir), "time", "event", TRUTH, list(BIAS_KS), BIAS_WIDTH)
    figures = {"mean_dev_vs_k1": 2, "max_dev_vs_k1": 2, "mean_dev_vs_true": 3}
    return got.select(*[fig(F.col(c), figures[c]).alias(c) if c in figures else c for c in got.columns])


@query(
    """SELECT c_custkey::VARCHAR AS patient, c_acctbal::VARCHAR AS balance, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'http://example.org/term/' || c_mktsegment ELSE c_mktsegment END AS segment
FROM customer"""
)
def flattened_triples(spark, sf_dir):
    """Customers written as triples, then flattened again: terms count before values, absent cells are null."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("k"), F.col("c_acctbal").cast("string").alias("b"), F.col("c_mktsegment").alias("g"), "c_custkey")
    t = lambda s, p, o: F.struct(F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in s]).alias("s"), F.lit(p).alias("p"), (o if isinstance(o, Column) else F.lit(o)).alias("o"))
    k, term = F.col("k"), F.concat(F.lit("http://example.org/term/"), F.col("g"))
    segment = F.col("c_custkey") % 7 != 0
    named = segment & (F.col("c_custkey") % 3 == 0)
    always = [t(["", k], "http://x/has_column", F.concat(F.lit("b"), k)), t(["b", k], "http://x/type", "balance"), t(["b", k], "http://x/has_cell", F.concat(F.lit("cb"), k)), t(["cb", k], "http://x/has_value", F.col("b"))]
    some = [t(["", k], "http://x/has_column", F.concat(F.lit("g"), k)), t(["g", k], "http://x/type", "segment"), t(["g", k], "http://x/has_cell", F.concat(F.lit("cg"), k)), t(["cg", k], "http://x/has_value", F.col("g"))]
    few = [t(["cg", k], "http://x/type", term), F.struct(term.alias("s"), F.lit("http://x/subClassOf").alias("p"), F.lit("segment").alias("o"))]
    triples = c.select(F.explode(F.concat(F.array(*always), F.when(segment, F.array(*some)).otherwise(F.array()), F.when(named, F.array(*few)).otherwise(F.array()))).alias("t")).select("t.*")
    return flatten_patients(triples, ["balance", "segment"])


FLAGSHIP = flagship
