"""SQL for DuckDB that fits a guarded model as ``plans.fit`` does, for comparison: guards, rounding and unrolled Newton steps."""

from __future__ import annotations

from .config import WIRE_FIGURES, Settings


def sig(x: str, figures: int = 9) -> str:
    """A number to so many significant figures, half to even."""
    value = f"({x})::DOUBLE"
    shift = f"({figures - 1} - floor(log10(abs({value}))))"
    up, down = f"pow(10.0::DOUBLE, {shift})", f"pow(10.0::DOUBLE, -{shift})"
    return f"CASE WHEN {value} = 0 THEN 0.0::DOUBLE WHEN {shift} >= 0 THEN round_even({value} * {up}, 0) / {up} ELSE round_even({value} / {down}, 0) * {down} END"


def normal_tails(z: str) -> str:
    """The probability beyond +-z of a normal distribution, by Simpson's rule."""
    return f"(SELECT 1 - 2 * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(abs({z}) * i / 2000.0::DOUBLE, 2) / 2)) * abs({z}) / 6000.0::DOUBLE / sqrt(2 * pi()) FROM range(0, 2001) r(i))"


def stage_one(base: str, p: int, s: Settings) -> str:
    """CTEs after ``base`` (rows: site, time, event, x0..): binned, cut, counts, merged, sums per site and pooled."""
    binned = f"floor(time / {s.bin_width}::DOUBLE) * {s.bin_width}::DOUBLE" if s.bin_width else "time"
    k, m = s.risk_change, s.time_events
    sums = ", ".join(f"sum(x{i}) AS z{i}, sum(x{i} * x{i}) AS q{i}" for i in range(p))
    pooled = ", ".join(f"sum(z{i}) / sum(events) AS c{i}, sqrt(greatest(sum(q{i}) / sum(events) - pow(sum(z{i}) / sum(events), 2), 0)) AS d{i}, sum(z{i}) AS z{i}" for i in range(p))
    placed = ", ".join(f"{sig(f'c{i}', 2)} AS c{i}, {sig(f'CASE WHEN d{i} > 0 THEN d{i} ELSE 1 END', 2)} AS d{i}, z{i}" for i in range(p))
    return f"""{base},
bins AS (SELECT * REPLACE ({binned} AS time) FROM base),
cuts AS (SELECT site, time AS cut FROM (SELECT site, time, row_number() OVER (PARTITION BY site ORDER BY time DESC) AS r FROM bins) WHERE r = {k} AND {k} > 1),
tail AS MATERIALIZED (SELECT b.* REPLACE (CASE WHEN b.time > c.cut THEN c.cut ELSE b.time END AS time, CASE WHEN b.time > c.cut THEN 0 ELSE b.event END AS event) FROM bins b LEFT JOIN cuts c USING (site)),
f AS MATERIALIZED (SELECT site, time, count(*) AS freq, row_number() OVER (PARTITION BY site ORDER BY time) AS i FROM tail WHERE event = 1 GROUP BY site, time),
walk AS (
  SELECT site, time, freq, i, 0::BIGINT AS g, CASE WHEN freq >= {m} THEN 0 ELSE freq END::BIGINT AS held, (freq >= {m})::BIGINT AS next FROM f WHERE i = 1
  UNION ALL
  SELECT f.site, f.time, f.freq, f.i, w.next, CASE WHEN w.held + f.freq >= {m} THEN 0 ELSE w.held + f.freq END::BIGINT, w.next + (w.held + f.freq >= {m})::BIGINT
  FROM walk w JOIN f ON f.site = w.site AND f.i = w.i + 1),
ends AS (SELECT site, max(next) AS groups, arg_max(held, i) AS rest FROM walk GROUP BY site),
into_group AS (SELECT w.*, CASE WHEN w.g = e.groups AND e.rest > 0 AND e.groups > 0 THEN w.g - 1 ELSE w.g END AS t FROM walk w JOIN ends e USING (site)),
merged AS MATERIALIZED (SELECT site, time, freq, max(CASE WHEN g = t THEN time END) OVER (PARTITION BY site, t) AS merged FROM into_group),
sums AS (SELECT site, count(*) AS events, {sums} FROM tail WHERE event = 1 GROUP BY site),
pooled AS (SELECT sum(events)::DOUBLE AS events, {pooled} FROM sums),
std AS MATERIALIZED (SELECT events, {placed} FROM pooled)"""


def _inverse(p: int, last: str, r: int) -> tuple[str, str]:
    """CTEs that invert the matrix h_i_j of ``last`` by elimination, and the name of the one that holds it as v_i_j."""
    cell = {(i, j): f"h_{min(i, j)}_{max(i, j)}" for i in range(p) for j in range(p)} | {(i, p + j): f"{int(i == j)}.0::DOUBLE" for i in range(p) for j in range(p)}
    ctes, source = [], last
    for c in range(p):
        columns = []
        for i in range(p):
            for j in range(2 * p):
                own = f"({cell[c, j]}) / ({cell[c, c]})"
                columns.append(f"{own if i == c else f'({cell[i, j]}) - ({cell[i, c]}) * {own}'} AS e_{i}_{j}")
        name = f"elim{r}_{c}"
        ctes.append(f"{name} AS MATERIALIZED (SELECT *, {', '.join(columns)} FROM {source})" if source == last else f"{name} AS MATERIALIZED (SELECT * REPLACE ({', '.join(columns)}) FROM {source})")
        source = name
        cell = {(i, j): f"e_{i}_{j}" for i in range(p) for j in range(2 * p)}
    return ",\n".join(ctes), source


def fit_sql(base: str, p: int, groups: int, s: Settings, steps: int = 6) -> str:
    """CTEs up to ``last``: one row with b_i and h_i_j (standardised), the inverse e_i_(p+j), ll, ll_null and std; and ``ended`` with the pooled sums there.

    base: WITH RECURSIVE ... base AS (rows with site, time, event, x0.., k0..).
    """
    k, floor = s.risk_change, s.risk_size
    on = k > 1
    few = lambda x: f"(({x}) > 0 AND ({x}) < {k})"
    low = lambda x: f"({x}) < {floor}" if floor else "FALSE"
    hold = f"{few('w.n - n.n')} OR {low('n.n')}"
    for g in range(groups):
        lost = f"w.g{g} - n.g{g}"
        hold += f" OR {few(lost)} OR {few(f'(w.n - n.n) - ({lost})')} OR {low(f'n.g{g}')} OR {low(f'n.n - n.g{g}')}"
    hold = f"({hold})" if on else "FALSE"
    gs = [f"g{g}" for g in range(groups)]
    x = [f"x{i}" for i in range(p)]
    names = ["s0", *[f"s1_{i}" for i in range(p)], *[f"s2_{i}_{j}" for i in range(p) for j in range(i, p)]]
    parts = ["n * w", *[f"n * w * x{i}" for i in range(p)], *[f"n * w * x{i} * x{j}" for i in range(p) for j in range(i, p)]]
    # rounded in two steps: nested in one expression the first would be repeated many times
    first = (lambda c: sig(c, s.figures)) if s.figures else (lambda c: c)
    out = f"""{stage_one(base, p, s)},
moved AS (SELECT t.* REPLACE (coalesce(m.merged, t.time) AS time) FROM tail t LEFT JOIN merged m ON t.event = 1 AND m.site = t.site AND m.time = t.time),
grid AS MATERIALIZED (SELECT merged AS t, sum(freq)::DOUBLE AS freq, row_number() OVER (ORDER BY merged) - 1 AS slot FROM merged GROUP BY merged),
spots AS (SELECT d.time, max(slot) AS slot FROM (SELECT DISTINCT time FROM moved) d JOIN grid ON t <= d.time GROUP BY d.time),
v AS MATERIALIZED (SELECT site, slot, {', '.join(f'(m.x{i} - std.c{i}) / std.d{i} AS x{i}' for i in range(p))}, count(*)::DOUBLE AS n{''.join(f', count(*) FILTER (m.k{g} = 1) AS g{g}' for g in range(groups))}
  FROM moved m JOIN spots USING (time), std GROUP BY ALL),
every AS MATERIALIZED (SELECT site, slot FROM (SELECT DISTINCT site FROM tail), grid),
n AS MATERIALIZED (SELECT site, slot, {', '.join(f'sum(coalesce({c}, 0)) OVER back AS {c}' for c in ['n', *gs])} FROM every LEFT JOIN (SELECT site, slot, {', '.join(f'sum({c}) AS {c}' for c in ['n', *gs])} FROM v GROUP BY site, slot) USING (site, slot)
  WINDOW back AS (PARTITION BY site ORDER BY slot DESC ROWS UNBOUNDED PRECEDING)),
held AS (SELECT site, slot, slot AS effective, {', '.join(['n', *gs])} FROM n WHERE slot = 0 UNION ALL
  SELECT n.site, n.slot, CASE WHEN {hold} THEN w.effective ELSE n.slot END, {', '.join(f'CASE WHEN {hold} THEN w.{c} ELSE n.{c} END' for c in ['n', *gs])} FROM held w JOIN n ON n.site = w.site AND n.slot = w.slot + 1),
eff AS MATERIALIZED (SELECT site, slot, effective FROM held),
b0 AS (SELECT {', '.join(f'0.0::DOUBLE AS b_{i}' for i in range(p))})"""
    for r in range(steps):
        sums = ", ".join(f"sum({e}) AS {c}" for c, e in zip(names, parts))
        deriv = [f"any_value(std.z{i}) - any_value(std.events) * any_value(std.c{i})" for i in range(p)]
        g = ", ".join(f"({deriv[i]}) / any_value(std.d{i}) - sum(freq * s1_{i} / s0) AS g_{i}" for i in range(p))
        h = ", ".join(f"-sum(freq * (s2_{i}_{j} / s0 - s1_{i} * s1_{j} / (s0 * s0))) AS h_{i}_{j}" for i in range(p) for j in range(i, p))
        ll = " + ".join(f"any_value(b{r}.b_{i}) * ({deriv[i]}) / any_value(std.d{i})" for i in range(p)) + " - sum(freq * ln(s0))"
        inverse, done = _inverse(p, f"der{r}", r)
        out += f""",
w{r} AS (SELECT site, slot, {sums} FROM (SELECT v.*, exp({' + '.join(f'b_{i} * x{i}' for i in range(p))}) AS w FROM v, b{r}) GROUP BY site, slot),
c{r} AS (SELECT site, slot, {', '.join(f'sum(coalesce({c}, 0)) OVER back AS {c}' for c in names)} FROM every LEFT JOIN w{r} USING (site, slot) WINDOW back AS (PARTITION BY site ORDER BY slot DESC ROWS UNBOUNDED PRECEDING)),
o{r} AS MATERIALIZED (SELECT e.site, e.slot, {', '.join(f'{first(f"c.{c}")} AS {c}' for c in names)} FROM eff e JOIN c{r} c ON c.site = e.site AND c.slot = e.effective),
p{r} AS MATERIALIZED (SELECT slot, {', '.join(f'sum({sig(c, WIRE_FIGURES)}) AS {c}' for c in names)} FROM o{r} GROUP BY slot),
der{r} AS MATERIALIZED (SELECT {', '.join(f'any_value(b{r}.b_{i}) AS b_{i}' for i in range(p))}, {g}, {h}, {ll} AS ll FROM p{r} JOIN grid USING (slot), std, b{r}),
{inverse},
b{r + 1} AS MATERIALIZED (SELECT {', '.join(f"b_{i} - ({' + '.join(f'e_{i}_{p + j} * g_{j}' for j in range(p))}) AS b_{i}" for i in range(p))} FROM {done})"""
    end = steps - 1
    return out + f""",
last AS MATERIALIZED (SELECT d.*, std.*, (SELECT ll FROM der0) AS ll_null FROM elim{end}_{p - 1} d, std),
ended AS (SELECT * FROM p{end} JOIN grid USING (slot))"""


def model_sql(ctes: str, terms: list[str], figures: int = 3) -> str:
    """The model table of a fit, to some figures."""
    p = len(terms)
    each = " UNION ALL ".join(f"SELECT '{t}' AS term, b_{i} / d{i} AS coef, sqrt(-e_{i}_{p + i}) / d{i} AS se FROM last" for i, t in enumerate(terms))
    shown = {"coef": "coef", "exp_coef": "exp(coef)", "se": "se", "lower_ci": "exp(coef - 1.96 * se)", "upper_ci": "exp(coef + 1.96 * se)", "z": "coef / se", "p_value": "p"}
    return f"{ctes},\nm AS MATERIALIZED ({each}),\nt AS MATERIALIZED (SELECT *, {normal_tails('coef / se')} AS p FROM m)\nSELECT term, {', '.join(f'{sig(e, figures)} AS {c}' for c, e in shown.items())} FROM t"
