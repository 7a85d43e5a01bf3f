"""SQL of the queries that draw, iterate or fit: resampling, robust lines, smooth curves, exact rank tests."""

from __future__ import annotations

from lexigaze.plans.oracles import _ANN, _CUST, _HOME, _LOOK, _MERGED, _SS, _ST, SQL, TIDY_D, _pearson, _range, number, _shapiro, _t_test, q, q_norm, t_p, t_q975, z_p

# ------------------------------------------------------------------ bootstrap

_WORD = "18446744073709551616::UHUGEINT"
_GOLDEN, _FIRST, _SECOND = "11400714819323198485::UHUGEINT", "13787848793156543929::UHUGEINT", "10723151780598845931::UHUGEINT"
BLOCK = 512
LEVELS = 6  # of the tree of blocks that the text can follow: 64 blocks


def _times(a: str, c: str) -> str:
    return f"(({a})::UHUGEINT * {c} % {_WORD})::UBIGINT"


def _step(rows: str, x: str, k: str, name: str) -> str:
    """Rows with the mixed value of x + k * golden, modulo 2^64."""
    return f"""(SELECT * EXCLUDE (z0, z1, z2), xor(z2, z2 >> 31) AS {name} FROM (SELECT *, {_times("xor(z1, z1 >> 27)", _SECOND)} AS z2 FROM (
      SELECT *, {_times("xor(z0, z0 >> 30)", _FIRST)} AS z1 FROM (SELECT *, ((({x})::UHUGEINT + ({k})::UHUGEINT * {_GOLDEN} % {_WORD}) % {_WORD})::UBIGINT AS z0 FROM {rows}))))"""


def _rows(a: str, b: str) -> str:
    return f"(least(({b}) * {BLOCK}, n) - ({a}) * {BLOCK})"


_UNIT = "(({}) >> 11)::DOUBLE / 9007199254740992.0::DOUBLE"


def _split(level: int) -> str:
    """Nodes of one level split in two by the binomial law's quantile at a hashed number; leaves stay."""
    nodes = f"nodes{level}"
    hashed = _step(_step(f"(SELECT *, (a + b) // 2 AS m FROM {nodes} WHERE b - a > 1)", "start", "2 * a + 1", "h1"), "h1", "2 * b + 1", "h2")
    return f"""split{level} AS MATERIALIZED (
  SELECT rep, start, n, a, b, m, picks, least(picks, count(*) FILTER (cdf < u)) AS hits FROM (
    SELECT *, sum(mass) OVER (PARTITION BY rep, a ORDER BY x) AS cdf FROM (
      SELECT *, exp(lgamma(picks + 1) - lgamma(x + 1) - lgamma(picks - x + 1) + x * ln(p) + (picks - x) * ln(1 - p)) AS mass FROM (
        SELECT *, {_UNIT.format("h2")} AS u, {_rows("a", "m")}::DOUBLE / {_rows("a", "b")} AS p, unnest(range(0, picks + 1)) AS x FROM {hashed}))) GROUP BY rep, start, n, a, b, m, picks),
nodes{level + 1} AS MATERIALIZED (SELECT rep, start, n, a, b, picks FROM {nodes} WHERE b - a = 1
  UNION ALL SELECT rep, start, n, a, m, hits FROM split{level} UNION ALL SELECT rep, start, n, m, b, picks - hits FROM split{level})"""


def bootstrap(tables: str, source: str, value: str, varies: str = "true", accelerated: bool = True, reps: int = 1000, seed: int = 1) -> str:
    """The four intervals; ``source`` has x and y, ``value`` is an aggregate over the picked rows."""
    z = "1.959963984540054"
    cdf = lambda e: f"(CASE WHEN ({e}) > 0 THEN 1 - {z_p(f'({e})')} / 2 ELSE {z_p(f'({e})')} / 2 END)"
    splits = ",\n".join(_split(level) for level in range(LEVELS))
    grow = "(1 + 1 / (n - 1))"
    acceleration = f"""acc AS (SELECT sum(pow(mr - r, 3)) / (6 * pow(sum(pow(mr - r, 2)), 1.5)) AS acc FROM (SELECT r, avg(r) OVER () AS mr FROM (
      SELECT (xy - a * b * {grow}) / sqrt((xx - a * a * {grow}) * (yy - b * b * {grow})) AS r FROM (
        SELECT a, b, n::DOUBLE AS n, sum(a * a) OVER () AS xx, sum(b * b) OVER () AS yy, sum(a * b) OVER () AS xy FROM (
          SELECT x - avg(x) OVER () AS a, y - avg(y) OVER () AS b, n FROM src)))))""" if accelerated else "acc AS (SELECT NULL::DOUBLE AS acc)"
    shifted = lambda sign: f"z0 + (z0 {sign} {z}) / (1 - acc * (z0 {sign} {z}))"
    points = "[{'name': 'low', 'p': 0.025::DOUBLE}, {'name': 'high', 'p': 0.975::DOUBLE}" + (
        f", {{'name': 'blow', 'p': {cdf(shifted('-'))}}}, {{'name': 'bhigh', 'p': {cdf(shifted('+'))}}}]" if accelerated else "]")
    kinds = [("normal", f"2 * t0 - mean - {z} * sd", f"2 * t0 - mean + {z} * sd"), ("basic", "2 * t0 - high", "2 * t0 - low"), ("percent", "low", "high")]
    kinds += [("bca", "blow", "bhigh")] if accelerated else []
    listed = ", ".join(f"{{'method': '{name}', 'low': {low}, 'high': {high}}}" for name, low, high in kinds)
    head = f"{tables}," if tables else ""
    return f"""WITH {head} src AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY x, y) - 1 AS place, count(*) OVER () AS n FROM (
  SELECT x::DOUBLE AS x, y::DOUBLE AS y FROM ({source}) WHERE x IS NOT NULL AND y IS NOT NULL)),
nodes0 AS MATERIALIZED (SELECT rep, start, n, 0::BIGINT AS a, ((n + {BLOCK - 1}) // {BLOCK})::BIGINT AS b, n::BIGINT AS picks FROM (SELECT DISTINCT n FROM src),
  {_step(f"(SELECT unnest(range(1, {reps + 1})) AS rep)", _times("1", f"{seed} * {_GOLDEN}"), "rep", "start")}),
{splits},
drawn AS (SELECT rep, a * {BLOCK} + floor({_UNIT.format("h4")} * {_rows("a", "a + 1")})::BIGINT AS place FROM
  {_step(f'(SELECT *, unnest(range(1, picks + 1)) AS i FROM {_step(f"nodes{LEVELS}", "start", "2 * a + 2", "h3")})', "h3", "i", "h4")}),
vals AS MATERIALIZED (SELECT rep, CASE WHEN {varies} THEN {value} END AS t FROM drawn JOIN src USING (place) GROUP BY rep),
{acceleration},
one AS (SELECT count(t) AS reps, avg(t) AS mean, stddev_samp(t) AS sd, list(t ORDER BY t) AS v, any_value(t0) AS t0, any_value(acc) AS acc,
  count(*) FILTER (t < t0)::DOUBLE / count(t) AS below FROM vals, (SELECT {value} AS t0 FROM src), acc WHERE t IS NOT NULL),
two AS MATERIALIZED (SELECT *, {q_norm("below")} AS z0 FROM one),
points AS (SELECT reps, v, pt.name, pt.p, greatest(1, least(reps - 1, floor((reps + 1) * pt.p)::BIGINT)) AS k FROM (SELECT reps, v, unnest({points}) AS pt FROM two)),
found AS (SELECT name, v[k] + (v[k + 1] - v[k]) * (zp - zl) / (zh - zl) AS value FROM (SELECT *, {q_norm("p")} AS zp,
  {q_norm("(k::DOUBLE / (reps + 1))")} AS zl, {q_norm("((k + 1)::DOUBLE / (reps + 1))")} AS zh FROM points)),
wide AS (SELECT max(value) FILTER (name = 'low') AS low, max(value) FILTER (name = 'high') AS high,
  max(value) FILTER (name = 'blow') AS blow, max(value) FILTER (name = 'bhigh') AS bhigh FROM found)
SELECT c.method, round(t0, 6) + 0.0 AS estimate, round(c.low, 6) + 0.0 AS conf_low, round(c.high, 6) + 0.0 AS conf_high
FROM (SELECT t0, unnest([{listed}]) AS c FROM two, wide)"""


_CORR = ("corr(x, y)", "count(DISTINCT x) > 1 AND count(DISTINCT y) > 1")
_POOLED_PRESENCE = "SELECT cross_item_mean_proptcorr AS x, prop_op_avg AS y FROM pooled"
_AUDIO_TYPES = "SELECT cross_item_mean_proptcorr AS x, numtypes AS y FROM merged WHERE audio_video = 'audio'"
SQL["bootstrap_corr"] = bootstrap(_CUST, "SELECT x, y FROM cust", *_CORR)
SQL["bootstrap_presence"] = bootstrap(_MERGED, _POOLED_PRESENCE, *_CORR)
SQL["bootstrap_types"] = bootstrap(_MERGED, _AUDIO_TYPES, *_CORR)
SQL["bootstrap_spending"] = bootstrap(_CUST, "SELECT x, y FROM cust", "sum(y) / sum(x)", accelerated=False)


# ----------------------------------------------------------------- Huber line

def _huber(tables: str, source: str, select: str) -> str:
    """Twenty steps at most from the least-squares line; each step is one row of ``it``."""
    sums = "sum({0}) AS w, sum({0} * x) AS wx, sum({0} * y) AS wy, sum({0} * x * x) AS wxx, sum({0} * x * y) AS wxy"
    slope, inter = "(w * wxy - wx * wy) / (w * wxx - wx * wx)", "(wy - (w * wxy - wx * wy) / (w * wxx - wx * wx) * wx) / w"
    head = f"{tables}," if tables else ""
    left = "abs(y - (a + b * x))"
    return f"""WITH RECURSIVE {head} raw AS (SELECT x::DOUBLE AS x, y::DOUBLE AS y FROM ({source}) WHERE x IS NOT NULL AND y IS NOT NULL),
mid AS (SELECT avg(x) AS mx, avg(y) AS my, count(*) AS n FROM raw),
pts AS MATERIALIZED (SELECT x - mx AS x, y - my AS y FROM raw, mid),
plain AS MATERIALIZED (SELECT {sums.format("1.0::DOUBLE")} FROM pts),
it AS (
  SELECT 0 AS step, {inter} AS a, {slope} AS b, 0.0::DOUBLE AS scale, false AS done, w, wx, wxx FROM plain
  UNION ALL
  SELECT step + 1, CASE WHEN scale > 0 THEN {inter} ELSE a END, CASE WHEN scale > 0 THEN {slope} ELSE b END, scale,
    scale = 0 OR sqrt(greatest(0.0, pow({inter} - a, 2) * pw + 2 * ({inter} - a) * ({slope} - b) * pwx + pow({slope} - b, 2) * pwxx) / greatest(1e-20, rr)) <= 1e-4, w, wx, wxx
  FROM (SELECT step, a, b, scale, pw, pwx, pwxx, sum(pow({left}, 2)) AS rr, {sums.format(f"(CASE WHEN {left} <= 1.345 * scale OR scale = 0 THEN 1.0 ELSE 1.345 * scale / {left} END)")}
    FROM (SELECT step, a, b, median({left}) / 0.6745 AS scale FROM it, pts WHERE NOT done AND step < 20 GROUP BY step, a, b) s, pts,
      (SELECT w AS pw, wx AS pwx, wxx AS pwxx FROM plain) GROUP BY ALL)),
line AS (SELECT it.*, mx, my, n FROM it, mid ORDER BY step DESC LIMIT 1)
{select}"""


_LINE = """SELECT round(a + my - b * mx, 6) + 0.0 AS intercept, round(b, 6) + 0.0 AS slope, round(scale, 6) + 0.0 AS scale, n, step::INTEGER AS iterations, done AS converged FROM line"""
_BAND = """SELECT round(x, 6) + 0.0 AS x, round(fit, 6) + 0.0 AS fit, round(fit - 1.959963984540054 * se, 6) + 0.0 AS conf_low, round(fit + 1.959963984540054 * se, 6) + 0.0 AS conf_high
FROM (SELECT r.x, a + my - b * mx + b * r.x AS fit, scale * sqrt((wxx - 2 * wx * (r.x - mx) + w * (r.x - mx) * (r.x - mx)) / (w * wxx - wx * wx)) AS se
  FROM (SELECT DISTINCT x FROM raw) r, line)"""
_PRESENCE_LINE = "SELECT prop_op_avg AS x, cross_item_mean_proptcorr AS y FROM pooled"
SQL["huber_fit"] = _huber(_CUST, "SELECT x, y FROM cust", _LINE)
SQL["robust_band"] = _huber(_CUST, "SELECT x, y FROM cust", _BAND).replace("round(x, 6) + 0.0 AS x", "x::BIGINT AS x")
SQL["huber_presence"] = _huber(_MERGED, _PRESENCE_LINE, _LINE)
SQL["presence_band"] = _huber(_MERGED, _PRESENCE_LINE, _BAND)


# --------------------------------------------------------- penalised spline

_SIZE = 10
_POWERS = [x / 2 for x in range(-12, 5)]


def _penalty() -> str:
    """Squared second differences of the coefficients as a table of (i, j, r)."""
    cells: dict[tuple[int, int], int] = {}
    for at in range(1, _SIZE - 1):
        for i, a in enumerate((1, -2, 1)):
            for j, b in enumerate((1, -2, 1)):
                cells[at + i, at + j] = cells.get((at + i, at + j), 0) + a * b
    return "VALUES " + ", ".join(f"({i}, {j}, {r})" for (i, j), r in sorted(cells.items()))


def spline(points: str, start: float, stop: float) -> str:
    """CTEs up to ``curve`` (g, x, smooth, variance); ``points`` names a table (g, x, w, total, squares).

    Each penalty's system stands beside A, the loads and the unit matrix; ten steps of elimination
    turn it into the smoother, the coefficients and the inverse.
    """
    pieces = _SIZE - 3
    place = f"((x - ({start})) / {(stop - start) / pieces!r}::DOUBLE)"
    piece = f"greatest(0, least({pieces - 1}, floor({place})))"
    four = ["(1 - t) * (1 - t) * (1 - t) / 6", "(3 * t * t * t - 6 * t * t + 4) / 6", "(-3 * t * t * t + 3 * t * t + 3 * t + 1) / 6", "t * t * t / 6"]
    listed = ", ".join("CASE " + " ".join(f"WHEN piece = {i - k} THEN {f}" for k, f in enumerate(four)) + " ELSE 0.0::DOUBLE END" for i in range(_SIZE))
    steps = []
    for k in range(1, _SIZE + 1):
        steps.append(f"""g{k} AS MATERIALIZED (SELECT a.g, a.power, a.i, a.j, CASE WHEN a.i = {k} THEN a.v / p.v ELSE a.v - c.v * r.v / p.v END AS v
  FROM g{k - 1} a JOIN g{k - 1} p ON p.g = a.g AND p.power = a.power AND p.i = {k} AND p.j = {k}
  JOIN g{k - 1} r ON r.g = a.g AND r.power = a.power AND r.i = {k} AND r.j = a.j JOIN g{k - 1} c ON c.g = a.g AND c.power = a.power AND c.i = a.i AND c.j = {k})""")
    return f"""bas AS MATERIALIZED (SELECT *, [{listed}] AS b FROM (SELECT *, {place} - piece AS t FROM (SELECT *, {piece} AS piece FROM {points}))),
side AS (SELECT unnest(range(1, {_SIZE + 1})) AS i),
amat AS MATERIALIZED (SELECT g, i, j, sum(w * b[i] * b[j]) AS v FROM bas, side, (SELECT i AS j FROM side) GROUP BY ALL),
load AS MATERIALIZED (SELECT g, i, sum(total * b[i]) AS v FROM bas, side GROUP BY ALL),
whole AS MATERIALIZED (SELECT g, sum(w)::DOUBLE AS w, sum(squares)::DOUBLE AS squares FROM bas GROUP BY g),
pen(i, j, r) AS ({_penalty()}),
powers AS (SELECT unnest([{", ".join(f"{p}::DOUBLE" for p in _POWERS)}]) AS power),
g0 AS MATERIALIZED (SELECT a.g, power, a.i::BIGINT AS i, a.j::BIGINT AS j, a.v + w * pow(10, power) * coalesce(r, 0) AS v FROM amat a JOIN whole USING (g) LEFT JOIN pen ON pen.i = a.i AND pen.j = a.j, powers
  UNION ALL SELECT g, power, i, j + {_SIZE}, v FROM amat, powers UNION ALL SELECT g, power, i, {2 * _SIZE + 1}, v FROM load, powers
  UNION ALL SELECT g, power, i, i2 + {2 * _SIZE + 1}, CASE WHEN i = i2 THEN 1.0 ELSE 0.0 END FROM whole, powers, side, (SELECT i AS i2 FROM side)),
{", ".join(steps)},
fit AS (SELECT g, power, sum(v) FILTER (j = i + {_SIZE}) AS freedom FROM g{_SIZE} GROUP BY ALL),
rest AS (SELECT g, power, squares - 2 * cb + cac AS left_, w FROM whole JOIN (SELECT c.g, c.power, sum(c.v * l.v) AS cb FROM g{_SIZE} c JOIN load l ON l.g = c.g AND l.i = c.i
  WHERE c.j = {2 * _SIZE + 1} GROUP BY ALL) USING (g) JOIN (SELECT c.g, c.power, sum(c.v * a.v * d.v) AS cac FROM g{_SIZE} c JOIN amat a ON a.g = c.g AND a.i = c.i
  JOIN g{_SIZE} d ON d.g = c.g AND d.power = c.power AND d.i = a.j AND d.j = {2 * _SIZE + 1} WHERE c.j = {2 * _SIZE + 1} GROUP BY ALL) USING (g, power)),
best AS MATERIALIZED (SELECT g, power, left_ / (w - freedom) AS sigma2 FROM fit JOIN rest USING (g, power) WHERE w > freedom
  QUALIFY row_number() OVER (PARTITION BY g ORDER BY w * left_ / pow(w - freedom, 2)) = 1),
curve AS (SELECT * FROM (SELECT g, x, sum(c.v * b[c.i]) AS smooth FROM bas JOIN best USING (g) JOIN g{_SIZE} c USING (g, power) WHERE c.j = {2 * _SIZE + 1} GROUP BY ALL)
  JOIN (SELECT g, x, sum(b[c.i] * c.v * b[c.j - {2 * _SIZE + 1}]) * any_value(sigma2) AS variance FROM bas JOIN best USING (g) JOIN g{_SIZE} c USING (g, power)
    WHERE c.j > {2 * _SIZE + 1} GROUP BY ALL) USING (g, x))"""


def _timecourse() -> str:
    step = lambda t: (f"{t} + ({t_p(t, 'df')} - 0.05) / 2 / (exp(lgamma((df + 1) / 2) - lgamma(df / 2)) "  # noqa: E731
                      f"/ sqrt(df * pi()) * pow(1 + {t} * {t} / df, -(df + 1) / 2))")
    return f"""WITH {_LOOK},
seen AS MATERIALIZED (SELECT trialtype AS g, Nonset AS x, count(propt) AS w, coalesce(sum(propt), 0) AS total, coalesce(sum(propt), 0) AS squares, avg(propt) AS propt,
  stddev_samp(propt) AS sd, CASE WHEN count(propt) > 1 THEN count(propt) - 1.0 END AS df FROM bins
  WHERE month = '06' AND Nonset > -750 AND Nonset < 5000 AND subj NOT IN (SELECT subj FROM single06) GROUP BY ALL),
{spline("seen", -750.0, 5000.0)}
SELECT g AS trialtype, x AS Nonset, w AS n, round(propt, 6) + 0.0 AS propt, round(sd, 6) + 0.0 AS sd,
  round(propt - t4 * sd / sqrt(w), 6) + 0.0 AS conf_low, round(propt + t4 * sd / sqrt(w), 6) + 0.0 AS conf_high, round(smooth, 6) + 0.0 AS smooth,
  round(smooth - 1.959963984540054 * sqrt(greatest(variance, 0)), 6) + 0.0 AS smooth_low, round(smooth + 1.959963984540054 * sqrt(greatest(variance, 0)), 6) + 0.0 AS smooth_high
FROM (SELECT *, {step("t3")} AS t4 FROM (SELECT *, {step("t2")} AS t3 FROM (SELECT *, {step("t1")} AS t2 FROM (SELECT *, {step("t0")} AS t1 FROM (
  SELECT *, {t_q975("df")} AS t0 FROM seen))))) LEFT JOIN curve USING (g, x)"""


SQL["timecourse"] = _timecourse()


# ------------------------------------------------------ Spearman's exact law

def _edgeworth() -> str:
    """Lower tail of d among n by the published series; x and b = 1 / n are columns."""
    c = [0.2274, 0.2531, 0.1745, 0.0758, 0.1033, 0.3932, 0.0879, 0.0151, 0.0072, 0.0831, 0.0131, 4.6e-4]
    y = "x * x"
    inner = f"({c[6]} + {c[7]} * b - {y} * ({c[8]} - {c[9]} * b + {y} * b * ({c[10]} - {c[11]} * {y})))"
    odd = f"({c[0]} + b * ({c[1]} + {c[2]} * b) + {y} * (-{c[3]} + b * ({c[4]} + {c[5]} * b) - {y} * b * {inner}))"
    return f"((CASE WHEN x > 0 THEN 1 - {z_p('x')} / 2 ELSE {z_p('x')} / 2 END) - x * b * {odd} / exp({y} / 2))"


_RANKS = ", ".join(f"rank() OVER (PARTITION BY g ORDER BY {c}) + (count(*) OVER (PARTITION BY g, {c}) - 1) / 2.0 AS r{c}" for c in "xy")
_UNTIED = f"""src AS MATERIALIZED (SELECT c_nationkey AS g, y AS x, c_acctbal AS y FROM cust JOIN customer ON o_custkey = c_custkey WHERE c_acctbal IS NOT NULL),
ranked AS MATERIALIZED (SELECT *, {_RANKS} FROM src),
st(n, i, used, s, c) AS (SELECT m, 0, 0, 0, 1.0::DOUBLE FROM range(2, 10) r(m) UNION ALL
  SELECT n, i + 1, used | (1 << j::INTEGER), s + ((i - j) * (i - j))::INTEGER, sum(c) FROM st, range(0, 9) r(j) WHERE i < n AND j < n AND (used >> j::INTEGER) & 1 = 0 GROUP BY ALL),
law AS MATERIALIZED (SELECT n, s, sum(c) OVER (PARTITION BY n ORDER BY s) / sum(c) OVER (PARTITION BY n) AS p FROM (SELECT n, s, sum(c) AS c FROM st WHERE i = n GROUP BY n, s)),
facts AS (SELECT g, count(*)::DOUBLE AS n, count(DISTINCT x) = count(*) AND count(DISTINCT y) = count(*) AS untied, sum((rx - ry) * (rx - ry))::DOUBLE AS s FROM ranked GROUP BY g),
least_ AS (SELECT *, least(s, (n * n * n - n) / 3 - s) AS d, 1 / n AS b FROM facts),
tails AS (SELECT *, (6 * (d + 1) / (n * (n * n - 1)) - 1) * sqrt(n - 1) AS x FROM least_ WHERE untied AND n BETWEEN 2 AND 1289),
exact AS (SELECT g, greatest(0.0, least(1.0, 2 * CASE WHEN n <= 9 THEN (SELECT max(p) FROM law WHERE law.n = tails.n AND law.s <= tails.d) ELSE {_edgeworth()} END)) AS pe FROM tails)"""
_APPROXIMATE = _pearson("(SELECT g, rx AS x, ry AS y FROM ranked)", "g", rank=True)
SQL["cor_spearman_untied"] = f"""WITH RECURSIVE {_CUST}, {_UNTIED}
SELECT * REPLACE ({", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in TIDY_D.split())}) FROM (
  SELECT a.g AS c_nationkey, estimate, statistic, parameter, coalesce(pe, p_value) AS p_value, conf_low, conf_high, method
  FROM ({_APPROXIMATE}) a LEFT JOIN exact USING (g))"""


# ------------------------------------------------- both scenarios at once

_STAYS = "NOT (target = 'milk' AND subj IN (SELECT subj FROM listed))"
_SPREAD = "abs({0} - avg({0}) OVER (PARTITION BY scenario, {1})) > 3 * stddev_samp({0}) OVER (PARTITION BY scenario, {1}) AS outlier"
_SCENARIOS = _LOOK + f""",
listed AS (SELECT DISTINCT (c_custkey // 10)::VARCHAR AS subj FROM customer WHERE c_acctbal < 0),
swords AS (SELECT 'all' AS scenario, * FROM words UNION ALL SELECT 'without_item', * FROM words WHERE {_STAYS}),
scounted AS (SELECT 'all' AS scenario, * FROM counted UNION ALL SELECT 'without_item', * FROM counted WHERE {_STAYS}),
stypes AS (SELECT * FROM (SELECT *, {_SPREAD.format("cross_item_mean_proptcorrTT", "month")} FROM (SELECT scenario, subj, month, SubjectNumber, trialtype, numtrials, numtrials_TT,
  avg(propt_long) AS cross_item_mean_proptTT, avg(proptcorr) AS cross_item_mean_proptcorrTT, avg(propt_pre) AS cross_item_mean_proptpreTT FROM scounted GROUP BY ALL))
  WHERE NOT outlier AND month = '06'),
ssubjects AS (SELECT * FROM (SELECT *, {_SPREAD.format("cross_item_mean_proptcorr", "month")} FROM (SELECT scenario, subj, month, SubjectNumber,
  avg(propt_long) AS cross_item_mean_propt, avg(proptcorr) AS cross_item_mean_proptcorr, avg(propt_pre) AS cross_item_mean_proptpre FROM swords GROUP BY ALL))
  WHERE NOT outlier AND month = '06'),
ssingle AS (SELECT scenario, subj, count(*) AS n FROM stypes GROUP BY ALL HAVING count(*) <> 2),
stested AS (SELECT * FROM stypes WHERE (scenario, subj) NOT IN (SELECT (scenario, subj) FROM ssingle))"""
SQL["scenario_subject_types"] = q(_SCENARIOS, "SELECT * FROM stypes", _ST)
SQL["scenario_items"] = q(_SCENARIOS, f"""SELECT * FROM (SELECT *, {_SPREAD.format("cross_item_mean_proptcorrTT", "month, trialtype")} FROM (
  SELECT scenario, target, month, trialtype, avg(propt_long) AS cross_item_mean_proptTT, avg(proptcorr) AS cross_item_mean_proptcorrTT,
    avg(propt_pre) AS cross_item_mean_proptpreTT FROM scounted GROUP BY ALL)) WHERE month = '06'""", _ST)
SQL["scenario_subjects"] = q(_SCENARIOS, "SELECT * FROM ssubjects", _SS)
SQL["scenario_single_condition"] = q(_SCENARIOS, "SELECT * FROM ssingle")
SQL["scenario_normality"] = q(f"""{_SCENARIOS}, slong AS (SELECT scenario, 'cross_item_mean_proptcorrTT' AS measure, cross_item_mean_proptcorrTT AS v FROM stypes
  UNION ALL SELECT scenario, 'cross_item_mean_proptcorr', cross_item_mean_proptcorr FROM ssubjects)""", _shapiro("slong", "scenario, measure"), TIDY_D)
_PAIRED = """(SELECT scenario, max(cross_item_mean_proptcorrTT) FILTER (trialtype = 'between') - max(cross_item_mean_proptcorrTT) FILTER (trialtype = 'within') AS d
  FROM stested GROUP BY scenario, subj)"""
_OVERALL = "(SELECT * FROM ssubjects WHERE subj NOT LIKE 'ns%' AND subj NOT IN (SELECT subj FROM single06))"
SQL["scenario_tests"] = q(_SCENARIOS, f"""SELECT scenario, trialtype AS test, * EXCLUDE (scenario, trialtype) FROM ({_t_test("stested", "cross_item_mean_proptcorrTT", "scenario, trialtype")})
  UNION ALL SELECT scenario, 'paired', * EXCLUDE (scenario) FROM ({_t_test(_PAIRED, "d", "scenario", "Paired t-test")})
  UNION ALL SELECT scenario, 'overall', * EXCLUDE (scenario) FROM ({_t_test(_OVERALL, "cross_item_mean_proptcorr", "scenario")})""", TIDY_D)


# ------------------------------------------------------ reports and sources

_MEASURED = [("numtokens", "# tokens"), ("numtypes", "# types"), ("numspeakers", "# speakers"), ("prop_mom", "prop mat input"),
             ("prop_op", "prop obj.co-p."), ("ent_subj_av", "utt type ent")]
SQL["descriptive_table"] = q(_HOME, " UNION ALL ".join(
    f"SELECT '{label}' AS \" \", " + ", ".join(f'{_range(c)} AS "{name}"' for c, name in _MEASURED) + f", {_range('propn', 1, last)} AS \"prop short phrase\" FROM rec06 WHERE {test}"
    for label, test, last in [("aud", "audio_video = 'audio'", 2), ("vid", "audio_video = 'video'", 1), ("both", "true", 1)]))
_LEVELS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS level, count(*) AS n FROM ann GROUP BY {c}" for c in ["speaker", "utterance_type", "object_present", "basic_level"])
SQL["level_summary"] = q(_ANN + f""", levels AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, level NULLS LAST)::INTEGER AS place, count(*) OVER (PARTITION BY "column") AS many FROM ({_LEVELS}))""",
    """SELECT "column", place, level, n FROM levels WHERE many <= 7 OR place < 7
    UNION ALL SELECT "column", 7, '(Other)', sum(n)::BIGINT FROM levels WHERE many > 7 AND place >= 7 GROUP BY ALL""")
SQL["points_with_interval"] = q(_LOOK, f"""SELECT subj, month, trialtype, CASE trialtype WHEN 'between' THEN 'unrelated' ELSE 'related' END AS label, cross_item_mean_proptcorrTT,
    t.n, t.mean, t.conf_low, t.conf_high, t.proppos FROM tested JOIN (SELECT trialtype, estimate AS mean, conf_low, conf_high, n, proppos FROM (
      {_t_test("tested", "cross_item_mean_proptcorrTT", "trialtype")}) JOIN (SELECT trialtype, count(*) AS n,
      count(*) FILTER (cross_item_mean_proptcorrTT > 0) || '/' || count(*) AS proppos FROM tested GROUP BY ALL) USING (trialtype)) t USING (trialtype)""",
    "cross_item_mean_proptcorrTT mean conf_low conf_high")
SQL["tab_report"] = """SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS users, round(sum(value), 3) AS values, count(*) FILTER (event_id % 3 = 0) AS empty FROM events GROUP BY ALL"""
SQL["month_extract"] = q(_ANN, """SELECT subj, born, count(*) AS n, sum(words)::BIGINT AS words FROM (SELECT subj, speaker, count(*) AS words FROM ann WHERE month = '06' GROUP BY ALL)
    LEFT JOIN (SELECT (c_custkey // 10)::VARCHAR AS subj, min(c_custkey) AS born FROM customer GROUP BY ALL) USING (subj) GROUP BY ALL""")
SQL["numbered_table"] = """SELECT p_name || ', "' || p_brand || '"' AS "Measure", p_type || ', R: 0-' || p_size AS "Lab Only" FROM part"""
SQL["delimited_round_trip"] = """SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 10 > 0 THEN c_name || ', "' || c_mktsegment || '"' END AS note FROM customer"""

_SHOWN = ", ".join(TIDY_D.split())
SQL["inline_results"] = f"""SELECT *, 'estimate=' || {number("estimate", 3)} || ', statistic=' || {number("statistic", 2)}
  || ', df=' || {number("parameter", 2)} || ', p=' || {number("p_value", 3)} AS text FROM (
  SELECT CASE trialtype WHEN 'between' THEN 'unrelated' ELSE 'related' END AS name, {_SHOWN}, method FROM ({SQL["ttest_one"]})
  UNION ALL SELECT 'paired', {_SHOWN}, method FROM ({SQL["ttest_paired"]}) UNION ALL SELECT 'overall', {_SHOWN}, method FROM ({SQL["ttest_overall"]})
  UNION ALL SELECT pair, {_SHOWN}, method FROM ({SQL["cor_outcome"]}) WHERE pair IN ('prop_op', 'aud_numtypes', 'aud_numtokens', 'aud_read', 'entropy', 'prop_n'))"""
