"""The registered queries written as plain SQL, without any of the library's shortcuts.

Bins are really generated, means are means over bins, ranks are window ranks, Kendall's
tau compares all pairs, p-values are numerical integrals. ``SQL`` maps a query name to a
text DuckDB can run on the source tables.
"""

from __future__ import annotations

from lexigaze.plans.study_tables import SPEAKERS, TESTED_BRANDS, UTTERANCES


# Fixed values, written out anew so that a wrong one in the library shows: Wichura's AS 241
# approximations of the normal quantile and Royston's AS R94 weights, ascending powers.
_NORMAL_CENTRE = (
    [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
     1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
     3.3430575583588128105e4, 2.5090809287301226727e3],
    [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
     5.2264952788528545610e3],
)
_NORMAL_SHOULDER = (
    [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
     3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
     2.27238449892691845833e-2, 7.74545014278341407640e-4],
    [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
     1.05075007164441684324e-9],
)
_NORMAL_TAIL = (
    [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
     2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
     2.71155556874348757815e-5, 2.01033439929228813265e-7],
    [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
     2.04426310338993978564e-15],
)
_LAST_WEIGHT = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
_NEXT_WEIGHT = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
_LARGE_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
_LARGE_LOG_SD = [-0.4803, -0.082676, 0.0030302]


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# ------------------------------------------------------------- shared tables

_LOG = """
log AS (
  SELECT *, (us - block * 259200000000) / 36000000.0::DOUBLE AS ms,
    CASE WHEN block < 5 THEN '06' ELSE '12' END AS month,
    (CASE WHEN user_id % 5 = 0 THEN 'ns' ELSE '' END) || user_id::VARCHAR AS subj,
    (block % 5 + 1)::INTEGER AS TrialNumber
  FROM (SELECT *, us // 259200000000 AS block FROM (
    SELECT event_type, value, user_id,
           epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS us FROM events)))"""

_FIX = _LOG + """,
fix0 AS (
  SELECT *, subj || '_' || month AS label, (block + user_id) % 2 = 0 AS unrelated,
    (['ball', 'car', 'juice', 'milk'])[((block + user_id // 2) % 4 + 1)::INTEGER] AS target,
    (['can', 'do', 'look', 'where'])[(block % 4 + 1)::INTEGER] AS carrier,
    (block = 9 AND user_id % 7 = 0) AS practice,
    CASE event_type WHEN 'view' THEN 'TARGET' WHEN 'click' THEN 'DISTRACTOR' ELSE '.' END AS area,
    CASE WHEN (user_id + block) % 11 = 0 THEN -1.0::DOUBLE ELSE 1000.0::DOUBLE END AS RT,
    ms AS fix_start, ms + value * 25.0::DOUBLE AS fix_end
  FROM log),
fix AS (
  SELECT *, CASE WHEN practice THEN 'p1' ELSE TrialNumber::VARCHAR END AS trial,
    CASE WHEN practice THEN '.' WHEN unrelated THEN 'between' ELSE 'within' END AS trialtype,
    CASE WHEN unrelated AND target IN ('ball', 'milk') THEN 'ball_milk'
         WHEN unrelated THEN 'car_juice'
         WHEN target IN ('ball', 'car') THEN 'ball_car' ELSE 'juice_milk' END AS pair,
    CASE WHEN event_type <> 'error' THEN carrier || '_' || target || '.wav' END AS audiotarget
  FROM fix0),
msg AS (SELECT label, TrialNumber, min(fix_start) AS TargetOnset FROM fix
        WHERE event_type = 'signup' GROUP BY ALL)"""

_BINS = _FIX + """,
bin0 AS (
  SELECT f.*, unnest(generate_series(ceil(fix_start / 20)::BIGINT, ceil(fix_end / 20)::BIGINT - 1)) AS timeBin
  FROM fix f WHERE audiotarget IS NOT NULL),
bin1 AS (
  SELECT CASE b.label WHEN '39_12' THEN '39_12_6' ELSE b.label END AS SubjectNumber, b.subj, b.month, b.TrialNumber, b.target, b.trialtype, b.pair,
    CASE WHEN split_part(pair, '_', 2) = target THEN 'two' ELSE 'one' END AS num,
    CASE WHEN area <> '.' THEN area END AS gaze,
    CASE area WHEN 'TARGET' THEN 1.0::DOUBLE WHEN 'DISTRACTOR' THEN 0.0::DOUBLE END AS propt,
    timeBin, m.TargetOnset, ((timeBin - floor(TargetOnset / 20)) * 20)::DOUBLE AS Nonset,
    CASE WHEN timeBin * 20 <= TargetOnset THEN 'Y' ELSE 'N' END AS prewin,
    CASE WHEN timeBin >= TargetOnset / 20 + 18 AND timeBin <= TargetOnset / 20 + 250
         THEN 'Y' ELSE 'N' END AS longwin
  FROM bin0 b JOIN msg m USING (label, TrialNumber)
  WHERE trial NOT IN ('p1', 'p2', 'p3', 'p4') AND trialtype <> '.'),
bin2 AS (SELECT *, CASE WHEN prewin = 'Y' THEN 'pre' WHEN longwin = 'Y' THEN 'long'
                        ELSE 'neither' END AS whichwin FROM bin1),
low AS (SELECT SubjectNumber, TrialNumber, (232 - count(propt)) * 20 > 3089 AS lowdata
        FROM bin2 WHERE longwin = 'Y' GROUP BY ALL),
bins AS (SELECT b.*, l.lowdata FROM bin2 b LEFT JOIN low l USING (SubjectNumber, TrialNumber)),
withdata AS (SELECT DISTINCT SubjectNumber FROM bins WHERE month = '06' AND NOT lowdata),
pretrials AS (SELECT DISTINCT SubjectNumber, TrialNumber FROM bins WHERE whichwin = 'pre'
  AND month = '06' AND SubjectNumber IN (SELECT SubjectNumber FROM withdata)),
wintrials AS (SELECT DISTINCT SubjectNumber, TrialNumber FROM bins WHERE whichwin = 'long'
  AND month = '06' AND SubjectNumber IN (SELECT SubjectNumber FROM withdata)),
lowtrials AS (SELECT DISTINCT SubjectNumber, TrialNumber FROM bins WHERE lowdata
  AND month = '06' AND SubjectNumber IN (SELECT SubjectNumber FROM withdata)),
nopre AS (SELECT * FROM wintrials EXCEPT SELECT * FROM pretrials)"""

_LOOK = _BINS + """,
trialmeans AS (
  SELECT SubjectNumber, subj, month, target, trialtype, whichwin, TrialNumber, avg(propt) AS propt
  FROM bins WHERE NOT lowdata AND whichwin <> 'neither' GROUP BY ALL),
stage2 AS (SELECT SubjectNumber, subj, month, target, whichwin, avg(propt) AS propt FROM (
    SELECT SubjectNumber, subj, month, target, whichwin, TrialNumber, avg(propt) AS propt
    FROM bins WHERE NOT lowdata AND whichwin <> 'neither' GROUP BY ALL) GROUP BY ALL),
words AS (SELECT *, propt_long - propt_pre AS proptcorr FROM (
  SELECT SubjectNumber, subj, month, target, max(propt) FILTER (whichwin = 'long') AS propt_long,
         max(propt) FILTER (whichwin = 'pre') AS propt_pre FROM stage2 GROUP BY ALL)),
stage2t AS (SELECT SubjectNumber, subj, month, target, trialtype, whichwin, avg(propt) AS propt
            FROM trialmeans GROUP BY ALL),
wordst AS (SELECT *, propt_long - propt_pre AS proptcorr FROM (
  SELECT SubjectNumber, subj, month, target, trialtype,
         max(propt) FILTER (whichwin = 'long') AS propt_long,
         max(propt) FILTER (whichwin = 'pre') AS propt_pre FROM stage2t GROUP BY ALL)),
counted AS (SELECT *, count(*) OVER (PARTITION BY SubjectNumber) AS numtrials,
              count(*) OVER (PARTITION BY SubjectNumber, trialtype) AS numtrials_TT
            FROM wordst WHERE proptcorr IS NOT NULL),
ss0 AS (SELECT subj, month, SubjectNumber, avg(propt_long) AS cross_item_mean_propt,
          avg(proptcorr) AS cross_item_mean_proptcorr, avg(propt_pre) AS cross_item_mean_proptpre
        FROM words GROUP BY ALL),
ss AS (SELECT *, abs(cross_item_mean_proptcorr - avg(cross_item_mean_proptcorr) OVER (PARTITION BY month))
         > 3 * stddev_samp(cross_item_mean_proptcorr) OVER (PARTITION BY month) AS outlier FROM ss0),
st0 AS (SELECT subj, month, SubjectNumber, trialtype, numtrials, numtrials_TT,
          avg(propt_long) AS cross_item_mean_proptTT, avg(proptcorr) AS cross_item_mean_proptcorrTT,
          avg(propt_pre) AS cross_item_mean_proptpreTT FROM counted GROUP BY ALL),
st AS (SELECT *, abs(cross_item_mean_proptcorrTT - avg(cross_item_mean_proptcorrTT) OVER (PARTITION BY month))
         > 3 * stddev_samp(cross_item_mean_proptcorrTT) OVER (PARTITION BY month) AS outlier FROM st0),
single AS (SELECT subj, month, SubjectNumber, count(*) AS n FROM st WHERE NOT outlier
           GROUP BY ALL HAVING count(*) <> 2),
single06 AS (SELECT subj FROM st WHERE NOT outlier AND month = '06' GROUP BY subj HAVING count(*) <> 2),
tested AS (SELECT * FROM st WHERE NOT outlier AND month = '06'
           AND subj NOT IN (SELECT subj FROM single06)),
it0 AS (SELECT target, month, trialtype, avg(propt_long) AS cross_item_mean_proptTT,
          avg(proptcorr) AS cross_item_mean_proptcorrTT, avg(propt_pre) AS cross_item_mean_proptpreTT
        FROM counted WHERE SubjectNumber NOT IN (SELECT SubjectNumber FROM single) GROUP BY ALL),
items AS (SELECT i.*, abs(cross_item_mean_proptcorrTT - avg(cross_item_mean_proptcorrTT)
              OVER (PARTITION BY month, trialtype))
            > 3 * stddev_samp(cross_item_mean_proptcorrTT) OVER (PARTITION BY month, trialtype) AS outlier,
            p.pair FROM it0 i LEFT JOIN (SELECT DISTINCT trialtype, pair, target FROM bins) p
            USING (trialtype, target))"""

_ANN = f"""
ann AS (
  SELECT (o_custkey // 10)::VARCHAR AS subj, lpad(month(o_orderdate)::VARCHAR, 2, '0') AS month,
    (o_custkey // 10)::VARCHAR || '_' || lpad(month(o_orderdate)::VARCHAR, 2, '0') AS SubjectNumber,
    CASE l_linestatus WHEN 'F' THEN 'audio' ELSE 'video' END AS audio_video,
    ({_list(SPEAKERS)})[(l_suppkey % 10 + 1)::INTEGER] AS speaker,
    ({_list(UTTERANCES)})[l_linenumber] AS utterance_type,
    CASE WHEN l_discount >= 0.05 THEN 'y' ELSE 'n' END AS object_present, p_brand AS basic_level
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
onset AS (SELECT subj, min(month::DOUBLE) AS noun_chi_onset FROM ann WHERE speaker = 'CHI' GROUP BY subj)"""

_TESTED = _in(TESTED_BRANDS)


def _n(test: str, name: str) -> str:
    return f"count(*) FILTER ({test}) AS \"{name}\""


_HOME = _ANN + f""",
rec0 AS (
  SELECT subj, month, SubjectNumber, audio_video, count(DISTINCT speaker) AS numspeakers,
    count(*) AS numtokens, count(DISTINCT basic_level) AS numtypes,
    {", ".join(_n(f"speaker = '{s}'", s) for s in SPEAKERS if s != "SIS")},
    {_n(f"basic_level IN {_TESTED}", "num_exp_tokens")},
    count(DISTINCT basic_level) FILTER (basic_level IN {_TESTED}) AS num_exp_types,
    {", ".join(_n(f"utterance_type = '{u}'", u) for u in UTTERANCES if u != "u")},
    {_n("object_present = 'n'", "n_op")}, {_n("object_present = 'y'", "y_op")},
    {_n(f"object_present = 'n' AND basic_level IN {_TESTED}", "n_op_exp")},
    {_n(f"object_present = 'y' AND basic_level IN {_TESTED}", "y_op_exp")},
    count(DISTINCT basic_level) FILTER (speaker = 'CHI') AS CHItypes
  FROM ann GROUP BY ALL),
rec1 AS (
  SELECT *, CASE WHEN y_op > 0 AND n_op > 0 THEN y_op / (y_op + n_op)::DOUBLE ELSE 0.0 END AS prop_op,
    CASE WHEN y_op_exp > 0 AND n_op_exp > 0 THEN y_op_exp / (y_op_exp + n_op_exp)::DOUBLE ELSE 0.0 END AS prop_op_exp,
    "MOT" / numtokens::DOUBLE AS prop_mom, "FAT" / numtokens::DOUBLE AS prop_dad,
    "TVN" + "TVF" + "TVS" + "TVM" + "TOY" + "TVB" AS tech,
    {", ".join(f'"{u}" / numtokens::DOUBLE AS prop{u}' for u in UTTERANCES if u != "u")},
    numtypes / numtokens::DOUBLE AS type_token_ratio, num_exp_types / numtypes::DOUBLE AS exp_type_ratio,
    num_exp_tokens / numtokens::DOUBLE AS exp_token_ratio,
    ("d" + "i" + "q" + "r" + "s" + "n")::DOUBLE AS spoken
  FROM rec0),
rec AS (
  SELECT r.*, prop_mom + prop_dad AS prop_parent, tech / numtokens::DOUBLE AS prop_tech,
    CASE WHEN spoken > 0 THEN {" + ".join(
        f'CASE WHEN "{u}" > 0 THEN -("{u}" / spoken) * log2("{u}" / spoken) ELSE 0 END' for u in "dqsrni")}
    END AS ent_subj_av,
    round_even(propd + propq + props + propr + propn + propi, 2)::DOUBLE AS sum_prop_ut, o.noun_chi_onset,
    NOT (o.noun_chi_onset IS NULL OR month::DOUBLE < o.noun_chi_onset) AS posttalk
  FROM rec1 r LEFT JOIN onset o USING (subj)),
rec06 AS (SELECT * FROM rec WHERE month = '06')"""

_MERGED = _LOOK + "," + _HOME + """,
lab AS (SELECT subj, month, SubjectNumber, numtrials,
    max(cross_item_mean_proptcorrTT) FILTER (trialtype = 'between') AS "between",
    max(cross_item_mean_proptcorrTT) FILTER (trialtype = 'within') AS "within"
  FROM st WHERE NOT outlier AND month = '06' GROUP BY ALL),
merged AS (
  SELECT r.*, lab.numtrials, lab."between", lab."within",
    CASE WHEN "between" IS NOT NULL AND "within" IS NOT NULL THEN s.cross_item_mean_proptcorr END AS cross_item_mean_proptcorr,
    CASE WHEN "between" IS NOT NULL AND "within" IS NOT NULL THEN s.cross_item_mean_proptpre END AS cross_item_mean_proptpre,
    CASE WHEN "between" IS NOT NULL AND "within" IS NOT NULL THEN s.cross_item_mean_propt END AS cross_item_mean_propt
  FROM rec06 r LEFT JOIN lab USING (subj, month, SubjectNumber)
  LEFT JOIN (SELECT * FROM ss WHERE NOT outlier) s USING (subj, month, SubjectNumber)),
pooled AS (
  SELECT subj, SubjectNumber, month, avg(prop_op) AS prop_op_avg, avg(prop_mom) AS prop_mom_avg,
    avg(ent_subj_av) AS ent_subj_avg, avg(propn) AS prop_n_avg,
    avg(cross_item_mean_proptcorr) AS cross_item_mean_proptcorr, avg("between") AS "between", avg("within") AS "within"
  FROM merged WHERE subj IN (SELECT subj FROM merged WHERE audio_video = 'video')
    AND subj IN (SELECT subj FROM merged WHERE audio_video = 'audio') GROUP BY ALL)"""

_CODERS = f"""
coders AS (
  SELECT ({_list(UTTERANCES)})[l_linenumber] AS orig_utt_type,
    ({_list(UTTERANCES)})[(CASE WHEN l_orderkey % 10 = 0 THEN l_linenumber % 7 + 1 ELSE l_linenumber END)::INTEGER] AS new_utt_type,
    CASE WHEN l_discount >= 0.05 THEN 'y' ELSE 'n' END AS orig_present,
    CASE WHEN (l_discount >= 0.05) <> (l_tax >= 0.08) THEN 'y' ELSE 'n' END AS new_present,
    CASE l_linestatus WHEN 'F' THEN 'audio' ELSE 'video' END AS audio_video FROM lineitem)"""

_CUST = """
cust AS (SELECT o_custkey, count(*)::DOUBLE AS x, sum(o_totalprice) AS y FROM orders GROUP BY o_custkey)"""


# ------------------------------------------------------ numerical integrals

def _simpson(f: str, upper: str, steps: int = 2000) -> str:
    """Integral of f(u) from 0 to ``upper``; ``u`` stands for the variable in ``f``."""
    node = f"(({upper}) * i / {steps}.0)"
    weight = f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return (f"(({upper}) / {3 * steps}.0 * list_sum(list_transform(generate_series(0, {steps}), "
            f"lambda i: {weight} * {f.replace('@u', node)})))")


def t_p(t: str, df: str) -> str:
    body = _simpson(f"pow(cos(@u), {df} - 1)", f"atan(abs({t}) / sqrt({df}))")
    return (f"greatest(0.0, 1 - 2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2) - lgamma(0.5)) * {body})")


def z_p(z: str) -> str:
    body = _simpson("exp(-0.5 * @u * @u)", f"least(abs({z}), 12.0)")
    return f"greatest(0.0, 1 - sqrt(2 / pi()) * {body})"


def t_q975(df: str) -> str:
    """Upper 2.5 % point of t by its expansion in 1/df, to start a Newton step from."""
    z = 1.959963984540054
    g = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96,
         (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
         (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    return "(" + f"{z!r}" + "".join(f" + {c!r} / pow({df}, {k})" for k, c in enumerate(g, 1)) + ")"


def _poly(x: str, coefficients) -> str:
    return "(" + " + ".join(f"({c!r}) * pow({x}, {k})" for k, c in enumerate(coefficients)) + ")"


def q_norm(p: str) -> str:
    def part(x, pair):
        return f"{_poly(x, pair[0])} / {_poly(x, pair[1])}"
    r = f"sqrt(-ln(least({p}, 1 - ({p}))))"
    q = f"(({p}) - 0.5)"
    return (f"(CASE WHEN abs({q}) <= 0.425 THEN {q} * {part(f'(0.180625 - {q} * {q})', _NORMAL_CENTRE)} "
            f"ELSE sign({q}) * (CASE WHEN {r} <= 5 THEN {part(f'({r} - 1.6)', _NORMAL_SHOULDER)} "
            f"ELSE {part(f'({r} - 5.0)', _NORMAL_TAIL)} END) END)")


def _with_interval(rows: str) -> str:
    """Rows of estimate, se and parameter with t's 97.5 % point (Newton steps) as limits of the estimate."""
    step = lambda t: (f"{t} + ({t_p(t, 'parameter')} - 0.05) / 2 / (exp(lgamma((parameter + 1) / 2) - lgamma(parameter / 2)) "  # noqa: E731
                      f"/ sqrt(parameter * pi()) * pow(1 + {t} * {t} / parameter, -(parameter + 1) / 2))")
    return f"""SELECT * EXCLUDE (t0, t1, t2, t3, t4), estimate - t4 * se AS conf_low, estimate + t4 * se AS conf_high FROM (
      SELECT *, {step("t3")} AS t4 FROM (SELECT *, {step("t2")} AS t3 FROM (SELECT *, {step("t1")} AS t2 FROM (
      SELECT *, {step("t0")} AS t1 FROM (SELECT *, {t_q975("parameter")} AS t0 FROM ({rows}))))))"""


def _t_test(source: str, value: str, group: str = "", method: str = "One Sample t-test") -> str:
    g, by = (f"{group}, ", f"GROUP BY {group}") if group else ("", "")
    rows = f"""SELECT {g}avg({value}) AS estimate, stddev_samp({value}) / sqrt(count({value})) AS se,
        (count({value}) - 1)::DOUBLE AS parameter FROM {source} {by}"""
    return f"""SELECT {g}estimate, estimate / se AS statistic, parameter, {t_p("(estimate / se)", "parameter")} AS p_value, conf_low, conf_high,
      '{method}' AS method FROM ({_with_interval(rows)})"""


def _welch(source: str, value: str, label: str, a: str, b: str) -> str:
    rows = f"""SELECT m1 - m2 AS estimate, m1 AS estimate1, m2 AS estimate2, sqrt(e1 + e2) AS se,
        (e1 + e2) * (e1 + e2) / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1)) AS parameter FROM (
        SELECT avg({value}) FILTER ({label} = '{a}') AS m1, avg({value}) FILTER ({label} = '{b}') AS m2,
          count({value}) FILTER ({label} = '{a}') AS n1, count({value}) FILTER ({label} = '{b}') AS n2,
          var_samp({value}) FILTER ({label} = '{a}') / n1 AS e1, var_samp({value}) FILTER ({label} = '{b}') / n2 AS e2
        FROM {source})"""
    return f"""SELECT estimate, estimate1, estimate2, estimate / se AS statistic, parameter, {t_p("(estimate / se)", "parameter")} AS p_value,
      conf_low, conf_high, 'Welch Two Sample t-test' AS method FROM ({_with_interval(rows)})"""


def _pearson(source: str, group: str = "", rank: bool = False) -> str:
    g, by = (f"{group}, ", f"GROUP BY {group}") if group else ("", "")
    reach = "1.959963984540054 / sqrt(parameter - 1)"
    limit = lambda sign: f"CASE WHEN parameter > 1 AND abs(estimate) < 1 THEN tanh(atanh(estimate) {sign} {reach}) END"
    n = "(parameter + 2)"
    shown = (f"({n} * {n} * {n} - {n}) * (1 - estimate) / 6 AS statistic, NULL::DOUBLE AS parameter" if rank else "statistic, parameter")
    limits = "NULL::DOUBLE AS conf_low, NULL::DOUBLE AS conf_high" if rank else f"{limit('-')} AS conf_low, {limit('+')} AS conf_high"
    method = "Spearman''s rank correlation rho" if rank else "Pearson''s product-moment correlation"
    return f"""SELECT {g}estimate, {shown},
        CASE WHEN parameter > 0 THEN {t_p("statistic", "parameter")} END AS p_value, {limits}, '{method}' AS method FROM (
      SELECT {g}estimate, CASE WHEN parameter > 0 THEN estimate * sqrt(parameter) / sqrt((1 - estimate) * (1 + estimate)) END AS statistic, parameter FROM (
        SELECT {g}corr(x, y) AS estimate, (count(*) - 2)::DOUBLE AS parameter FROM {source}
        WHERE x IS NOT NULL AND y IS NOT NULL {by}))"""


def _kendall(source: str, group: str = "") -> str:
    """All pairs compared (source columns x, y and, with a group, the group column)."""
    g, by = (f"{group}, ", f"GROUP BY {group}") if group else ("", "")
    same = f"AND a.{group} = b.{group}" if group else ""
    using = f"JOIN {{}} USING ({group})" if group else "CROSS JOIN {}"
    tie = lambda c: f"""(SELECT {g}sum(t * (t - 1) / 2) AS p{c}, sum(t * (t - 1) * (2 * t + 5)) AS a{c},
        sum(t * (t - 1) * (t - 2)) AS "b{c}" FROM (SELECT {g}{c}, count(*)::DOUBLE AS t FROM src GROUP BY {g}{c}) {by}) t{c}"""  # noqa: E731
    return f"""SELECT {g}estimate, z AS statistic, NULL::DOUBLE AS parameter, {z_p("z")} AS p_value, NULL::DOUBLE AS conf_low,
        NULL::DOUBLE AS conf_high, 'Kendall''s rank correlation tau' AS method FROM (
      SELECT {g}s / sqrt((n * (n - 1) / 2 - px) * (n * (n - 1) / 2 - py)) AS estimate,
        s / sqrt((n * (n - 1) * (2 * n + 5) - ax - ay) / 18 + 2 * px * py / (n * (n - 1))
                 + bx * by_ / (9 * n * (n - 1) * (n - 2))) AS z FROM (
        SELECT {g}s, n, px, py, ax, ay, bx, "by" AS by_ FROM (
          WITH src AS (SELECT row_number() OVER () AS id, * FROM {source} WHERE x IS NOT NULL AND y IS NOT NULL)
          SELECT * FROM (SELECT {"a." + g if group else ""}sum(sign(a.x - b.x) * sign(a.y - b.y))::DOUBLE AS s
                         FROM src a JOIN src b ON a.id < b.id {same} {"GROUP BY a." + group if group else ""}) s
          {using.format(f"(SELECT {g}count(*)::DOUBLE AS n FROM src {by}) n")}
          {using.format(tie("x"))} {using.format(tie("y"))})))"""


def _shapiro(source: str, group: str) -> str:
    """W and p; source has the group columns and v."""
    u = "(1 / sqrt(n))"
    one = "(mm - 2 * mn * mn) / (1 - 2 * an * an)"
    two = "(mm - 2 * mn * mn - 2 * mp * mp) / (1 - 2 * an * an - 2 * ap * ap)"
    log_n = "ln(n)"
    large = f"((ln(1 - w) - {_poly(log_n, _LARGE_MEAN)}) / exp({_poly(log_n, _LARGE_LOG_SD)}))"
    return f"""SELECT {group}, NULL::DOUBLE AS estimate, w AS statistic, n AS parameter,
      CASE WHEN z > 0 THEN {z_p("z")} / 2 ELSE 1 - {z_p("z")} / 2 END AS p_value, NULL::DOUBLE AS conf_low, NULL::DOUBLE AS conf_high,
      'Shapiro-Wilk normality test' || CASE WHEN n > 5000 THEN ', p beyond the fitted sizes' ELSE '' END AS method FROM (
      SELECT *, {large} AS z FROM (
      SELECT {group}, n, pow(an * (vn - v1) + ap * (vp - v2)
          + (mv - mn * (vn - v1) - mp * (vp - v2)) / sqrt({two}), 2) / ss AS w FROM (
        SELECT *, {_poly(u, _LAST_WEIGHT)} + mn / sqrt(mm) AS an,
          {_poly(u, _NEXT_WEIGHT)} + mp / sqrt(mm) AS ap FROM (
          SELECT {group}, n, sum(m * m) AS mm, sum(m * v) AS mv, sum((v - c) * (v - c)) AS ss,
            max(v) FILTER (i = 1) AS v1, max(v) FILTER (i = 2) AS v2, max(v) FILTER (i = n) AS vn,
            max(v) FILTER (i = n - 1) AS vp, max(m) FILTER (i = n) AS mn, max(m) FILTER (i = n - 1) AS mp
          FROM (SELECT *, {q_norm("(i - 0.375) / (n + 0.25)")} AS m FROM (
            SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY v) AS i,
              (count(*) OVER (PARTITION BY {group}))::DOUBLE AS n, avg(v) OVER (PARTITION BY {group}) AS c
            FROM {source} WHERE v IS NOT NULL))
          WHERE n >= 12 GROUP BY {group}, n))))"""


def _kappa(source: str, a: str, b: str) -> str:
    share = "count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY audio_video)"
    return f"""SELECT audio_video, t.n AS subjects, (po - pe) / (1 - pe) AS value,
        (po - pe) / (sqrt(pe + pe * pe - pc) / sqrt(t.n)) AS statistic, {z_p("((po - pe) / (sqrt(pe + pe * pe - pc) / sqrt(t.n)))")} AS p_value FROM
        (SELECT audio_video, count(*) AS n, count(*) FILTER ({a} = {b}) / count(*)::DOUBLE AS po FROM {source} GROUP BY ALL) t
        JOIN (SELECT audio_video, sum(pa * pb) AS pe, sum(pa * pb * (pa + pb)) AS pc FROM
          (SELECT audio_video, {a} AS code, {share} AS pa FROM {source} GROUP BY audio_video, {a})
          JOIN (SELECT audio_video, {b} AS code, {share} AS pb FROM {source} GROUP BY audio_video, {b})
          USING (audio_video, code) GROUP BY audio_video) m USING (audio_video)"""


def number(c: str, digits: int) -> str:
    return (f"coalesce(regexp_replace(regexp_replace(printf('%.{digits}f', round_even(({c})::DOUBLE, {digits})::DOUBLE + 0.0::DOUBLE), "
            f"'(\\.[0-9]*?)0+$', '\\1'), '\\.$', ''), 'NA')")


def _range(c: str, digits: int = 1, sd: int = 1) -> str:
    return (f"{number(f'min({c})', digits)} || '-' || {number(f'max({c})', digits)} || ',' || "
            f"{number(f'avg({c})', digits)} || '(' || {number(f'stddev_samp({c})', sd)} || ')'")


def _describe(medium: str, label: str, last: int) -> str:
    cols = [("numtokens", "numtokens_avg"), ("numtypes", "numtypes_avg"), ("numspeakers", "numspeakers_avg"),
            ("prop_mom", "prop_mom_avg"), ("prop_op", "prop_op_avg"), ("ent_subj_av", "subj_entropy")]
    texts = ", ".join(f"{_range(c)} AS {n}" for c, n in cols)
    return (f"SELECT '{label}' AS recording_type, {texts}, {_range('propn', 1, last)} AS prop_n "
            f"FROM rec06 WHERE audio_video = '{medium}'")


def _sweep(medium: str, pairs) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS pair, {x}::DOUBLE AS x, {y}::DOUBLE AS y FROM merged WHERE audio_video = '{medium}'"
        for name, x, y in pairs)


def q(tables: str, select: str, doubles: str = "") -> str:
    """Query over shared tables; the listed columns are rounded to six places."""
    if not doubles:
        return f"WITH {tables} {select}" if tables else select
    rounded = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in doubles.split())
    head = f"WITH {tables} " if tables else ""
    return f"{head}SELECT * REPLACE ({rounded}) FROM ({select})"


_SS = "cross_item_mean_propt cross_item_mean_proptcorr cross_item_mean_proptpre"
_ST = "cross_item_mean_proptTT cross_item_mean_proptcorrTT cross_item_mean_proptpreTT"
_REC_DOUBLES = ("prop_op prop_op_exp prop_mom prop_dad propd propi propn propq propr props type_token_ratio "
                "exp_type_ratio exp_token_ratio prop_parent prop_tech ent_subj_av sum_prop_ut noun_chi_onset")
TIDY_D = "estimate statistic parameter p_value conf_low conf_high"

AUDIO_PAIRS = [("a", "r", "numtokens"), ("b", "r", "numtypes"), ("f", "r", "type_token_ratio")]
AUDIO_PEARSON = [("c", "numtokens", "numtypes"), ("d", "numtokens", "type_token_ratio"),
                 ("e", "numtypes", "type_token_ratio")]
VIDEO_PAIRS = [("g", "r", "numtokens"), ("h", "r", "numtypes"), ("i", "numtokens", "numtypes"),
               ("j", "numtokens", "type_token_ratio"), ("k", "numtypes", "type_token_ratio"),
               ("l", "r", "type_token_ratio")]
_KPAIRS = f"pairs_k AS ({_sweep('audio', AUDIO_PAIRS)} UNION ALL {_sweep('video', VIDEO_PAIRS)})"
_PPAIRS = f"pairs_p AS ({_sweep('audio', AUDIO_PEARSON)})"
_SWEEP = f"""SELECT pair, estimate, statistic, parameter, p_value, conf_low, conf_high, method FROM ({_kendall("pairs_k", "pair")})
  UNION ALL SELECT pair, estimate, statistic, parameter, p_value, conf_low, conf_high, method FROM ({_pearson("pairs_p", "pair")})"""
_MEASURES = ["numtypes", "numtokens", "type_token_ratio", "r", "numspeakers"]
_MELT = " UNION ALL ".join(
    f"SELECT audio_video, '{m}' AS measure, {m}::DOUBLE AS v FROM merged" for m in _MEASURES)

SQL: dict[str, str] = {
    # ---------------------------------------------------------------- gaze
    "bin_explode": q(_FIX, """SELECT label AS RECORDING_SESSION_LABEL, TrialNumber AS TRIAL_INDEX,
        area AS CURRENT_FIX_INTEREST_AREA_LABEL, count(*) AS n_bins, min(timeBin) AS first_bin, max(timeBin) AS last_bin,
        sum(timeBin * 20)::DOUBLE AS sum_time FROM (SELECT *, unnest(generate_series(ceil(fix_start / 20)::BIGINT,
        ceil(fix_end / 20)::BIGINT - 1)) AS timeBin FROM fix) GROUP BY ALL"""),
    "label_windows": q(_BINS, """SELECT SubjectNumber, subj, month, TrialNumber, trialtype, target, pair, num, gaze,
        prewin, longwin, whichwin, count(*) AS n_bins, sum(propt) AS looks, min(Nonset) AS first_offset,
        max(Nonset) AS last_offset FROM bins GROUP BY ALL"""),
    "low_data_flag": q(_BINS, """SELECT SubjectNumber, TrialNumber, lowdata, count(*) AS n_bins FROM bins GROUP BY ALL"""),
    "low_data_trials": q(_BINS, "SELECT * FROM lowtrials"),
    "kept_trials": q(_BINS, """SELECT DISTINCT SubjectNumber, TrialNumber FROM bins WHERE NOT lowdata
        AND month = '06' AND SubjectNumber IN (SELECT SubjectNumber FROM withdata)"""),
    "semi_in": q(_BINS, "SELECT * FROM pretrials"),
    "window_trials": q(_BINS, "SELECT * FROM wintrials"),
    "trials_setdiff": q(_BINS, "SELECT * FROM nopre"),
    "trials_intersect": q(_BINS, "SELECT * FROM nopre INTERSECT SELECT * FROM lowtrials"),
    "exclusion_totals": q(_BINS, """SELECT 'low_data' AS reason, count(*) AS n FROM lowtrials
        UNION ALL SELECT 'low_data_and_no_baseline', count(*) FROM (SELECT * FROM nopre INTERSECT SELECT * FROM lowtrials)
        UNION ALL SELECT 'no_baseline', count(*) FROM nopre
        UNION ALL SELECT 'ended_early', sum(5 - m)::BIGINT FROM (SELECT max(TrialNumber) AS m FROM bins
          WHERE month = '06' GROUP BY SubjectNumber HAVING max(TrialNumber) < 5)"""),
    "key_press_problems": q(_FIX, """SELECT DISTINCT label AS RECORDING_SESSION_LABEL, TrialNumber AS TRIAL_INDEX, RT,
        audiotarget FROM fix WHERE RT = -1 AND trial NOT IN ('p1', 'p2', 'p3', 'p4') AND audiotarget IS NOT NULL
        AND ceil(fix_start / 20) <= ceil(fix_end / 20) - 1"""),
    "subject_lists": q(_BINS, """SELECT DISTINCT 'all' AS list, SubjectNumber FROM bins WHERE month = '06'
        UNION ALL SELECT 'with_data', SubjectNumber FROM withdata
        UNION ALL SELECT DISTINCT 'lab_only', SubjectNumber FROM bins WHERE month = '06' AND subj LIKE 'ns%'
        UNION ALL SELECT DISTINCT 'enrolled', SubjectNumber FROM bins WHERE month = '06' AND subj NOT LIKE 'ns%'"""),
    "last_trial": q(_BINS, """SELECT SubjectNumber, max(TrialNumber) AS maxtrial, count(DISTINCT TrialNumber) AS numtrials
        FROM bins WHERE month = '06' GROUP BY ALL"""),
    "last_kept_trial": q(_BINS, """SELECT SubjectNumber, max(TrialNumber) AS maxtrial, count(DISTINCT TrialNumber) AS numtrials
        FROM bins WHERE month = '06' AND NOT lowdata GROUP BY ALL"""),
    "stopped_early": q(_BINS, """SELECT SubjectNumber, max(TrialNumber) AS maxtrial, count(DISTINCT TrialNumber) AS numtrials,
        5 - max(TrialNumber) AS missedtrials_endedearly FROM bins WHERE month = '06' GROUP BY ALL HAVING max(TrialNumber) < 5"""),
    "stopped_early_kept": q(_BINS, """SELECT SubjectNumber, max(TrialNumber) AS maxtrial, count(DISTINCT TrialNumber) AS numtrials,
        5 - max(TrialNumber) AS missedtrials_endedearly FROM bins WHERE month = '06' AND NOT lowdata GROUP BY ALL
        HAVING max(TrialNumber) < 5"""),
    "natural_left_join": q(_FIX, """SELECT f.label AS RECORDING_SESSION_LABEL, f.TrialNumber AS TRIAL_INDEX,
        m.TargetOnset AS CURRENT_MSG_TIME, count(*) AS n_fixations FROM fix f LEFT JOIN msg m USING (label, TrialNumber)
        GROUP BY ALL""", "CURRENT_MSG_TIME"),
    "recode_separate": q("", """SELECT p_brand, coalesce(recoded, p_brand) AS recoded, split_part(coalesce(recoded, p_brand), '#', 1) AS make,
        split_part(coalesce(recoded, p_brand), '#', 2) AS number, NULL::VARCHAR AS rest, n FROM (
        SELECT p_brand, CASE WHEN length(p_brand) = 7 THEN 'Brand#0' || substr(p_brand, 7) END AS recoded, count(*) AS n
        FROM part GROUP BY ALL)"""),
    "regex_clean": q(_FIX, """SELECT regexp_replace(target || '.jpg', '.jpg', '', 'g') AS target, count(*) AS n FROM fix GROUP BY ALL"""),
    "prefix_filter": q(_BINS, """SELECT subj, count(DISTINCT TrialNumber) AS numtrials FROM bins WHERE month = '06'
        AND subj LIKE 'ns%' GROUP BY ALL"""),

    # ------------------------------------------------------------- looking
    "two_stage_mean": q(_LOOK, "SELECT * FROM stage2", "propt"),
    "spread_corrected": q(_LOOK, "SELECT * FROM words", "propt_long propt_pre proptcorr"),
    "spread_corrected_by_type": q(_LOOK, "SELECT * FROM wordst", "propt_long propt_pre proptcorr"),
    "missing_report": q(_LOOK, """SELECT month, count(*) AS missing_trials, count(*) FILTER (propt_pre IS NULL) AS missing_predata,
        count(DISTINCT SubjectNumber) AS n_subjects FROM words GROUP BY ALL"""),
    "numtrials_window": q(_LOOK, "SELECT * FROM counted", "propt_long propt_pre proptcorr"),
    "trialtype_report": q(_LOOK, """SELECT month, trialtype, avg(numtrials) AS numtrials, avg(numtrials_TT) AS numtrials_TT,
        avg(proptcorr) AS proptcorr FROM counted GROUP BY ALL""", "numtrials numtrials_TT proptcorr"),
    "subject_means": q(_LOOK, "SELECT * FROM ss WHERE NOT outlier AND month = '06'", _SS),
    "subject_outliers": q(_LOOK, "SELECT * FROM st", _ST),
    "subject_outlier_flags": q(_LOOK, "SELECT * FROM ss", _SS),
    "grand_mean_sd": q(_LOOK, """SELECT month, CASE WHEN count(*) = count(cross_item_mean_proptcorr) THEN avg(cross_item_mean_proptcorr) END
        AS mean_of_means, CASE WHEN count(*) = count(cross_item_mean_proptcorr) THEN stddev_samp(cross_item_mean_proptcorr) END
        AS sd_of_means FROM ss WHERE NOT outlier AND month = '06' GROUP BY ALL""", "mean_of_means sd_of_means"),
    "single_condition_subjects": q(_LOOK, "SELECT * FROM single"),
    "anti_not_in": q(_LOOK, "SELECT subj, trialtype, cross_item_mean_proptcorrTT FROM tested", "cross_item_mean_proptcorrTT"),
    "item_means": q(_LOOK, "SELECT * FROM items WHERE NOT outlier AND month = '06'", _ST),
    "item_outliers": q(_LOOK, "SELECT * FROM items", _ST),
    "reorder_by_mean": q(_LOOK, """SELECT target, mean_value, row_number() OVER (ORDER BY mean_value DESC, target) AS position FROM (
        SELECT target, avg(cross_item_mean_proptcorrTT) AS mean_value FROM items WHERE NOT outlier AND month = '06' GROUP BY ALL)""",
        "mean_value"),
    "points_by_type": q(_LOOK, """SELECT subj, month, trialtype, CASE trialtype WHEN 'between' THEN 'unrelated' ELSE 'related' END AS label,
        cross_item_mean_proptcorrTT FROM tested""", "cross_item_mean_proptcorrTT"),

    # ---------------------------------------------------------------- home
    "right_join_onset": q(_ANN, """SELECT subj, month, noun_chi_onset, count(*) AS n FROM ann LEFT JOIN onset USING (subj) GROUP BY ALL"""),
    "noun_onset": q(_ANN, "SELECT * FROM onset"),
    "tested_word_counts": q(_ANN, f"""SELECT subj, month, audio_video, count(*) AS num_exp_tokens, count(DISTINCT basic_level) AS num_exp_types
        FROM ann WHERE basic_level IN {_TESTED} GROUP BY ALL"""),
    "speaker_spread": q(_ANN, """SELECT subj, month, audio_video, nullif(count(*) FILTER (speaker = 'MOT'), 0) AS "MOT",
        nullif(count(*) FILTER (speaker = 'FAT'), 0) AS "FAT" FROM ann WHERE speaker IN ('MOT', 'FAT') GROUP BY ALL"""),
    "utterance_spread": q(_ANN, "SELECT subj, month, audio_video, " + ", ".join(
        f"nullif(count(*) FILTER (utterance_type = '{u}'), 0) AS \"{u}\"" for u in "diqrsn")
        + " FROM ann WHERE utterance_type <> 'u' GROUP BY ALL"),
    "device_count": q(_ANN, "SELECT subj, month, audio_video, " + ", ".join(
        f"nullif(count(*) FILTER (speaker = '{u}'), 0) AS \"{u}\"" for u in ["TOY", "TVN", "TVF", "TVM", "TVS", "TVB"])
        + " FROM ann WHERE speaker IN ('TOY', 'TVN', 'TVF', 'TVM', 'TVS', 'TVB') GROUP BY ALL"),
    "presence_prop": q(_ANN, """SELECT *, y_op / (n_op + y_op)::DOUBLE AS prop_op FROM (SELECT subj, month, audio_video,
        nullif(count(*) FILTER (object_present = 'n'), 0) AS n_op, nullif(count(*) FILTER (object_present = 'y'), 0) AS y_op
        FROM ann GROUP BY ALL)""", "prop_op"),
    "presence_prop_tested": q(_ANN, f"""SELECT *, y_op_exp / (n_op_exp + y_op_exp)::DOUBLE AS prop_op_exp FROM (SELECT subj, month, audio_video,
        nullif(count(*) FILTER (object_present = 'n'), 0) AS n_op_exp, nullif(count(*) FILTER (object_present = 'y'), 0) AS y_op_exp
        FROM ann WHERE basic_level IN {_TESTED} GROUP BY ALL)""", "prop_op_exp"),
    "child_counts": q(_ANN, """SELECT subj, month, audio_video, count(*) AS "CHI" FROM ann WHERE speaker = 'CHI' GROUP BY ALL"""),
    "child_types": q(_ANN, """SELECT subj, month, audio_video, count(DISTINCT basic_level) AS CHItypes FROM ann WHERE speaker = 'CHI' GROUP BY ALL"""),
    "recording_agg": q(_HOME, """SELECT * EXCLUDE (spoken, "TVN", "TVF", "TVM", "TVS", "TVB") FROM rec""", _REC_DOUBLES),
    "entropy_ut": q(_HOME, "SELECT subj, month, audio_video, ent_subj_av, sum_prop_ut FROM rec", "ent_subj_av sum_prop_ut"),
    "posttalk": q(_HOME, "SELECT subj, month, audio_video, noun_chi_onset, posttalk FROM rec"),
    "fill_na_zero": q(_ANN, """SELECT subj, month, audio_video, count(*) FILTER (speaker = 'MOT') AS "MOT",
        count(*) FILTER (speaker = 'FAT') AS "FAT" FROM ann WHERE speaker IN ('MOT', 'FAT') GROUP BY ALL"""),
    "length_check": q(_BINS + "," + _ANN, """SELECT 'odd_speaker_code' AS problem, count(*) AS n FROM ann WHERE length(speaker) <> 3
        UNION ALL SELECT 'missing_utterance_type', count(*) FROM ann WHERE utterance_type IS NULL
        UNION ALL SELECT 'label_conflict', count(*) FROM (SELECT 1 FROM ann GROUP BY subj, month HAVING count(DISTINCT SubjectNumber) > 1)
        UNION ALL SELECT 'trial_conflict', count(*) FROM (SELECT 1 FROM bins GROUP BY SubjectNumber, TrialNumber
          HAVING count(DISTINCT (target, trialtype, pair)) > 1)"""),
    "words_starting_with": q(_ANN, "SELECT DISTINCT basic_level FROM ann WHERE basic_level LIKE 'B%'"),
    "ut_share": q(_ANN, """SELECT *, n / sum(n) OVER (PARTITION BY subj, audio_video) AS share FROM (SELECT subj, audio_video,
        utterance_type, count(*) AS n FROM ann WHERE utterance_type <> 'u' GROUP BY ALL)""", "share"),
    "order_by_first": q(_HOME, """SELECT subj, round(f, 6) + 0.0 AS first_value, row_number() OVER (ORDER BY f, subj) AS position
        FROM (SELECT subj, min(propd + propq) AS f FROM rec GROUP BY subj)"""),
    "describe_range": q(_HOME, _describe("video", "vid", 1)),
    "union_descriptives": q(_HOME, _describe("audio", "aud", 2) + " UNION ALL " + _describe("video", "vid", 1)),
    "measures_by_medium": q(_HOME, "SELECT audio_video, " + ", ".join(
        f"{f}({m})::DOUBLE AS {m}_{n}" for m in ["numtokens", "prop_mom", "prop_op"]
        for n, f in [("min", "min"), ("max", "max"), ("mean", "avg"), ("sd", "stddev_samp")]) + " FROM rec06 GROUP BY ALL",
        " ".join(f"{m}_{n}" for m in ["numtokens", "prop_mom", "prop_op"] for n in ["min", "max", "mean", "sd"])),
    "null_summary": q(_LOOK, " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS n, count(*) FILTER ({c} IS NULL) AS missing, min({c})::DOUBLE AS min,
        quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.5) AS median, avg({c}) AS mean,
        quantile_cont({c}::DOUBLE, 0.75) AS q3, max({c})::DOUBLE AS max FROM words""" for c in ["propt_long", "propt_pre", "proptcorr"]), "min q1 median mean q3 max"),
    "level_counts": q(_ANN, " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {c} AS level, count(*) AS n FROM ann GROUP BY {c}"""
        for c in ["speaker", "utterance_type", "object_present", "audio_video"])),
    "table_size": q(_BINS, "SELECT count(*) AS n_rows, 28::INTEGER AS n_columns FROM bins"),

    # --------------------------------------------------------------- merged
    "lab_home_merge": q(_MERGED, """SELECT subj, month, SubjectNumber, audio_video, numtokens, prop_op, numtrials, "between", "within",
        cross_item_mean_proptcorr, cross_item_mean_proptpre, cross_item_mean_propt FROM merged""",
        f'prop_op "between" "within" {_SS}'),
    "pooled_props": q(_MERGED, "SELECT * FROM pooled",
                      'prop_op_avg prop_mom_avg ent_subj_avg prop_n_avg cross_item_mean_proptcorr "between" "within"'),
    "positional_pair_join": q(_MERGED, """SELECT a.subj, a.SubjectNumber, a.prop_op AS aprop_op, v.prop_op AS vprop_op
        FROM merged a JOIN merged v ON a.subj = v.subj AND a.audio_video = 'audio' AND v.audio_video = 'video'""", "aprop_op vprop_op"),

    # ------------------------------------------------------------ statistics
    "ttest_one": q(_LOOK, _t_test("tested", "cross_item_mean_proptcorrTT", "trialtype"), TIDY_D),
    "ttest_overall": q(_LOOK, _t_test("""(SELECT * FROM ss WHERE NOT outlier AND month = '06' AND subj NOT LIKE 'ns%'
        AND subj NOT IN (SELECT subj FROM single06))""", "cross_item_mean_proptcorr"), TIDY_D),
    "ttest_paired": q(_LOOK, _t_test("""(SELECT max(cross_item_mean_proptcorrTT) FILTER (trialtype = 'between')
        - max(cross_item_mean_proptcorrTT) FILTER (trialtype = 'within') AS d FROM tested GROUP BY subj)""", "d", method="Paired t-test"), TIDY_D),
    "ttest_welch": q("", _welch("lineitem", "l_discount", "l_returnflag", "A", "R"), TIDY_D + " estimate1 estimate2"),
    "ttest_welch_items": q(_LOOK, _welch("(SELECT * FROM items WHERE NOT outlier AND month = '06')",
        "cross_item_mean_proptcorrTT", "trialtype", "between", "within"), TIDY_D + " estimate1 estimate2"),
    "ttest_balance": q("", _t_test("customer", "c_acctbal", "c_mktsegment"), TIDY_D),
    "binom_exact": q(_LOOK, """SELECT trialtype, numpos, n_all, numpos || '/' || n_all AS proppos, mean, sd,
        least(1.0, list_sum(list_transform(generate_series(0, n_all), lambda k: CASE WHEN
          exp(lgamma(n_all + 1) - lgamma(k + 1) - lgamma(n_all - k + 1) - n_all * ln(2)) <=
          exp(lgamma(n_all + 1) - lgamma(numpos + 1) - lgamma(n_all - numpos + 1) - n_all * ln(2)) * (1 + 1e-7)
          THEN exp(lgamma(n_all + 1) - lgamma(k + 1) - lgamma(n_all - k + 1) - n_all * ln(2)) ELSE 0.0 END))) AS p_value FROM (
        SELECT trialtype, count(*) FILTER (cross_item_mean_proptcorrTT > 0) AS numpos, count(*) AS n_all,
          avg(cross_item_mean_proptcorrTT) AS mean, stddev_samp(cross_item_mean_proptcorrTT) AS sd FROM tested GROUP BY ALL)""",
        "mean sd p_value"),
    "mean_ci": q("", f"""SELECT * EXCLUDE (t0, df, t), mean - t * sd / sqrt(n) AS conf_low, mean + t * sd / sqrt(n) AS conf_high FROM (
        SELECT *, t0 + ({t_p("t0", "df")} - 0.05) / 2 / (exp(lgamma((df + 1) / 2) - lgamma(df / 2))
          / sqrt(df * pi()) * pow(1 + t0 * t0 / df, -(df + 1) / 2)) AS t FROM (
        SELECT *, {t_q975("df")} AS t0 FROM (
        SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS sd,
          (count(*) - 1)::DOUBLE AS df FROM customer GROUP BY ALL)))""",
        "mean sd conf_low conf_high"),
    "cor_pearson": q(_CUST, _pearson("cust"), TIDY_D),
    "cor_spearman": q(_CUST, _pearson("""(SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS x,
        rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS y FROM cust)""", rank=True), TIDY_D),
    "cor_spearman_trials": q(_LOOK, _pearson("""(SELECT rank() OVER (ORDER BY numtrials) + (count(*) OVER (PARTITION BY numtrials) - 1) / 2.0 AS x,
        rank() OVER (ORDER BY cross_item_mean_proptcorrTT) + (count(*) OVER (PARTITION BY cross_item_mean_proptcorrTT) - 1) / 2.0 AS y
        FROM st WHERE NOT outlier)""", rank=True), TIDY_D),
    "cor_kendall": q(_CUST, _kendall("cust"), TIDY_D),
    "cor_sweep": q(f"{_MERGED}, {_KPAIRS}, {_PPAIRS}", _SWEEP, TIDY_D),
    "cor_sweep_range": q(f"{_MERGED}, {_KPAIRS}, {_PPAIRS}", f"""SELECT round_even(min(abs(estimate)), 2)::DOUBLE AS roundmincor,
        round_even(max(abs(estimate)), 2)::DOUBLE AS roundmaxcor, CASE WHEN max(p_value) < 0.05 THEN 'ps<.05' ELSE 'fix' END AS all_p
        FROM ({_SWEEP})"""),
    "cor_lab_home": q(_MERGED, f"""SELECT 'aud_numtypes' AS pair, * FROM ({_pearson(
        "(SELECT cross_item_mean_proptcorr AS x, numtypes AS y FROM merged WHERE audio_video = 'audio')")})
        UNION ALL SELECT 'prop_op', * FROM ({_pearson("(SELECT cross_item_mean_proptcorr AS x, prop_op_avg AS y FROM pooled)")})
        UNION ALL SELECT 'entropy', * FROM ({_pearson("(SELECT cross_item_mean_proptcorr AS x, ent_subj_avg AS y FROM pooled)")})
        UNION ALL SELECT 'av_prop_op', * FROM ({_pearson('''(SELECT a.prop_op AS x, v.prop_op AS y FROM merged a JOIN merged v
          ON a.subj = v.subj AND a.audio_video = 'audio' AND v.audio_video = 'video')''')})""", TIDY_D),
    "shapiro_wilk": q(f"{_MERGED}, melted AS ({_MELT})", _shapiro("melted", "audio_video, measure"), TIDY_D),
    "shapiro_choose_method": q(f"{_MERGED}, melted AS ({_MELT})", f"""SELECT audio_video, CASE WHEN min(p_value) >= 0.05 THEN 'pearson'
        ELSE 'kendall' END AS method FROM ({_shapiro("melted", "audio_video, measure")})
        WHERE measure IN ('numtypes', 'numtokens') GROUP BY ALL"""),
    "kappa": q(_CODERS, _kappa("coders", "orig_utt_type", "new_utt_type"), "value statistic p_value"),
    "kappa_presence": q(_CODERS, _kappa("coders", "orig_present", "new_present"), "value statistic p_value"),
    "kappa_labels": q("coders AS (SELECT quality AS a, 1 - toxic AS b, 'labels' AS audio_video FROM labels)",
                      _kappa("coders", "a", "b"), "value statistic p_value"),
    "agreement": q(_CODERS, """SELECT audio_video, count(*) AS subjects, 100.0 * count(*) FILTER (orig_utt_type = new_utt_type) / count(*) AS value
        FROM coders GROUP BY ALL""", "value"),
    "mean_agreement": q(_CODERS, """SELECT round_even(avg(value), 0)::DOUBLE AS value FROM (SELECT audio_video,
        100.0 * count(*) FILTER (orig_present = new_present) / count(*) AS value FROM coders GROUP BY ALL)"""),
    "agreement_flags": q(_CODERS, """SELECT orig_utt_type = new_utt_type AS utrel, orig_present = new_present AS oprel, count(*) AS n
        FROM coders GROUP BY ALL"""),
    "exclusion_rerun": q(_LOOK + """,
        listed AS (SELECT DISTINCT (c_custkey // 10)::VARCHAR AS subj FROM customer WHERE c_acctbal < 0),
        rest AS (SELECT * FROM counted WHERE NOT (target = 'milk' AND subj IN (SELECT subj FROM listed))),
        rst AS (SELECT *, abs(s - avg(s) OVER (PARTITION BY month)) > 3 * stddev_samp(s) OVER (PARTITION BY month) AS outlier FROM (
          SELECT subj, month, trialtype, numtrials, numtrials_TT, avg(proptcorr) AS s FROM rest GROUP BY ALL)),
        r06 AS (SELECT * FROM rst WHERE NOT outlier AND month = '06'),
        rok AS (SELECT * FROM r06 WHERE subj IN (SELECT subj FROM r06 GROUP BY subj HAVING count(*) = 2))""",
        _t_test("rok", "s", "trialtype"), TIDY_D),
    "result_lines": q(_LOOK, f"""SELECT name, estimate, statistic, parameter, p_value, conf_low, conf_high, method, 'estimate=' || {number("estimate", 3)} || ', statistic=' || {number("statistic", 2)}
        || ', df=' || {number("parameter", 2)} || ', p=' || {number("p_value", 3)} AS text FROM (
        SELECT CASE trialtype WHEN 'between' THEN 'unrelated' ELSE 'related' END AS name, estimate, statistic, parameter, p_value, conf_low, conf_high, method
        FROM ({_t_test("tested", "cross_item_mean_proptcorrTT", "trialtype")}))""", TIDY_D),
}

_OUTCOME = {
    "pearson": {"aud_numtypes": ("audio", "numtypes"), "aud_numtokens": ("audio", "numtokens"), "aud_ratio": ("audio", "type_token_ratio"),
                "vid_numtypes": ("video", "numtypes"), "vid_ratio": ("video", "type_token_ratio"), "vid_read": ("video", "r"),
                "prop_op": ("", "prop_op_avg"), "entropy": ("", "ent_subj_avg"), "prop_n": ("", "prop_n_avg")},
    "kendall": {"aud_read": ("audio", "r"), "aud_speakers": ("audio", "numspeakers"), "vid_numtokens": ("video", "numtokens"),
                "vid_speakers": ("video", "numspeakers"), "prop_mom": ("", "prop_mom_avg")},
}


def _outcome(method: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS pair, cross_item_mean_proptcorr::DOUBLE AS x, {c}::DOUBLE AS y FROM "
        + (f"merged WHERE audio_video = '{medium}'" if medium else "pooled") for name, (medium, c) in _OUTCOME[method].items())


SQL["cor_outcome"] = q(f"""{_MERGED}, po AS ({_outcome("pearson")} UNION ALL SELECT 'av_prop_op', a.prop_op, v.prop_op FROM merged a JOIN merged v
    ON a.subj = v.subj AND a.audio_video = 'audio' AND v.audio_video = 'video'), ko AS ({_outcome("kendall")})""",
    f"""SELECT pair, estimate, statistic, parameter, p_value, conf_low, conf_high, method FROM ({_kendall("ko", "pair")})
    UNION ALL SELECT pair, estimate, statistic, parameter, p_value, conf_low, conf_high, method FROM ({_pearson("po", "pair")})""", TIDY_D)
_SCORE = "cross_item_mean_proptcorr"
SQL["outcome_normality"] = q(f"""{_MERGED}, parts AS (SELECT 'subjects' AS part, {_SCORE}::DOUBLE AS v FROM ss WHERE NOT outlier AND month = '06'
    UNION ALL SELECT audio_video, {_SCORE} FROM merged WHERE audio_video IN ('audio', 'video') UNION ALL """ + " UNION ALL ".join(
    f"SELECT 'pooled {c}', {c} FROM pooled" for c in (_SCORE, "prop_op_avg", "prop_mom_avg", "ent_subj_avg")) + ")", _shapiro("parts", "part"), TIDY_D)
_ITEMS = "(SELECT * FROM items WHERE NOT outlier AND month = '06')"
SQL["ttest_items"] = q(_LOOK, _t_test(_ITEMS, "cross_item_mean_proptcorrTT", "trialtype"), TIDY_D)
SQL["positive_items"] = SQL["binom_exact"].replace("FROM tested GROUP BY ALL", f"FROM {_ITEMS} GROUP BY ALL")
SQL["mean_agreement_type"] = q(_CODERS, """SELECT round_even(avg(value), 0)::DOUBLE AS value FROM (SELECT audio_video,
    100.0 * count(*) FILTER (orig_utt_type = new_utt_type) / count(*) AS value FROM coders GROUP BY ALL)""", "value")
for _name, _codes in {"type": ("orig_utt_type", "new_utt_type"), "presence": ("orig_present", "new_present")}.items():
    SQL[f"mean_kappa_{_name}"] = q(_CODERS, f"SELECT round_even(avg(value), 1)::DOUBLE AS value FROM ({_kappa('coders', *_codes)})", "value")
SQL["ordered_utterance_shares"] = q(_HOME, """SELECT u.*, o.position FROM (SELECT *, n / sum(n) OVER (PARTITION BY subj, audio_video) AS share
    FROM (SELECT subj, audio_video, utterance_type, count(*) AS n FROM ann WHERE utterance_type <> 'u' GROUP BY ALL)) u
    LEFT JOIN (SELECT subj, row_number() OVER (ORDER BY f, subj) AS position FROM (
      SELECT subj, min(propd + propq) AS f FROM rec GROUP BY subj)) o USING (subj)""", "share")
SQL["outlier_rows"] = q("", """SELECT p_partkey, p_brand, p_retailprice, true AS outlier FROM (SELECT *,
    abs(p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_brand)) > 1.5 * stddev_samp(p_retailprice) OVER (PARTITION BY p_brand)
    AS far FROM part) WHERE far""", "p_retailprice")
SQL["positive_text"] = f"""SELECT trialtype, proppos, 'M=' || {number("mean", 3)} || ', SD=' || {number("sd", 3)} || ', p = '
    || {number("p_value", 3)} AS text FROM ({SQL["binom_exact"]}) WHERE sd IS NOT NULL"""
