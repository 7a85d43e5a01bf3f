"""Distribution functions as Spark SQL expressions.

They are meant for aggregated rows (one per test), stay on the JVM and need no UDF.
Arguments are SQL text (a column name or an expression over columns). A function with
many terms is one text handed to the parser at once, which is far quicker to build than
the same tree of Column calls. The number of continued-fraction terms follows the size
of the parameters, so one expression serves a test over 10 rows and one over a billion.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, functions as F

# Lanczos approximation (g = 7, n = 9); fixed values.
LANCZOS_G = 7.0
LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028,
    771.32342877765313, -176.61502916214059, 12.507343278686905,
    -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
]

# Wichura's AS 241 rational approximations of the normal quantile (PPND16); fixed values,
# ascending powers: numerator and denominator for the centre, the shoulder and the tail.
NORMAL_CENTRE = (
    [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
     1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
     3.3430575583588128105e4, 2.5090809287301226727e3],
    [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
     5.2264952788528545610e3],
)
NORMAL_SHOULDER = (
    [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
     3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
     2.27238449892691845833e-2, 7.74545014278341407640e-4],
    [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
     1.05075007164441684324e-9],
)
NORMAL_TAIL = (
    [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
     2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
     2.71155556874348757815e-5, 2.01033439929228813265e-7],
    [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
     2.04426310338993978564e-15],
)

LOG_SQRT_2PI = 0.5 * math.log(2 * math.pi)


def num(value: float) -> str:
    """A double literal."""
    return f"({float(value)!r}D)"


def let(names: dict[str, str], body: str, var: str) -> str:
    """Evaluate the values once and use them in ``body`` as ``var.name``."""
    fields = ", ".join(f"'{k}', CAST({v} AS DOUBLE)" for k, v in names.items())
    return f"(transform(array(named_struct({fields})), {var} -> {body})[0])"


def polynomial(x: str, coefficients) -> str:
    """Horner scheme, coefficients in ascending powers."""
    out = num(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {num(c)})"
    return out


# ------------------------------------------------------------ gamma and beta

def _stirling_rest(x: str) -> str:
    """log gamma(x) minus its leading Stirling terms, for x >= 10."""
    series = polynomial(f"(1 / ({x} * {x}))", [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188])
    return f"({series} / {x})"


def log_gamma_sql(x: str) -> str:
    """log gamma(x) for x > 0."""
    v = "lg.x"
    total = " + ".join([num(LANCZOS[0]), *[
        f"{num(c)} / ({v} + {num(k - 1)})" for k, c in enumerate(LANCZOS[1:], start=1)]])
    t = f"({v} + {num(LANCZOS_G - 0.5)})"
    small = f"({num(LOG_SQRT_2PI)} + ({v} - 0.5D) * ln({t}) - {t} + ln({total}))"
    large = f"(({v} - 0.5D) * ln({v}) - {v} + {num(LOG_SQRT_2PI)} + {_stirling_rest(v)})"
    return let({"x": x}, f"CASE WHEN {v} >= 10 THEN {large} WHEN {v} > 0 THEN {small} END", "lg")


def log_beta_sql(a: str, b: str) -> str:
    """log B(a, b) without cancellation for large arguments."""
    p, q, pq = "lb.p", "lb.q", "(lb.p + lb.q)"
    both = (f"(-0.5D * ln({q}) + {num(LOG_SQRT_2PI)} + {_stirling_rest(p)} + {_stirling_rest(q)} "
            f"- {_stirling_rest(pq)} + ({p} - 0.5D) * ln({p} / {pq}) + {q} * log1p(-{p} / {pq}))")
    one = (f"({log_gamma_sql(p)} + {_stirling_rest(q)} - {_stirling_rest(pq)} + {p} - {p} * ln({pq}) "
           f"+ ({q} - 0.5D) * log1p(-{p} / {pq}))")
    none = f"({log_gamma_sql(p)} + {log_gamma_sql(q)} - {log_gamma_sql(pq)})"
    return let({"p": f"least({a}, {b})", "q": f"greatest({a}, {b})"},
               f"CASE WHEN {p} >= 10 THEN {both} WHEN {q} >= 10 THEN {one} ELSE {none} END", "lb")


def _beta_fraction(a: str, b: str, x: str) -> str:
    """Continued fraction of the incomplete beta integral, evaluated from its far end."""
    terms = f"(2 * CAST(60 + 6 * sqrt(greatest({a}, {b})) AS INT))"
    m = "floor(k / 2)"
    even = f"{m} * ({b} - {m}) * {x} / (({a} + 2 * {m} - 1) * ({a} + 2 * {m}))"
    odd = f"-({a} + {m}) * ({a} + {b} + {m}) * {x} / (({a} + 2 * {m}) * ({a} + 2 * {m} + 1))"
    return (f"(1 / (1 + aggregate(sequence({terms}, 1, -1), 0D, (acc, k) -> "
            f"CASE WHEN k % 2 = 0 THEN {even} ELSE {odd} END / (1 + acc))))")


def beta_cdf_sql(a: str, b: str, x: str, log_x: str | None = None, log_1mx: str | None = None) -> str:
    """Regularised incomplete beta function I_x(a, b).

    ``log_x`` and ``log_1mx`` may be given where they are known more precisely than
    from ``x`` itself.
    """
    front = "exp(bc.a * bc.lx + bc.b * bc.l1 - bc.lb)"
    direct = f"{front} / bc.a * {_beta_fraction('bc.a', 'bc.b', 'bc.x')}"
    mirrored = f"1 - {front} / bc.b * {_beta_fraction('bc.b', 'bc.a', '(1 - bc.x)')}"
    body = (f"CASE WHEN bc.x <= 0 THEN 0D WHEN bc.x >= 1 THEN 1D "
            f"WHEN bc.x <= (bc.a + 1) / (bc.a + bc.b + 2) THEN {direct} ELSE {mirrored} END")
    return let({"a": a, "b": b, "x": x, "lx": log_x or f"ln({x})", "l1": log_1mx or f"log1p(-({x}))",
                "lb": log_beta_sql(a, b)}, body, "bc")


# ------------------------------------------------------------------- normal

def normal_upper_sql(z: str) -> str:
    """P(Z > z): a series around zero, a continued fraction in the tails."""
    density = f"(exp(-0.5D * nu.a * nu.a) * {num(1 / math.sqrt(2 * math.pi))})"
    # sum of a^(2k+1) / (1*3*..*(2k+1)), nested from the far end
    nested = "aggregate(sequence(60, 1, -1), 1D, (acc, k) -> 1 + acc * nu.a * nu.a / (2D * k + 1))"
    far = "aggregate(sequence(120, 1, -1), nu.a, (acc, k) -> nu.a + k / acc)"
    tail = f"CASE WHEN nu.a < 3 THEN 0.5D - {density} * nu.a * {nested} ELSE {density} / {far} END"
    return let({"a": f"abs({z})", "z": z}, f"CASE WHEN nu.z >= 0 THEN {tail} ELSE 1 - {tail} END", "nu")


def normal_upper(z: str) -> Column:
    return F.expr(normal_upper_sql(z))


def normal_cdf(z: str) -> Column:
    return F.expr(normal_upper_sql(f"-({z})"))


def normal_two_sided(z: str) -> Column:
    return F.expr(f"2 * {normal_upper_sql(f'abs({z})')}")


def normal_quantile_sql(p: str) -> str:
    """Inverse of the normal distribution function, 0 < p < 1."""
    def part(x: str, pair) -> str:
        return f"{polynomial(x, pair[0])} / {polynomial(x, pair[1])}"

    centre = f"nq.q * {part('(0.180625D - nq.q * nq.q)', NORMAL_CENTRE)}"
    outer = (f"signum(nq.q) * CASE WHEN nq.r <= 5 THEN {part('(nq.r - 1.6D)', NORMAL_SHOULDER)} "
             f"ELSE {part('(nq.r - 5D)', NORMAL_TAIL)} END")
    return let({"q": f"({p}) - 0.5D", "r": f"sqrt(-ln(least({p}, 1D - ({p}))))"},
               f"CASE WHEN abs(nq.q) >= 0.5D THEN NULL WHEN abs(nq.q) <= 0.425D THEN {centre} ELSE {outer} END",
               "nq")


def normal_quantile(p: str) -> Column:
    return F.expr(normal_quantile_sql(p))


# ---------------------------------------------------------------- Student t

def t_two_sided_sql(t: str, df: str) -> str:
    cdf = beta_cdf_sql("ts.n / 2", "0.5D", "1 / (1 + ts.r)", "-log1p(ts.r)", "ln(ts.r) - log1p(ts.r)")
    inner = let({"n": df, "r": f"({t}) * ({t}) / ({df})"},
                f"CASE WHEN ts.r = 0 THEN 1D ELSE {cdf} END", "ts")
    return f"CASE WHEN ({df}) > 0 THEN {inner} END"


def t_two_sided(t: str, df: str) -> Column:
    """P(|T| > |t|) with ``df`` degrees of freedom."""
    return F.expr(t_two_sided_sql(t, df))


def t_quantile(p: float, df: str) -> Column:
    """Upper quantile (0.5 < p < 1) of Student's t.

    Newton steps from the normal quantile: the distribution function is concave right of
    zero, so the steps approach the quantile from below and never overshoot. For many
    degrees of freedom an expansion around the normal quantile is exact to rounding.
    """
    z = NormalDist().inv_cdf(p)
    density = "exp(-0.5D * (tq.n + 1) * log1p(t * t / tq.n) - tq.c)"
    step = f"t + 0.5D * ({t_two_sided_sql('t', 'tq.n')} - {num(2 * (1 - p))}) / {density}"
    few = let({"n": df, "c": f"{log_beta_sql(f'({df}) / 2', '0.5D')} + 0.5D * ln({df})"},
              f"aggregate(sequence(1, 20), {num(z)}, (t, i) -> {step})", "tq")
    terms = [z, (z ** 3 + z) / 4, (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96,
             (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384]
    many = polynomial(f"(1D / ({df}))", terms)
    return F.expr(f"CASE WHEN ({df}) > 2000 THEN {many} WHEN ({df}) > 0 THEN {few} END")


# ------------------------------------------------------------------ binomial

def binomial_two_sided(k: str, n: str) -> Column:
    """Exact two-sided binomial test against p = 1/2.

    With p = 1/2 the distribution is symmetric, so the outcomes no more likely than ``k``
    are the two tails cut at min(k, n-k): twice one tail, which is an incomplete beta value.
    """
    tail = beta_cdf_sql("bi.n - bi.m", "bi.m + 1", "0.5D")
    body = f"CASE WHEN 2 * bi.m >= bi.n THEN 1D ELSE least(1D, 2 * {tail}) END"
    return F.expr(f"CASE WHEN ({n}) > 0 THEN {let({'n': n, 'm': f'least({k}, ({n}) - ({k}))'}, body, 'bi')} END")


# ------------------------------------------------------- Kendall's exact law

def kendall_exact_p(concordant: str, n: str) -> Column:
    """Two-sided p of the number of concordant among ``n`` untied pairs (n small).

    Builds the law of the number of inversions one element at a time; the i-th element
    adds 0..i-1 inversions with equal chance.
    """
    low = "greatest(k - i + 1, 0)"
    window = f"slice(law, {low} + 1, least(k, size(law) - 1) - {low} + 1)"
    add = (f"transform(sequence(0, size(law) + i - 2), "
           f"k -> aggregate({window}, 0D, (s, v) -> s + v) / i)")
    law = f"aggregate(sequence(1, CAST({n} AS INT)), array(1D), (law, i) -> {add})"

    def upto(q: str) -> str:
        return f"CASE WHEN {q} < 0 THEN 0D ELSE aggregate(slice(ke.law, 1, {q} + 1), 0D, (s, v) -> s + v) END"

    return F.expr(
        f"(transform(array(named_struct('law', {law}, 'q', CAST(round({concordant}) AS INT))), "
        f"ke -> least(1D, 2 * least({upto('ke.q')}, 1 - {upto('(ke.q - 1)')})))[0])")


# ------------------------------------------------------ Spearman's exact law

ENUMERATED, SERIES_BELOW = 9, 1290
# Best and Roberts' AS 89 coefficients of the Edgeworth series; fixed values.
EDGEWORTH = [0.2274, 0.2531, 0.1745, 0.0758, 0.1033, 0.3932, 0.0879, 0.0151, 0.0072, 0.0831, 0.0131, 4.6e-4]


def squared_rank_law(n: int) -> list[float]:
    """P(S <= 2 k) for k = 0, 1, ...: S is the sum of squared rank differences of a random order of n.

    Ranks are given away one after the other; orders that have used the same ranks and reached
    the same sum are counted together.
    """
    counts = {(0, 0): 1}
    for i in range(n):
        after: dict[tuple[int, int], int] = {}
        for (used, s), c in counts.items():
            for j in range(n):
                if not used >> j & 1:
                    key = used | 1 << j, s + (i - j) ** 2
                    after[key] = after.get(key, 0) + c
        counts = after
    by_sum = {s: c for (_, s), c in counts.items()}
    total, so_far, law = math.factorial(n), 0, []
    for s in range(0, (n ** 3 - n) // 3 + 1, 2):
        so_far += by_sum.get(s, 0)
        law.append(so_far / total)
    return law


def spearman_exact_p(squares: str, n: str) -> Column:
    """Two-sided p of a sum of squared rank differences of ``n`` untied pairs, n below ``SERIES_BELOW``.

    Up to ``ENUMERATED`` pairs all orders are counted, beyond an Edgeworth series with a correction
    for the steps of two is used. The law is symmetric, so the lower tail serves both sides.
    """
    laws = ", ".join("array(" + ", ".join(num(p) for p in squared_rank_law(m)) + ")" for m in range(2, ENUMERATED + 1))
    c = EDGEWORTH
    y, b = "sp.x * sp.x", "sp.b"
    inner = f"({num(c[6])} + {num(c[7])} * {b} - {y} * ({num(c[8])} - {num(c[9])} * {b} + {y} * {b} * ({num(c[10])} - {num(c[11])} * {y})))"
    odd = f"({num(c[0])} + {b} * ({num(c[1])} + {num(c[2])} * {b}) + {y} * (-{num(c[3])} + {b} * ({num(c[4])} + {num(c[5])} * {b}) - {y} * {b} * {inner}))"
    lower = f"({normal_upper_sql('(-sp.x)')}) - sp.x * {b} * {odd} / exp({y} / 2)"
    series = let({"b": "1 / sl.n", "x": "(6 * (sl.d + 1) / (sl.n * (sl.n * sl.n - 1)) - 1) * sqrt(sl.n - 1)"}, lower, "sp")
    tail = f"CASE WHEN sl.n <= {ENUMERATED} THEN element_at(element_at(array({laws}), CAST(sl.n AS INT) - 1), CAST(sl.d / 2 AS INT) + 1) ELSE {series} END"
    whole = f"(CAST({n} AS DOUBLE) * (CAST({n} AS DOUBLE) * CAST({n} AS DOUBLE) - 1) / 3)"
    found = let({"n": f"CAST({n} AS DOUBLE)", "d": f"least(2 * round(({squares}) / 2), {whole} - 2 * round(({squares}) / 2))"},
                f"greatest(0D, least(1D, 2 * ({tail})))", "sl")
    return F.expr(f"CASE WHEN ({n}) BETWEEN 2 AND {SERIES_BELOW - 1} THEN {found} END")
