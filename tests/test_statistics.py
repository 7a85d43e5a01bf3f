import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigaze.functions import special as S
from lexigaze.operators import agreement, correlation, hypothesis, normality, ranks, report, resample, robust, smooth

# fixed values: similarity of the word pairs, related then unrelated
RELATED = [0.55069966145371874, 0.43117714030997534, 0.7109627977088071, 0.69362326696385701,
           0.29073856030497403, 0.52490226748063895, 0.47165861800515274, 0.048514650707260847]
UNRELATED = [0.017896816560221504, 0.221154754802494, -0.084157055534362715, 0.29024004450549301,
             0.16472713773679337, 0.29865475501722305, 0.32651667681896479, 0.19941315916092889]
# fixed values: video recordings coded twice, (first code, second code): words
UTTERANCE_CODES = {("d", "d"): 283, ("d", "i"): 5, ("d", "n"): 13, ("d", "q"): 8, ("i", "d"): 2, ("i", "i"): 50,
                   ("n", "d"): 8, ("n", "i"): 2, ("n", "n"): 38, ("n", "q"): 1, ("n", "r"): 12, ("n", "s"): 2,
                   ("q", "d"): 20, ("q", "n"): 9, ("q", "q"): 199, ("r", "d"): 1, ("r", "r"): 107, ("s", "d"): 1,
                   ("s", "s"): 36}
PRESENCE_CODES = {("n", "n"): 275, ("n", "y"): 39, ("y", "n"): 33, ("y", "y"): 450}
# textbook data with published results of the standard implementations
LIGHTNESS = [44.4, 45.9, 41.9, 53.3, 44.7, 44.1, 50.7, 45.2, 60.1]
PANEL = [2.6, 3.1, 2.5, 5.0, 3.6, 4.0, 5.2, 2.8, 3.8]
SLEEP = [[0.7, -1.6, -0.2, -1.2, -0.1, 3.4, 3.7, 0.8, 0.0, 2.0], [1.9, 0.8, 1.1, 0.1, -0.1, 4.4, 5.5, 1.6, 4.6, 3.4]]
WEIGHTS = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]


def near(a, b, tol=1e-6):
    return math.isclose(a, b, rel_tol=tol, abs_tol=tol)


def pairs(spark, x, y, g=None):
    rows = [(int(g[i]) if g is not None else 0, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "g int, x double, y double")


def two_groups(spark):
    return spark.createDataFrame([("related", v) for v in RELATED] + [("unrelated", v) for v in UNRELATED],
                                 "type string, cosine double")


# --------------------------------------------------------- special functions

def test_p_values_of_t(spark):
    df = spark.createDataFrame([(2.91, 50.0, .00538), (-0.64, 50.0, .52510), (2.22, 50.0, .03098),
                                (1.59, 40.0, .11971)], "t double, n double, p double")
    for r in df.withColumn("got", S.t_two_sided("t", "n")).collect():
        assert abs(r.got - r.p) < 1e-5


def test_t_against_numerical_integration(spark):
    cases = [(t, n) for t in (0.01, 0.7, 2.5, 8.0) for n in (1.0, 2.5, 7.0, 30.0, 400.0, 50_000.0)]
    df = spark.createDataFrame(cases, "t double, n double").withColumn("p", S.t_two_sided("t", "n"))
    for r in df.collect():
        theta = np.linspace(0, math.atan(r.t / math.sqrt(r.n)), 200_001)
        area = np.trapezoid(np.cos(theta) ** (r.n - 1), theta)
        const = math.exp(math.lgamma((r.n + 1) / 2) - math.lgamma(r.n / 2) - math.lgamma(0.5))
        assert abs(r.p - (1 - 2 * const * area)) < 1e-9


def test_t_quantile_inverts(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (50.0,), (1999.0,), (2001.0,), (1e7,)], "n double")
    out = df.withColumn("q", S.t_quantile(0.975, "n")).withColumn("p", S.t_two_sided("q", "n")).collect()
    assert all(near(r.p, 0.05, 1e-9) for r in out) and near(out[0].q, 12.7062047362, 1e-9)


def test_normal(spark):
    z = [-8.0, -2.0, -0.3, 0.0, 1.96, 2.99, 3.01, 6.0, 30.0]
    df = spark.createDataFrame([(v,) for v in z], "z double")
    for r in df.select("z", S.normal_upper("z").alias("u")).collect():
        assert math.isclose(r.u, 0.5 * math.erfc(r.z / math.sqrt(2)), rel_tol=1e-11)
    inverse = df.filter("abs(z) < 5").select("z", F.expr(S.normal_quantile_sql(S.normal_upper_sql("-z"))).alias("b"))
    assert all(near(r.z, r.b, 1e-9) for r in inverse.collect())


def test_binomial(spark):
    def exact(k, n):
        p = [math.comb(n, i) / 2 ** n for i in range(n + 1)]
        return sum(v for v in p if v <= p[k] * (1 + 1e-7))

    cases = [(36, 51), (26, 51), (0, 10), (5, 10), (3, 7), (400, 1000)]
    df = spark.createDataFrame(cases, "k long, n long")
    for r in hypothesis.binomial_test(df, "k", "n", ["k", "n"]).collect():
        assert near(r.p_value, min(1.0, exact(r.k, r.n)), 1e-9)
    assert near(hypothesis.binomial_test(df.filter("k = 36"), "k", "n").first().p_value, .0046013, 1e-5)


# --------------------------------------------------------------------- t-tests

def test_welch(spark):
    r = hypothesis.welch_t_test(two_groups(spark), "cosine", "type", "related", "unrelated").first()
    assert near(r.estimate1, .4652846, 1e-6) and near(r.estimate2, .1793058, 1e-6)
    assert near(r.statistic, 3.1058943, 1e-7) and near(r.parameter, 12.1949305, 1e-7) and near(r.p_value, .00893, 1e-3)
    sleep = spark.createDataFrame([(str(g), v) for g in (0, 1) for v in SLEEP[g]], "g string, v double")
    w = hypothesis.welch_t_test(sleep, "v", "g", "0", "1").first()
    assert near(w.statistic, -1.8608, 1e-4) and near(w.parameter, 17.776, 1e-4) and near(w.p_value, .07939, 1e-3)
    assert near(w.conf_low, -3.3654832, 1e-6) and near(w.conf_high, 0.2054832, 1e-6)


def test_paired_and_one_sample(spark):
    long = spark.createDataFrame([(i, str(g), SLEEP[g][i]) for g in (0, 1) for i in range(10)], "id int, g string, v double")
    p = hypothesis.paired_t_test(long, "v", "g", "0", "1", ["id"]).first()
    assert near(p.statistic, -4.0621, 1e-4) and p.parameter == 9 and near(p.p_value, .002833, 1e-3)
    assert near(p.conf_low, -2.4598858, 1e-6) and near(p.conf_high, -0.7001142, 1e-6)
    one = hypothesis.t_test(spark.createDataFrame([("a", 1.0), ("b", None), ("b", 2.0), ("b", 4.0)], "g string, v double"),
                            "v", ["g"]).orderBy("g").collect()
    assert one[0].statistic is None and one[0].p_value is None and near(one[1].statistic, 3.0)


# ---------------------------------------------------------------- correlations

def test_pearson_and_kendall_textbook(spark):
    df = pairs(spark, LIGHTNESS, PANEL)
    r = correlation.pearson_test(df, "x", "y").first()
    assert near(r.estimate, .5711816, 1e-6) and near(r.statistic, 1.8411, 1e-4) and near(r.p_value, .1082, 1e-3)
    assert near(r.conf_low, -0.1497426, 1e-6) and near(r.conf_high, 0.8955795, 1e-6)
    k = correlation.kendall_test(df, "x", "y").first()
    assert near(k.estimate, 4 / 9) and k.statistic == 26 and near(k.p_value, .1194, 1e-3)


def test_constant_and_missing_pairs(spark):
    df = spark.createDataFrame([("c", 1.0, float(i)) for i in range(4)] + [("m", 1.0, 2.0), ("m", 2.0, 1.0), ("m", 3.0, None)],
                               "g string, x double, y double")
    for test in (correlation.pearson_test, correlation.spearman_test, correlation.kendall_test):
        got = {r.g: r.estimate for r in test(df, "x", "y", ["g"]).collect()}
        assert got["c"] is None and near(got["m"], -1.0)


def brute_kendall(x, y):
    s = sum(np.sign(a[0] - b[0]) * np.sign(a[1] - b[1]) for a, b in itertools.combinations(zip(x, y), 2))
    n0 = len(x) * (len(x) - 1) / 2
    tie = lambda v: sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1])
    return s / math.sqrt((n0 - tie(x)) * (n0 - tie(y)))


@pytest.mark.parametrize("shape", ["ties", "hot", "smooth"])
def test_kendall_in_slices_equals_all_pairs(spark, monkeypatch, shape):
    rng = np.random.default_rng(5)
    n = 300
    x = {"ties": rng.integers(0, 12, n), "smooth": rng.normal(size=n),
         "hot": np.where(rng.random(n) < 0.4, 7, rng.integers(0, 60, n))}[shape]
    y = {"ties": rng.integers(0, 9, n) + x, "smooth": rng.normal(size=n) + x,
         "hot": np.where(rng.random(n) < 0.4, 3, rng.integers(0, 60, n))}[shape]
    monkeypatch.setattr(correlation, "TASK_ROWS", 40)
    monkeypatch.setattr(correlation, "SLICES", 8)
    group = [0] * n + [1] * 20
    both = pairs(spark, np.r_[x, x[:20]], np.r_[y, y[:20]], group)
    got = {r.g: r.estimate for r in correlation.kendall_test(both, "x", "y", ["g"]).collect()}
    assert near(got[0], brute_kendall(x, y), 1e-12) and near(got[1], brute_kendall(x[:20], y[:20]), 1e-12)


def test_spearman_with_ties(spark):
    x, y = [1, 2, 2, 3, 5, 5, 5, 8], [2, 1, 3, 3, 6, 5, 9, 9]
    rank = lambda v: [sum(a < b for a in v) + (sum(a == b for a in v) + 1) / 2 for b in v]
    r = correlation.spearman_test(pairs(spark, x, y), "x", "y").first()
    assert near(r.estimate, np.corrcoef(rank(x), rank(y))[0, 1], 1e-12) and r.parameter is None


def test_sweep(spark):
    df = pairs(spark, LIGHTNESS, PANEL)
    out = correlation.correlation_sweep([(df, [("k", "x", "y", "kendall"), ("p", "x", "y", "pearson")])])
    assert {r.pair: round(r.estimate, 4) for r in out.collect()} == {"k": 0.4444, "p": 0.5712}
    assert tuple(correlation.sweep_range(out).first()) == (0.44, 0.57, "fix")


def test_ranks_over_slices(spark):
    rng = np.random.default_rng(2)
    v, g = rng.integers(0, 50, 2000), rng.integers(0, 3, 2000)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, v)], "g int, v double")
    for r in ranks.value_ranks(df, ["g"], "v").collect():
        mine = v[g == r.g]
        assert r.before == (mine < r.v).sum() and r.ties == (mine == r.v).sum()
        assert r.midrank == r.before + (r.ties + 1) / 2
    numbered = ranks.numbered(df.select("v").distinct(), ["v"]).orderBy("v").collect()
    assert [r.position for r in numbered] == list(range(1, len(numbered) + 1))


# ------------------------------------------------------------------- normality

def test_shapiro(spark):
    rows = [("w", float(v)) for v in WEIGHTS] + [("c", v) for v in RELATED + UNRELATED] + [
        ("3", v) for v in (1.0, 2.0, 4.0)] + [("2", 1.0), ("2", 2.0)] + [("same", 1.0)] * 5
    got = {r.g: (r.statistic, r.p_value) for r in
           normality.shapiro_wilk(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()}
    assert near(got["w"][0], 0.7888, 1e-4) and near(got["w"][1], 0.006704, 1e-3)
    assert round(got["c"][1], 2) == 0.89
    assert near(got["3"][0], 0.9642857, 1e-6) and near(got["3"][1], 0.6368868, 1e-5)
    assert got["2"] == (None, None) and got["same"] == (None, None)


def test_shapiro_beyond_its_range(spark):
    df = spark.range(5001).select(F.col("id").cast("double").alias("v"))
    r = normality.shapiro_wilk(df, "v").first()
    assert 0.9 < r.statistic < 1 and r.parameter == 5001 and r.p_value < 0.01 and "beyond" in r.method


# -------------------------------------------------------------------- agreement

def coded(spark, table):
    rows = [(a, b, n) for (a, b), n in table.items()]
    return spark.createDataFrame(rows, "a string, b string, n int").select(
        "a", "b", F.explode(F.sequence(F.lit(1), F.col("n")))).select("a", "b")


@pytest.mark.parametrize("table, agree, kappa", [(UTTERANCE_CODES, .8946048, .8573900), (PRESENCE_CODES, .9096612, .8101816)])
def test_two_coders(spark, table, agree, kappa):
    df = coded(spark, table).unionByName(spark.createDataFrame([("d", None)], "a string, b string"))
    k = agreement.cohen_kappa(df, "a", "b").first()
    assert near(k.value, kappa, 1e-6) and k.subjects == 797 and k.p_value < 1e-9
    assert near(agreement.agreement(df, "a", "b").first().value, 100 * agree, 1e-6)


# ---------------------------------------------------------------- bootstrap, line

def test_bootstrap(spark, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK_ROWS", 17)
    rng = np.random.default_rng(11)
    x = rng.normal(size=60)
    y = 0.6 * x + rng.normal(size=60)
    df = pairs(spark, np.r_[x, x[:5]], np.r_[y, y[:5]])
    total = resample.bootstrap(df, ["x", "y"], {"ones": F.lit(1.0)}, F.col("ones"), reps=50)
    assert {r.t for r in total.collect()} == {65}
    values = [r.t for r in resample.bootstrap(df, ["x", "y"], *resample.correlation_sums("x", "y"), reps=400).collect()]
    xs, ys = np.r_[x, x[:5]], np.r_[y, y[:5]]
    draws = [np.corrcoef(xs[i], ys[i])[0, 1] for i in (rng.integers(0, 65, 65) for _ in range(4000))]
    assert abs(np.mean(values) - np.mean(draws)) < 0.02 and abs(np.std(values) - np.std(draws)) < 0.015
    ci = {r.method: r for r in resample.bootstrap_correlation(df, "x", "y", reps=400).collect()}
    assert near(ci["bca"].estimate, np.corrcoef(xs, ys)[0, 1], 1e-9)
    lo, hi = np.quantile(draws, [0.025, 0.975])
    assert abs(ci["percent"].conf_low - lo) < 0.08 and abs(ci["percent"].conf_high - hi) < 0.05
    assert all(r.conf_low < r.estimate < r.conf_high for r in ci.values())
    again = {r.method: r for r in resample.bootstrap_correlation(df.repartition(7), "x", "y", reps=400).collect()}
    assert near(again["bca"].conf_low, ci["bca"].conf_low, 1e-12)


def test_draws_do_not_depend_on_the_tasks(spark, monkeypatch):
    df = pairs(spark, np.arange(300) % 7, np.arange(300.0))
    one = {r.rep: r.t for r in resample.bootstrap(df, ["x", "y"], *resample.ratio_sums("x", "y"), reps=20, block_rows=8).collect()}
    monkeypatch.setattr(resample, "TASKS", 3)
    other = {r.rep: r.t for r in resample.bootstrap(df, ["x", "y"], *resample.ratio_sums("x", "y"), reps=20, block_rows=8).collect()}
    assert one.keys() == other.keys() and all(near(one[r], other[r], 1e-12) for r in one) and len(set(one.values())) == 20


def test_a_frequent_value_fills_many_blocks(spark):
    df = pairs(spark, np.r_[np.zeros(500), np.ones(100)], np.ones(600))
    found = [r.t for r in resample.bootstrap(df, ["x", "y"], {"x": F.col("x")}, F.col("x") / F.col("n"), reps=300, block_rows=16).collect()]
    assert abs(np.mean(found) - 1 / 6) < 0.004 and abs(np.std(found) - np.sqrt(5 / 36 / 600)) < 0.002


@pytest.mark.parametrize("k, p", [(0, 0.5), (1, 0.3), (30, 0.5), (200, 0.91), (5000, 0.5)])
def test_binomial_quantile(k, p):
    mass = [math.exp(math.lgamma(k + 1) - math.lgamma(i + 1) - math.lgamma(k - i + 1) + i * math.log(p) + (k - i) * math.log(1 - p)) for i in range(k + 1)]
    u = np.random.default_rng(k).random(200)
    want = [int(np.searchsorted(np.cumsum(mass), x)) for x in u]
    assert resample.binomial_quantile(np.full(200, k), p, u).tolist() == want


def test_bootstrap_far_from_zero(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=80), rng.normal(size=80)
    near_zero = {r.method: r for r in resample.bootstrap_correlation(pairs(spark, x, y), "x", "y", reps=100).collect()}
    far = {r.method: r for r in resample.bootstrap_correlation(pairs(spark, x + 2.0 ** 26, y + 2.0 ** 26), "x", "y", reps=100).collect()}
    assert all(abs(far[m].conf_low - near_zero[m].conf_low) < 1e-6 for m in far)


def test_acceleration_is_the_jackknife(spark):
    r = resample.jackknife_acceleration(pairs(spark, LIGHTNESS, PANEL), "x", "y").first().acceleration
    x, y = np.array(LIGHTNESS), np.array(PANEL)
    loo = np.array([np.corrcoef(np.delete(x, i), np.delete(y, i))[0, 1] for i in range(len(x))])
    d = loo.mean() - loo
    assert near(r, (d ** 3).sum() / (6 * (d ** 2).sum() ** 1.5), 1e-9)


def huber_numpy(x, y):
    X = np.c_[np.ones_like(x), x]
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    for _ in range(20):
        r = y - X @ beta
        s = np.median(np.abs(r)) / 0.6745
        w = np.minimum(1, 1.345 * s / np.maximum(np.abs(r), 1e-300))
        new = np.linalg.solve((X * w[:, None]).T @ X, (X * w[:, None]).T @ y)
        change = np.sqrt(((X @ (new - beta)) ** 2).sum() / (r ** 2).sum())
        beta = new
        if change <= 1e-4:
            break
    return beta, s


def test_huber(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=81)
    y = 1 + 2 * x + rng.standard_t(2, size=81)
    line = robust.huber_line(pairs(spark, x, y), "x", "y")
    (a, b), s = huber_numpy(x, y)
    assert near(line.intercept, a, 1e-9) and near(line.slope, b, 1e-9) and near(line.scale, s, 1e-9) and line.converged
    band = line.band(spark.createDataFrame([(0.5,)], "x double")).first()
    assert near(band.fit, a + b * 0.5, 1e-9) and band.conf_low < band.fit < band.conf_high


@pytest.mark.parametrize("n, few", [(1, 5), (2, 5), (5, 100), (10, 100), (3001, 50), (3000, 50)])
def test_exact_median(spark, monkeypatch, n, few):
    monkeypatch.setattr(robust, "FEW", few)
    v = np.abs(np.random.default_rng(n).normal(size=n))
    df = spark.createDataFrame([(float(a),) for a in v], "v double")
    assert robust.exact_median(df, "v") == float(np.median(v))


def test_exact_median_with_a_hot_value(spark, monkeypatch):
    monkeypatch.setattr(robust, "FEW", 20)
    v = np.r_[np.zeros(400), np.arange(1, 501)]
    df = spark.createDataFrame([(float(a),) for a in v], "v double")
    assert robust.exact_median(df, "v") == np.median(v)
    assert robust.exact_median(df.filter("v < 300"), "v") == 0.0


def test_bits_are_those_of_the_number(spark):
    v = [0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 1e-9, 0.1, 0.5, 1.0, 1 + 2 ** -52, 3.0, 1e15, 8.0, 7.999999999999999, 1.7976931348623157e308]
    found = [r.b for r in spark.createDataFrame([(a,) for a in v], "v double").select("v", robust.ordered_bits(F.col("v")).alias("b")).collect()]
    assert [robust.number_of(b) for b in found] == v


@pytest.mark.parametrize("few", [5, 4096])
def test_huber_through_bins(spark, monkeypatch, few):
    monkeypatch.setattr(robust, "FEW", few)
    rng = np.random.default_rng(8)
    x = rng.integers(0, 9, 400).astype(float) + 1e6
    y = 3 * x + rng.standard_t(1, size=400).round(1)
    line = robust.huber_line(pairs(spark, x, y), "x", "y")
    (a, b), s = huber_numpy(x - 1e6, y)
    assert near(line.slope, b, 1e-7) and near(line.intercept + 1e6 * line.slope, a, 1e-7) and near(line.scale, s, 1e-7)


# ------------------------------------------------------------------ exact ranks

def rank_law(n):
    """P(S <= s) by counting all orders."""
    counts = {}
    for order in itertools.permutations(range(n)):
        s = sum((i - j) ** 2 for i, j in enumerate(order))
        counts[s] = counts.get(s, 0) + 1
    return counts


@pytest.mark.parametrize("n", [2, 3, 5, 7])
def test_law_of_rank_differences(n):
    counts, so_far = rank_law(n), 0
    for k, p in enumerate(S.squared_rank_law(n)):
        so_far += counts.get(2 * k, 0)
        assert near(p, so_far / math.factorial(n), 1e-15)


def spearman_p(spark, s, n):
    return spark.range(1).select(F.lit(float(s)).alias("s"), F.lit(n).alias("n")).select(S.spearman_exact_p("s", "n").alias("p")).first().p


def test_spearman_published_values(spark):
    # the lightness example: S = 48 of 9 pairs, p = 0.0968
    r = correlation.spearman_test(pairs(spark, LIGHTNESS, PANEL), "x", "y").first()
    assert near(r.statistic, 48, 1e-9) and abs(r.p_value - 0.0968) < 5e-5 and near(r.estimate, 0.6, 1e-9)
    # fixed values: critical values of rho, two-sided, as printed in tables
    for n, alpha, rho in [(5, 0.05, 1.0), (6, 0.05, 0.886), (8, 0.05, 0.738), (9, 0.01, 0.833), (10, 0.05, 0.648), (12, 0.05, 0.587), (20, 0.05, 0.447), (30, 0.01, 0.467)]:
        step = 12 / (n ** 3 - n)  # rho moves by this much from one value of S to the next
        s = round((1 - rho) * (n ** 3 - n) / 12) * 2
        assert spearman_p(spark, s, n) <= alpha * 1.02 and spearman_p(spark, s + 4 * max(1, round(0.01 / step)), n) > alpha * 0.98


@pytest.mark.parametrize("n", [10, 11])
def test_series_is_near_the_law(spark, n):
    law = S.squared_rank_law(n)
    top = (n ** 3 - n) // 3
    for k in range(0, len(law) // 2, 9):
        want = min(1.0, 2 * law[k])
        assert abs(spearman_p(spark, 2 * k, n) - want) < 2e-3 and near(spearman_p(spark, top - 2 * k, n), spearman_p(spark, 2 * k, n), 1e-12)


def test_spearman_with_ties_or_many_pairs_is_approximate(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=1400), rng.normal(size=1400)
    for a, b in ((x, y), (np.r_[x[:20], x[:20]], y[:40])):
        r = correlation.spearman_test(pairs(spark, a, b), "x", "y").first()
        t = r.estimate * math.sqrt((len(a) - 2) / (1 - r.estimate ** 2))
        assert near(r.p_value, spark.range(1).select(S.t_two_sided(f"CAST({t!r} AS DOUBLE)", f"{len(a) - 2}").alias("p")).first().p, 1e-9)


# ----------------------------------------------------------------------- spline

def test_spline_is_the_penalised_fit(spark):
    rng = np.random.default_rng(6)
    x = np.arange(0.0, 10.0, 0.1)
    n = rng.integers(1, 9, len(x))
    y = [rng.normal(np.sin(v), 0.3, k) for v, k in zip(x, n)]
    rows = [(g, float(v), int(k), float(w.sum()), float((w ** 2).sum())) for g in "ab" for v, k, w in zip(x, n, y)]
    points = spark.createDataFrame(rows, "g string, x double, n long, total double, squares double")
    out = sorted((r.g, r.x, r.smooth, r.smooth_low, r.smooth_high) for r in smooth.with_spline(points, ["g"], "x", "n", "total", "squares", 0.0, 10.0).collect())
    piece = np.clip(np.floor(x / (10 / 7)), 0, 6).astype(int)
    t = x / (10 / 7) - piece
    base = np.zeros((len(x), 10))
    for k, f in enumerate([(1 - t) ** 3 / 6, (3 * t ** 3 - 6 * t ** 2 + 4) / 6, (-3 * t ** 3 + 3 * t ** 2 + 3 * t + 1) / 6, t ** 3 / 6]):
        base[np.arange(len(x)), piece + k] = f
    assert np.allclose(base.sum(1), 1)
    change = np.diff(np.eye(10), 2, axis=0)
    big, response = np.repeat(base, n, axis=0), np.concatenate(y)
    best = None
    for power in smooth.PENALTIES:
        m = big.T @ big + len(response) * 10.0 ** power * change.T @ change
        hat = big @ np.linalg.solve(m, big.T)
        left = ((response - hat @ response) ** 2).sum()
        score = len(response) * left / (len(response) - np.trace(hat)) ** 2
        if best is None or score < best[0]:
            c = np.linalg.inv(m) * left / (len(response) - np.trace(hat))
            best = score, base @ np.linalg.solve(m, big.T @ response), np.sqrt(np.einsum("ij,jk,ik->i", base, c, base))
    assert len(out) == 200 and all(near(r[2], best[1][i % 100], 1e-7) and near(r[3], best[1][i % 100] - 1.959963984540054 * best[2][i % 100], 1e-6) for i, r in enumerate(out))
    assert np.abs(best[1] - np.sin(x)).max() < 0.3


def test_spline_without_a_solution_is_missing(spark):
    points = spark.createDataFrame([("a", 1.0, 3, 2.0, 2.0), ("b", 1.0, 0, 0.0, 0.0)], "g string, x double, n long, total double, squares double")
    assert [r.smooth for r in smooth.with_spline(points, ["g"], "x", "n", "total", "squares", 0.0, 10.0).collect()] == [None, None]


# --------------------------------------------------------------------- summaries

def test_levels_beyond_the_most_frequent_are_one_row(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [(None,)] * 3 + [("c",)] * 2 + [("d",)] + [("e",)], "x string")
    got = {r.place: (r.level, r.n) for r in report.level_summary(df, ["x"], most=4).collect()}
    assert got == {1: ("a", 5), 2: ("b", 3), 3: (None, 3), 4: ("(Other)", 4)}
    assert report.level_summary(df, ["x"], most=6).count() == 6 and report.level_summary(df, ["x"], most=5).filter("level = '(Other)'").first().n == 2


def test_pairs_leave_out_rows_pair_by_pair(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 3)) + 1e8
    rows = [tuple(None if rng.random() < 0.2 else float(x) for x in r) for r in v]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {r.pair: r for r in correlation.pearson_pairs(df, [("ab", "a", "b"), ("ac", "a", "c"), ("flat", "a", "a")]).collect()}
    for name, i, j in (("ab", 0, 1), ("ac", 0, 2)):
        kept = np.array([(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None])
        assert near(got[name].estimate, np.corrcoef(kept.T)[0, 1], 1e-7) and got[name].parameter == len(kept) - 2
        assert near(got[name].p_value, correlation.pearson_test(df, "ab"[0], "abc"[j]).first().p_value, 1e-9)
    assert near(got["flat"].estimate, 1.0, 1e-12)
