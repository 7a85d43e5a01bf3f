"""Cases that went wrong once: size limits, trials with several targets, code on workers, silent picks."""

import math
import os
import subprocess
import sys
from statistics import NormalDist

import numpy as np
import pytest
from lexigaze.functions import nulls
from lexigaze.operators import correlation, gaze, looking, normality, report
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def w_by_hand(v):
    """Royston's W with numpy, for more than five values."""
    v = np.sort(v)
    n = len(v)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, root = 1 / math.sqrt(n), math.sqrt((m * m).sum())
    an = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0], u) + m[-1] / root
    ap = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], u) + m[-2] / root
    phi = ((m * m).sum() - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an ** 2 - 2 * ap ** 2)
    a = m / math.sqrt(phi)
    a[0], a[1], a[-2], a[-1] = -an, -ap, ap, an
    return float((a @ v) ** 2 / ((v - v.mean()) ** 2).sum())


def test_normality_beyond_five_thousand(spark):
    rng = np.random.default_rng(4)
    groups = {"normal": rng.normal(size=6000), "ties": np.round(rng.normal(size=6000), 1), "few": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "g string, v double")
    got = {r.g: r for r in normality.shapiro_wilk(df, "v", ["g"]).collect()}
    for g in ("normal", "ties"):
        assert got[g].statistic == pytest.approx(w_by_hand(groups[g]), abs=1e-7) and got[g].parameter == 6000
        assert 0 < got[g].p_value <= 1 and "beyond" in got[g].method
    assert got["few"].statistic is None and got["few"].p_value is None


def test_method_is_unknown_without_p(spark):
    rows = [(0.5, 0.5), (0.01, 0.5), (None, 0.5), (None, 0.01)]
    df = spark.createDataFrame(rows, "a double, b double").select("a", "b", correlation.choose_method(F.col("a"), F.col("b")).alias("m"))
    assert {(r.a, r.b): r.m for r in df.collect()} == {rows[0]: "pearson", rows[1]: "kendall", rows[2]: None, rows[3]: "kendall"}


def test_kendall_cut_over_several_levels(spark, monkeypatch):
    rng = np.random.default_rng(8)
    n = 3000
    x = np.where(rng.random(n) < 0.3, 7, rng.integers(0, 500, n))
    y = np.where(rng.random(n) < 0.3, x // 3, rng.integers(0, 200, n))
    s = int((np.sign(x[:, None] - x[None]) * np.sign(y[:, None] - y[None])).sum() // 2)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)], "x int, y int")
    cells = correlation.complete_pairs(df, "x", "y", []).groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
    monkeypatch.setattr(correlation, "TASK_ROWS", 100)
    monkeypatch.setattr(correlation, "SLICES", 4)
    assert int(correlation._pair_sums(cells, []).first().s) == s


def test_workers_without_the_package_on_their_path(tmp_path):
    """Kendall from another working folder, the package named to the driver only."""
    code = (f"import sys; sys.path.insert(0, {ROOT!r})\nimport __spark_entry__ as e\nfrom pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "print('rows', e.queries()['cor_kendall'](s, '/root/testdata/sf0.001').count())")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 1" in done.stdout, done.stderr[-1500:]


def test_low_data_counts_a_trial_with_two_targets_once(spark):
    """50 window bins on each of two targets: the trial has 100 and is kept by both routes."""
    cols = ("SubjectNumber string, subj string, month string, TrialNumber int, target string, trialtype string, pair string, "
            "propt double, pre_bins long, long_bins long")
    rows = [("s_06", "s", "06", 1, t, "within", "a_b", 1.0, 5, 50) for t in ("a", "b")] + [("s_06", "s", "06", 2, "a", "within", "a_b", 1.0, 5, 50)]
    scores = looking.trial_scores(spark.createDataFrame(rows, cols)).collect()
    assert {(r.TrialNumber, r.target): r.lowdata for r in scores} == {(1, "a"): False, (1, "b"): False, (2, "a"): True}
    bins = spark.createDataFrame([(r[0], r[3], r[4], r[7], "Y") for r in rows for _ in range(50)],
                                 "SubjectNumber string, TrialNumber int, target string, propt double, longwin string")
    flagged = gaze.flag_low_data(bins).select("TrialNumber", "target", "lowdata").distinct().collect()
    assert {(r.TrialNumber, r.target): r.lowdata for r in flagged} == {(1, "a"): False, (1, "b"): False, (2, "a"): True}


def test_two_rows_in_one_cell_are_an_error(spark):
    df = spark.createDataFrame([("k", "a", 1), ("k", "a", 2)], "key string, name string, value int")
    with pytest.raises(Exception, match="several rows in one cell"):
        nulls.spread(df, ["key"], "name", ["a", "b"], "value").collect()
    one = nulls.spread(df.where("value = 1"), ["key"], "name", ["a", "b"], "value").first()
    assert (one.a, one.b) == (1, None)


def test_whole_numbers_keep_their_zeros(spark):
    df = spark.createDataFrame([(100.0,), (20.5,), (None,), (0.0,)], "x double")
    got = [(r.a, r.b) for r in df.select(report.number_text("x", 0).alias("a"), report.number_text("x", 2).alias("b")).collect()]
    assert got == [("100", "100"), ("20", "20.5"), ("NA", "NA"), ("0", "0")]


def test_spearman_gives_the_squared_rank_differences(spark):
    rng = np.random.default_rng(6)
    x, y = rng.permutation(30), rng.permutation(30)
    got = correlation.spearman_test(spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)], "x int, y int"), "x", "y").first()
    assert got.statistic == pytest.approx(((x - y) ** 2).sum()) and got.parameter is None
    assert got.estimate == pytest.approx(1 - 6 * ((x - y) ** 2).sum() / (30 ** 3 - 30))
