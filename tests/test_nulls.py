from pyspark.sql import functions as F

from lexigaze.functions import nulls as N


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_n_distinct_counts_missing_once(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("a", None), ("b", 2)], "g string, v int")
    out = df.groupBy("g").agg(N.n_distinct("v").alias("n"), F.count_distinct("v").alias("plain"))
    assert rows(out, "g") == [("a", 2, 1), ("b", 1, 1)]


def test_strict_is_missing_with_any_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0)], "g string, v double")
    out = df.groupBy("g").agg(N.strict(F.avg, "v").alias("s"), F.avg("v").alias("m"))
    assert rows(out, "g") == [("a", None, 1.0), ("b", 3.0, 3.0)]


def test_all_missing_mean_and_single_sd_are_null(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert df.agg(F.avg("v"), F.stddev_samp("v")).first() == (None, None)
    assert spark.createDataFrame([(1.0,)], "v double").agg(F.stddev_samp("v")).first()[0] is None


def test_joins_match_missing_keys(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("z", 3)], "k string, x int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, y int")
    assert rows(N.natural_join(left, right), "x") == [("a", 1, 10), (None, 2, 20), ("z", 3, None)]
    assert [r[1] for r in rows(N.in_table(left, right, "k"), "x")] == [1, 2]
    assert [r[1] for r in rows(N.not_in_table(left, right, "k"), "x")] == [3]


def test_right_join_keeps_the_right_key(spark):
    left = spark.createDataFrame([("a", 1)], "k string, x int")
    right = spark.createDataFrame([("a", 10), ("b", 20)], "k string, y int")
    assert rows(N.natural_join(left, right, "right"), "y") == [("a", 1, 10), ("b", None, 20)]


def test_natural_join_checks_its_keys(spark):
    import pytest

    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        N.natural_join(df, df, expect=["a"])


def test_if_else_is_three_valued(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "v int")
    out = df.select("v", N.if_else(F.col("v") > 3, F.lit("big"), F.lit("small")).alias("s"))
    assert rows(out, F.col("v").asc_nulls_last()) == [(1, "small"), (5, "big"), (None, None)]


def test_membership_is_never_null(spark):
    df = spark.createDataFrame([("a",), (None,)], "v string")
    out = df.select(N.is_one_of("v", ["a"]).alias("t"), (~N.is_one_of("v", ["a"])).alias("f"))
    assert sorted(tuple(r) for r in out.collect()) == [(False, True), (True, False)]


def test_recode_passes_unknown_values(spark):
    df = spark.createDataFrame([("ns01",), ("x",), (".",), (None,)], "v string")
    out = [r[0] for r in df.select(N.recode("v", {"ns01": "ns01_06", ".": None})).collect()]
    assert out == ["ns01_06", "x", None, None]


def test_separate_drops_surplus_and_fills_missing(spark):
    df = spark.createDataFrame([("01_06_18",), ("ns01",), (None,)], "v string")
    out = [tuple(r)[1:] for r in N.separate(df, "v", ["a", "b"]).collect()]
    assert out == [("01", "06"), ("ns01", None), (None, None)]


def test_ratio_and_number_parsing(spark):
    df = spark.createDataFrame([(0, 0, "x"), (1, 2, "07")], "a int, b int, c string")
    out = [tuple(r) for r in df.select(N.ratio("a", "b"), N.to_number("c")).collect()]
    assert out == [(None, None), (0.5, 7.0)]


def test_spread_and_counts(spark):
    df = spark.createDataFrame([("s", "y"), ("s", "y"), ("t", "n"), ("u", "q")], "k string, v string")
    wide = N.spread_counts(df, ["k"], "v", ["n", "y"])
    assert rows(wide, "k") == [("s", None, 2), ("t", 1, None)]
    assert rows(N.fill_zero(wide, ["n", "y"]), "k") == [("s", 0, 2), ("t", 1, 0)]
    long = df.groupBy("k", "v").count()
    assert rows(N.spread(long, ["k"], "v", ["n", "y"], "count"), "k") == [
        ("s", None, 2), ("t", 1, None), ("u", None, None)]


def test_nan_becomes_missing(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "v double, i int")
    assert rows(N.nan_to_null(df), "i") == [(None, 1), (2.0, 2)]
