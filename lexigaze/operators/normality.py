"""Shapiro-Wilk normality test per group."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lexigaze.functions.nulls import attach
from lexigaze.functions.special import normal_quantile, normal_upper_sql, num, polynomial
from lexigaze.operators.hypothesis import tidy
from lexigaze.operators.ranks import running_total

# The p law was fitted to 3 to 5000 values; beyond that W is exact and the same law is carried on, as ``method`` says.
LEAST, FITTED = 3, 5000
NAME = "Shapiro-Wilk normality test"

# Royston (1995), AS R94: fixed values, ascending powers.
LAST_WEIGHT = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
NEXT_WEIGHT = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SMALL_GAMMA = [-2.273, 0.459]
SMALL_MEAN = [0.5440, -0.39978, 0.025054, -6.714e-4]
SMALL_LOG_SD = [1.3822, -0.77857, 0.062767, -0.0020322]
LARGE_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
LARGE_LOG_SD = [-0.4803, -0.082676, 0.0030302]


def _p_value() -> Column:
    """p from columns ``w`` and ``n``."""
    log_n, rest = "ln(CAST(n AS DOUBLE))", "ln(1 - w)"
    exact = f"greatest(0D, {num(6 / math.pi)} * (asin(sqrt(w)) - {num(math.asin(math.sqrt(0.75)))}))"
    gamma = polynomial("n", SMALL_GAMMA)
    small = normal_upper_sql(
        f"(-ln({gamma} - {rest}) - {polynomial('n', SMALL_MEAN)}) / exp({polynomial('n', SMALL_LOG_SD)})")
    large = normal_upper_sql(
        f"({rest} - {polynomial(log_n, LARGE_MEAN)}) / exp({polynomial(log_n, LARGE_LOG_SD)})")
    return F.expr(f"CASE WHEN w >= 1 THEN 1D WHEN n = 3 THEN {exact} WHEN n > 11 THEN {large} "
                  f"WHEN {rest} >= {gamma} THEN 1e-99D ELSE {small} END")


def shapiro_wilk(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """W and p per group.

    Places in the order come from running totals over range slices, so a group of any size is
    ranked by many tasks. Groups of fewer than three values, and constant ones, keep a row
    with NULL results.
    """
    group = list(group)
    rows = df.select(*group, F.col(value).cast("double").alias("v")).filter(
        F.col("v").isNotNull())
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("centre"))
    testable = sizes.filter(F.col("n") >= LEAST)
    # equal values may come in any order; the number only tells them apart
    placed = running_total(rows.withColumns({"_id": F.monotonically_increasing_id(), "_one": F.lit(1)}), group, ["v", "_id"], "_one", "_before")
    scored = (
        attach(placed, testable, group, "inner", salts=64)
        .withColumn("i", F.col("_before") + 1)
        .withColumn("m", normal_quantile("(i - 0.375D) / (n + 0.25D)")))
    # sums that fix the two outer weights; inner weights are m / sqrt(phi)
    v = F.col("v")
    first, second = F.col("i") == 1, F.col("i") == 2
    last, before = F.col("i") == F.col("n"), F.col("i") == F.col("n") - 1
    sums = scored.groupBy(*group, "n").agg(
        F.sum(F.col("m") ** 2).alias("mm"), F.sum(F.col("m") * v).alias("mv"),
        F.sum((v - F.col("centre")) ** 2).alias("ss"),
        F.max(F.when(first, v)).alias("v1"), F.max(F.when(second, v)).alias("v2"),
        F.max(F.when(last, v)).alias("vn"), F.max(F.when(before, v)).alias("vp"),
        F.max(F.when(last, F.col("m"))).alias("mn"), F.max(F.when(before, F.col("m"))).alias("mp"))

    n = F.col("n")
    u = "(1 / sqrt(n))"
    root = F.sqrt("mm")
    staged = sums.withColumn("an", F.expr(polynomial(u, LAST_WEIGHT)) + F.col("mn") / root).withColumn(
        "ap", F.expr(polynomial(u, NEXT_WEIGHT)) + F.col("mp") / root)
    one = (F.col("mm") - 2 * F.col("mn") ** 2) / (1 - 2 * F.col("an") ** 2)
    two = (F.col("mm") - 2 * F.col("mn") ** 2 - 2 * F.col("mp") ** 2) / (
        1 - 2 * F.col("an") ** 2 - 2 * F.col("ap") ** 2)
    outer = F.col("an") * (F.col("vn") - F.col("v1"))
    inner1 = F.col("mv") - F.col("mn") * (F.col("vn") - F.col("v1"))
    inner2 = inner1 - F.col("mp") * (F.col("vp") - F.col("v2"))
    score = (
        F.when(n == 3, math.sqrt(0.5) * (F.col("vn") - F.col("v1")))
        .when(n <= 5, outer + inner1 / F.sqrt(one))
        .otherwise(outer + F.col("ap") * (F.col("vp") - F.col("v2")) + inner2 / F.sqrt(two)))
    w = F.when(F.col("v1") < F.col("vn"), F.least(F.lit(1.0), F.try_divide(score * score, F.col("ss"))))
    tested = staged.select(*group, w.alias("w"))
    result = attach(sizes.select(*group, "n"), tested, group)
    return tidy(result, group, None, F.col("w"), F.col("n"), _p_value(),
                method=F.when(F.col("n") > FITTED, f"{NAME}, p beyond the fitted sizes").otherwise(NAME))
