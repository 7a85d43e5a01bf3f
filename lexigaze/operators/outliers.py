"""Outlier flags against the spread of a group.

A flag needs two numbers per group, so they are aggregated first (partial sums on the
map side) and joined back to the rows, salted: a window over the group, or a plain join by
it, could pull a whole month into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lexigaze.functions.nulls import attach, strict

SALTS = 64


def flag_outliers(df: DataFrame, value: str, group: Sequence[str], width: float = 3.0,
                  remove_missing: bool = True, name: str = "outlier") -> DataFrame:
    """``value`` further than ``width`` sample sds from the mean of its group.

    NULL when the value, the mean or the sd is missing (one value has no sd).
    """
    agg = (lambda f, c: f(c)) if remove_missing else strict
    limits = df.groupBy(*group).agg(
        agg(F.avg, value).alias("_centre"), agg(F.stddev_samp, value).alias("_spread"))
    joined = attach(df, limits, list(group), salts=SALTS)
    reach = width * F.col("_spread")
    flag = (F.col(value) > F.col("_centre") + reach) | (F.col(value) < F.col("_centre") - reach)
    return joined.withColumn(name, flag).drop("_centre", "_spread")


def outliers(flagged: DataFrame, name: str = "outlier") -> DataFrame:
    return flagged.filter(F.col(name) == F.lit(True))


def without_outliers(flagged: DataFrame, name: str = "outlier") -> DataFrame:
    """Rows known not to be outliers; a missing flag is removed as well."""
    return flagged.filter(F.col(name) == F.lit(False))
