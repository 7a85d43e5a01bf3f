"""Agreement of two coders: percent agreement and Cohen's kappa."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lexigaze.functions.nulls import attach, if_else, ratio
from lexigaze.functions.special import normal_two_sided


def _cells(df: DataFrame, a: str, b: str, group: Sequence[str]) -> DataFrame:
    """Contingency table, rows with a missing code dropped."""
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(
        *group, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def agreement(df: DataFrame, a: str, b: str, group: Sequence[str] = ()) -> DataFrame:
    """Percent of rows coded alike."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.groupBy(*group).agg(
        F.count(F.lit(1)).alias("subjects"),
        (ratio(F.count_if(F.col(a) == F.col(b)), F.count(F.lit(1))) * 100).alias("value"))


def cohen_kappa(df: DataFrame, a: str, b: str, group: Sequence[str] = ()) -> DataFrame:
    """Unweighted kappa with its z-test against no agreement beyond chance.

    One pass reduces the rows to the contingency table; everything after works on codes,
    not on rows.
    """
    group = list(group)
    cells = _cells(df, a, b, group)
    margin_a = cells.groupBy(*group, F.col("a").alias("code")).agg(F.sum("n").alias("na"))
    margin_b = cells.groupBy(*group, F.col("b").alias("code")).agg(F.sum("n").alias("nb"))
    margins = margin_a.select(*group, "code", "na", F.lit(0).cast("long").alias("nb")).unionByName(
        margin_b.select(*group, "code", F.lit(0).cast("long").alias("na"), "nb")).groupBy(
        *group, "code").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    same = cells.groupBy(*group).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(F.lit(0))).alias("same"))
    na, nb = F.col("na").cast("double"), F.col("nb").cast("double")
    chance = margins.groupBy(*group).agg(
        F.sum(na * nb).alias("cross"), F.sum(na * nb * (na + nb)).alias("cubes"))
    both = attach(same, chance, group)
    n = F.col("n").cast("double")
    both = both.select(*group, F.col("n").alias("subjects"), (F.col("same") / n).alias("po"),
                       (F.col("cross") / (n * n)).alias("pe"), (F.col("cubes") / (n * n * n)).alias("pc"))
    po, pe = F.col("po"), F.col("pe")
    kappa = F.try_divide(po - pe, 1 - pe)
    se = F.try_divide(F.sqrt(F.greatest(F.lit(0.0), pe + pe * pe - F.col("pc"))),
                      (1 - pe) * F.sqrt(F.col("subjects").cast("double")))
    staged = both.select(*group, "subjects", kappa.alias("value"), F.try_divide(kappa, se).alias("statistic"))
    return staged.withColumn("p_value", normal_two_sided("statistic"))


def with_agreement(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Boolean agreement column per pair of codes; NULL where a code is missing."""
    return df.withColumns({name: if_else(F.col(a) == F.col(b), F.lit(True), F.lit(False))
                           for name, (a, b) in pairs.items()})


def mean_rounded(values: DataFrame, value: str, digits: int) -> DataFrame:
    """Mean over the tables being compared, rounded for the text."""
    return values.agg(F.bround(F.avg(value), digits).alias(value))
