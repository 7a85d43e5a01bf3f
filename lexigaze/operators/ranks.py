"""Ranks and running totals without a single-task sort.

A window ordered over everything (or over one huge group) would sort in one task. Here
the rows, unique in group and order, are range-partitioned into slices of about equal
size, each slice is accumulated by itself, and the totals of the slices before it are
added. Equal values are folded into one weighted row first, so a value that fills a third
of the table is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexigaze.functions.nulls import natural_join
from lexigaze.session import stable


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[str], weight: str,
                  name: str = "before", descending: bool = False) -> DataFrame:
    """Add the sum of ``weight`` over the rows of the group that come before this one.

    (group, order) must identify a row. The placement into slices is checkpointed: a
    range partitioning recomputed after a lost executor may cut elsewhere.
    """
    direction = (lambda c: F.col(c).desc_nulls_last()) if descending else (
        lambda c: F.col(c).asc_nulls_last())
    sort = [*[F.col(g) for g in group], *[direction(c) for c in order]]
    placed = stable(df.repartitionByRange(*sort).withColumn("_slice", F.spark_partition_id()))
    # at most one row per slice and group: a short window
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_slice", *group).agg(F.sum(weight).alias("_sum")).withColumn(
        "_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("_slice", *group).orderBy(*sort[len(group):]).rowsBetween(
        Window.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return (natural_join(local, offsets, "left", expect=["_slice", *group])
            .withColumn(name, F.col("_local") + F.col("_offset"))
            .drop("_slice", "_local", "_offset"))


def value_ranks(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Distinct non-missing values per group: how often, how many before, mid-rank."""
    values = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(
        F.count(F.lit(1)).alias("ties"))
    return running_total(values, group, [value], "ties").withColumn(
        "midrank", F.col("before") + (F.col("ties") + 1) / 2)


def numbered(df: DataFrame, order: Sequence[str], name: str = "position",
             descending: bool = False) -> DataFrame:
    """Number the rows 1..n in the order of columns that identify a row."""
    return (running_total(df.withColumn("_one", F.lit(1)), [], order, "_one", "_n", descending)
            .withColumn(name, F.col("_n") + 1).drop("_n", "_one"))


def order_by_first(df: DataFrame, key: str, value: str | Column) -> DataFrame:
    """Keys ranked by where they first show up when rows are sorted by ``value``."""
    value = F.col(value) if isinstance(value, str) else value
    firsts = df.groupBy(key).agg(F.min(value).alias("first_value"))
    return numbered(firsts, ["first_value", key])


def order_by_mean(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys ranked by descending mean of ``value``."""
    means = df.groupBy(key).agg(F.avg(value).alias("mean_value"))
    return numbered(means.withColumn("_down", -F.col("mean_value")), ["_down", key]).drop("_down")
