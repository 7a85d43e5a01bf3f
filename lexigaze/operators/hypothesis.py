"""t-tests, exact binomial test, confidence intervals of a mean.

Each test is one aggregation to a handful of moments per group, then arithmetic on the
aggregated row. Results share the columns estimate, statistic, parameter, p_value,
conf_low, conf_high, method after the group columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lexigaze.functions.nulls import ratio, spread
from lexigaze.functions.special import binomial_two_sided, t_quantile, t_two_sided

TIDY = ["estimate", "statistic", "parameter", "p_value", "conf_low", "conf_high", "method"]


def tidy(df: DataFrame, group: Sequence[str], estimate, statistic=None, parameter=None,
         p_value=None, conf_low=None, conf_high=None, method: str | Column = "",
         extra: Sequence[Column | str] = ()) -> DataFrame:
    """One test per row in the shared layout; what a test does not have is NULL."""
    missing = F.lit(None)
    values = [estimate, statistic, parameter, p_value, conf_low, conf_high]
    cols = [(missing if v is None else v).cast("double").alias(n) for v, n in zip(values, TIDY)]
    method = F.lit(method) if isinstance(method, str) else method
    return df.select(*group, *cols, method.alias("method"), *extra)


def _tidy_t(m: DataFrame, group, estimate: Column, se: Column, df: Column, mu: float, method: str,
            level: float, extra=()) -> DataFrame:
    """The arithmetic every t-test shares, on rows that hold its moments."""
    staged = m.select(*group, *extra, estimate.alias("_est"), se.alias("_se"), df.alias("_df"))
    staged = staged.withColumn("_t", F.try_divide(F.col("_est") - mu, F.col("_se")))
    half = t_quantile(1 - (1 - level) / 2, "_df") * F.col("_se")
    return tidy(staged, group, F.col("_est"), F.col("_t"), F.col("_df"),
                t_two_sided("_t", "_df"), F.col("_est") - half, F.col("_est") + half,
                method, extra)


def t_test(df: DataFrame, value: str, group: Sequence[str] = (), mu: float = 0.0,
           level: float = 0.95) -> DataFrame:
    """One-sample two-sided t-test per group; missing values are dropped."""
    m = df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                               F.stddev_samp(value).alias("sd"))
    return _tidy_t(m, list(group), F.col("mean"), F.col("sd") / F.sqrt(F.nullif(F.col("n"), F.lit(0))),
                   (F.col("n") - 1).cast("double"), mu, "One Sample t-test", level)


def paired_t_test(df: DataFrame, value: str, label: str, first: str, second: str,
                  pair: Sequence[str], level: float = 0.95, group: Sequence[str] = ()) -> DataFrame:
    """Paired t-test of first - second per group; rows are paired by key, not by position."""
    wide = spread(df, [*group, *pair], label, [first, second], value)
    diff = wide.withColumn("_diff", F.col(f"`{first}`") - F.col(f"`{second}`"))
    return t_test(diff, "_diff", group, level=level).withColumn("method", F.lit("Paired t-test"))


def welch_t_test(df: DataFrame, value: str, label: str, first: str, second: str,
                 group: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """Welch two-sample t-test of mean(first) - mean(second)."""
    aggs = []
    for tag, level_name in (("1", first), ("2", second)):
        v = F.when(F.col(label) == level_name, F.col(value))
        aggs += [F.count(v).alias(f"n{tag}"), F.avg(v).alias(f"estimate{tag}"),
                 F.var_samp(v).alias(f"v{tag}")]
    m = df.groupBy(*group).agg(*aggs)
    e1, e2 = ratio("v1", "n1"), ratio("v2", "n2")
    dof = F.try_divide((e1 + e2) * (e1 + e2), e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))
    return _tidy_t(m, list(group), F.col("estimate1") - F.col("estimate2"), F.sqrt(e1 + e2), dof, 0.0,
                   "Welch Two Sample t-test", level, ["estimate1", "estimate2"])


def mean_interval(df: DataFrame, value: str, group: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """Mean with its t confidence interval per group."""
    m = df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                               F.stddev_samp(value).alias("sd"))
    half = t_quantile(1 - (1 - level) / 2, "(n - 1)") * F.col("sd") / F.sqrt(
        F.nullif(F.col("n"), F.lit(0)))
    return m.withColumn("_half", half).select(
        *group, "n", "mean", "sd", (F.col("mean") - F.col("_half")).alias("conf_low"),
        (F.col("mean") + F.col("_half")).alias("conf_high"))


def binomial_test(df: DataFrame, successes: str, trials: str, group: Sequence[str] = ()) -> DataFrame:
    """Exact two-sided test of a share against one half, one test per row."""
    return tidy(df, group, ratio(successes, trials), F.col(successes), F.col(trials),
                binomial_two_sided(f"`{successes}`", f"`{trials}`"), method="Exact binomial test")


def positive_share(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """How many values are above zero: count, k/n label, mean, sd, exact p."""
    m = df.groupBy(*group).agg(
        F.count_if(F.col(value) > 0).alias("numpos"), F.count(F.lit(1)).alias("n_all"),
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return m.select(*group, "numpos", "n_all", F.concat_ws("/", "numpos", "n_all").alias("proppos"),
                    "mean", "sd", binomial_two_sided("numpos", "n_all").alias("p_value"))
