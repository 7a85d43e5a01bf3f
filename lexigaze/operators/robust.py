"""Huber M-estimation of a straight line.

Each step needs the median of the absolute residuals and then sums weighted by a limit that
follows from this median. One read of the rows serves both: residuals are put into bins by the
upper bits of their binary form, whose order is that of the numbers, and every bin carries its count
and its sums with and without the factor 1 / |residual|. The median lies in one known bin and the
limit in another; only rows of these two bins are looked at again.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexigaze.session import stable

HUBER_K = 1.345
MAD_TO_SD = 0.6745
DIGIT = 16  # bits looked at in one pass
FEW = 4096  # so many values of one bin may come to the driver


@dataclass(frozen=True)
class Line:
    """A fitted line with what its confidence band needs."""

    intercept: float
    slope: float
    scale: float
    n: int
    iterations: int
    converged: bool
    sums: tuple[float, float, float]  # weighted 1, x, x^2, where x counts from ``centre``
    centre: float = 0.0

    def band(self, df: DataFrame, x: str = "x", z: float = 1.959963984540054) -> DataFrame:
        """Fit and 95 % band at the values of ``x``."""
        w, wx, wxx = self.sums
        det = w * wxx - wx * wx
        at, off = F.col(x), F.col(x) - F.lit(self.centre)
        fit = F.lit(self.intercept) + F.lit(self.slope) * at
        se = F.lit(self.scale) * F.sqrt((F.lit(wxx) - 2.0 * wx * off + F.lit(w) * off * off) / det)
        return df.select(at.alias("x"), fit.alias("fit"), (fit - z * se).alias("conf_low"),
                         (fit + z * se).alias("conf_high"))


# ------------------------------------------------------------------ selection

def ordered_bits(c: Column) -> Column:
    """The 64 bits of a number that is not negative, as a whole number; exact, and in the same order."""
    guess = F.greatest(F.lit(-1022), F.floor(F.log2(F.when(c > 0, c))))
    power = F.pow(F.lit(2.0), guess)
    exponent = F.greatest(F.lit(-1022), guess + F.when(c < power, -1).when(c / 2 >= power, 1).otherwise(0))
    part = c / F.pow(F.lit(2.0), exponent)  # 1 and more, but for numbers below the normal ones
    whole = (part * float(1 << 52)).cast("long") + (exponent + 1022).cast("long") * F.lit(1 << 52)
    return F.coalesce(whole, F.lit(0).cast("long"))


def number_of(bits: int) -> float:
    return struct.unpack("<d", struct.pack("<q", int(bits)))[0]


def _bin_of(counts: np.ndarray, rank: int) -> tuple[int, int]:
    """Which bin holds the row of this rank (from 0), and how many rows come before the bin."""
    ends = np.cumsum(counts)
    at = int(np.searchsorted(ends, rank, side="right"))
    return at, int(ends[at] - counts[at])


def value_at_rank(df: DataFrame, key: str, rank: int, prefix: int = 0, shift: int = 64) -> int:
    """The key of a rank (from 0) among keys that begin with ``prefix`` above ``shift`` bits.

    Every pass counts the rows by their next ``DIGIT`` bits and goes on with one bin. A bin of few
    rows, or of one value, is looked at directly.
    """
    rows = df if shift == 64 else df.filter(F.shiftright(key, shift) == prefix)
    while shift:
        shift = max(0, shift - DIGIT)
        bins = sorted((r.bin, r.n, r.low, r.high) for r in rows.groupBy(F.shiftright(key, shift).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect())
        at, before = _bin_of(np.array([b[1] for b in bins]), rank)
        prefix, n, low, high = bins[at]
        rank -= before
        rows = df.filter(F.shiftright(key, shift) == prefix)
        if low == high:
            return low
        if n <= FEW:
            break
    return sorted(r[0] for r in rows.select(key).collect())[rank]


def exact_median(df: DataFrame, c: str) -> float:
    """Median of a column of numbers that are not negative, without sorting it or holding it in one task."""
    rows = df.filter(F.col(c).isNotNull()).select(ordered_bits(F.col(c)).alias("key"))
    n = rows.count()
    if not n:
        return float("nan")
    low = value_at_rank(rows, "key", (n - 1) // 2)
    high = low if n % 2 else value_at_rank(rows, "key", n // 2)
    return (number_of(low) + number_of(high)) / 2


# ------------------------------------------------------------------------ fit

_SUMS = ["w", "wx", "wy", "wxx", "wxy"]


def _terms(factor: Column) -> list[Column]:
    a, b = F.col("x"), F.col("y")
    return [factor, factor * a, factor * b, factor * a * a, factor * a * b]


def _solve(s: np.ndarray) -> tuple[float, float]:
    w, wx, wy, wxx, wxy = s
    slope = (w * wxy - wx * wy) / (w * wxx - wx * wx)
    return (wy - slope * wx) / w, slope


def _weighted(rows: DataFrame, intercept: float, slope: float, n: int, k: float) -> tuple[float, np.ndarray, float]:
    """Scale of the residuals, Huber-weighted sums, sum of squared residuals."""
    left = F.abs(F.col("y") - (F.lit(intercept) + F.lit(slope) * F.col("x")))
    seen = rows.select("x", "y", left.alias("r")).withColumn("key", ordered_bits(F.col("r")))
    inverse = F.when(F.col("r") > 0, 1 / F.col("r")).otherwise(F.lit(0.0))
    shift = 64 - DIGIT
    bins = sorted(tuple(r) for r in seen.groupBy(F.shiftright("key", shift).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"), F.sum(F.col("r") ** 2).alias("rr"),
        *[F.sum(t).alias(f"p{i}") for i, t in enumerate(_terms(F.lit(1.0)))], *[F.sum(t).alias(f"q{i}") for i, t in enumerate(_terms(inverse))]).collect())
    counts = np.array([b[1] for b in bins])

    def at_rank(rank: int) -> float:
        at, before = _bin_of(counts, rank)
        bin_, n_, low, high = bins[at][:4]
        return number_of(low if low == high else value_at_rank(seen, "key", rank - before, bin_, shift))

    scale = (at_rank((n - 1) // 2) + (at_rank(n // 2) if n % 2 == 0 else at_rank((n - 1) // 2))) / 2 / MAD_TO_SD
    limit = k * scale
    total = np.zeros(len(_SUMS))
    for _, _, low, high, _, *sums in bins:
        plain, over = np.array(sums[:5]), np.array(sums[5:])
        if number_of(high) <= limit:
            total += plain
        elif number_of(low) > limit:
            total += limit * over
        else:  # the one bin that the limit cuts
            weight = F.when(F.col("r") <= limit, F.lit(1.0)).otherwise(F.lit(limit) * inverse)
            total += np.array(seen.filter(F.col("key").between(low, high)).agg(*[F.sum(t) for t in _terms(weight)]).first())
    return scale, total, float(sum(b[4] for b in bins))


def huber_line(df: DataFrame, x: str, y: str, k: float = HUBER_K, max_iterations: int = 20,
               tolerance: float = 1e-4) -> Line:
    """Iteratively reweighted least squares from the least-squares line.

    The rows are written once, taken from their means; a step is one aggregation into bins and a
    second look at two of them, and only sums reach the driver.
    """
    plain = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    n, mean_x, mean_y = plain.agg(F.count(F.lit(1)), F.avg("x"), F.avg("y")).first()
    if n < 2:
        raise ValueError("a line needs two complete rows")
    rows = stable(plain.select((F.col("x") - F.lit(mean_x)).alias("x"), (F.col("y") - F.lit(mean_y)).alias("y")))
    total = np.array(rows.agg(*[F.sum(t) for t in _terms(F.lit(1.0))]).first())
    intercept, slope = _solve(total)
    scale, used, converged, step = 0.0, total, False, 0
    for step in range(1, max_iterations + 1):
        scale, weighted, squares = _weighted(rows, intercept, slope, n, k)
        if scale == 0:
            converged = True
            break
        used = weighted
        new_intercept, new_slope = _solve(used)
        # change of the residuals is linear in x, so its size follows from the plain sums
        d0, d1 = new_intercept - intercept, new_slope - slope
        change = d0 * d0 * n + 2 * d0 * d1 * total[1] + d1 * d1 * total[3]
        intercept, slope = new_intercept, new_slope
        if (max(change, 0.0) / max(1e-20, squares)) ** 0.5 <= tolerance:
            converged = True
            break
    return Line(float(intercept + mean_y - slope * mean_x), float(slope), float(scale), n, step, converged,
                (float(used[0]), float(used[1]), float(used[3])), mean_x)


def line_table(spark: SparkSession, line: Line) -> DataFrame:
    return spark.range(1).select(
        F.lit(line.intercept).alias("intercept"), F.lit(line.slope).alias("slope"),
        F.lit(line.scale).alias("scale"), F.lit(line.n).cast("long").alias("n"),
        F.lit(line.iterations).alias("iterations"), F.lit(line.converged).alias("converged"))
