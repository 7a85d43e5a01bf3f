"""Penalised regression spline from sums over the rows.

A cubic spline on equal steps has four non-zero basis functions at any place, so the normal
equations of a fit are some sixty sums, taken in one aggregation. What is solved afterwards is a
system of fixed size for each group: for a grid of penalties on the second differences of the
coefficients, the one of least generalised cross-validation error is kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from lexigaze.functions.nulls import natural_join

BASIS = 10
# penalties tried, as powers of ten of the weight of the data
PENALTIES = [x / 2 for x in range(-12, 5)]
Z = 1.959963984540054


def basis(x: Column, start: float, stop: float, size: int = BASIS) -> tuple[Column, list[Column]]:
    """Number of the first basis function that isn't zero at ``x``, and the values of four from there."""
    pieces = size - 3
    place = (x - F.lit(start)) / F.lit((stop - start) / pieces)
    piece = F.greatest(F.lit(0), F.least(F.lit(pieces - 1), F.floor(place))).cast("int")
    t = place - piece
    return piece, [(1 - t) ** 3 / 6, (3 * t ** 3 - 6 * t ** 2 + 4) / 6, (-3 * t ** 3 + 3 * t ** 2 + 3 * t + 1) / 6, t ** 3 / 6]


def _functions(x: Column, start: float, stop: float, size: int) -> Column:
    """All basis functions at ``x`` as one array."""
    piece, values = basis(x, start, stop, size)
    four = F.array(*values)
    return F.array(*[F.coalesce(F.get(four, F.lit(i) - piece), F.lit(0.0)) for i in range(size)])


def _solved(batches: Iterator[pd.DataFrame], group: list[str], size: int) -> Iterator[pd.DataFrame]:
    """Coefficients and their covariance for each row of normal equations; missing where they have no solution."""
    change = np.diff(np.eye(size), 2, axis=0)
    roughness = change.T @ change
    upper = np.triu_indices(size)
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            a = np.zeros((size, size))
            a[upper] = row.products
            a = a + a.T - np.diag(np.diag(a))
            b, best = np.array(row.loads), None
            for power in PENALTIES:
                m = a + row.weight * 10.0 ** power * roughness
                if not np.isfinite(m).all() or np.linalg.matrix_rank(m) < size:
                    continue
                inverse = np.linalg.inv(m)
                coefficients, freedom = inverse @ b, float(np.trace(inverse @ a))
                left = row.squares - 2 * coefficients @ b + coefficients @ a @ coefficients
                if row.weight > freedom:
                    score = row.weight * left / (row.weight - freedom) ** 2
                    if best is None or score < best[0]:
                        best = score, coefficients, inverse * left / (row.weight - freedom)
            keys = [getattr(row, g) for g in group]
            out.append((*keys, *((None, None) if best is None else (best[1].tolist(), best[2].ravel().tolist()))))
        yield pd.DataFrame(out, columns=[*group, "coefficients", "covariance"])


def fit_spline(points: DataFrame, group: Sequence[str], x: str, weight: str, total: str, squares: str,
               start: float, stop: float, size: int = BASIS) -> DataFrame:
    """(group, coefficients, covariance) from points that stand for ``weight`` rows with the given sums of y and y^2."""
    group = list(group)
    b = [F.col(f"_b{i}") for i in range(size)]
    listed = points.withColumn("_b", _functions(F.col(x).cast("double"), start, stop, size))
    rows = listed.select(*group, weight, total, squares, *[F.col("_b")[i].alias(f"_b{i}") for i in range(size)])
    sums = rows.groupBy(*group).agg(
        F.sum(weight).cast("double").alias("weight"), F.sum(squares).cast("double").alias("squares"),
        F.array(*[F.sum(F.col(weight) * b[i] * b[j]) for i in range(size) for j in range(i, size)]).alias("products"),
        F.array(*[F.sum(F.col(total) * b[i]) for i in range(size)]).alias("loads"))
    schema = StructType([*[points.schema[g] for g in group], StructField("coefficients", ArrayType(DoubleType())), StructField("covariance", ArrayType(DoubleType()))])
    return sums.mapInPandas(lambda batches: _solved(batches, group, size), schema)


def with_spline(points: DataFrame, group: Sequence[str], x: str, weight: str, total: str, squares: str,
                start: float, stop: float, size: int = BASIS) -> DataFrame:
    """Points with the fitted curve (``smooth``) and its 95 % band (``smooth_low``, ``smooth_high``)."""
    fitted = fit_spline(points, group, x, weight, total, squares, start, stop, size)
    joined = natural_join(points, fitted, "left", expect=list(group)).withColumn("_b", _functions(F.col(x).cast("double"), start, stop, size))
    level = F.aggregate(F.zip_with("_b", "coefficients", lambda a, c: a * c), F.lit(0.0), lambda s, v: s + v)
    variance = F.aggregate(F.sequence(F.lit(0), F.lit(size * size - 1)), F.lit(0.0), lambda s, k: s + F.get("covariance", k) * F.get(
        "_b", F.floor(k / size).cast("int")) * F.get("_b", k % size))
    reach = Z * F.sqrt(F.greatest(F.lit(0.0), F.when(F.col("covariance").isNotNull(), variance)))
    return joined.withColumn("smooth", level).withColumn("_reach", reach).withColumns(
        {"smooth_low": F.col("smooth") - F.col("_reach"), "smooth_high": F.col("smooth") + F.col("_reach")}).drop("_b", "_reach", "coefficients", "covariance")
