"""Bootstrap of a statistic with the four usual intervals.

Every random number is a hash of what it decides about: the seed, the replicate, and a node of a
tree or the number of a pick. So no draw depends on how rows are dealt to tasks, and any task finds
out by itself what belongs to it.

The rows stand in a fixed order and are cut into blocks of equal size. How many of a replicate's n
picks fall into a block is found by going down a binary tree over the blocks: at each node the
picks split in two by a binomial draw, which is the multinomial law over the blocks. Inside a block
each pick chooses a row. What leaves a task is one row of weighted sums for each replicate; the
statistic is an expression over these sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexigaze.functions.nulls import attach
from lexigaze.functions.special import normal_cdf, normal_quantile, num
from lexigaze.operators.ranks import running_total

BLOCK_ROWS = 512
MOST_BLOCKS, TASKS = 4096, 64  # blocks one task may hold; tasks that are wanted at least
CELLS = 1 << 21  # numbers of a table made at once inside a task
TINY = 1e-12  # a weighted variance below this part of the mean square is rounding

# Increments and multipliers of a 64-bit mixing function.
GOLDEN, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_WORD = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(FIRST)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(SECOND)
    return x ^ (x >> np.uint64(31))


def _step(x: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """The next number after the k-th increment of each ``x``."""
    return _mix(x + (np.uint64(k * GOLDEN & _WORD) if isinstance(k, int) else k.astype(np.uint64) * np.uint64(GOLDEN)))


def _unit(h: np.ndarray) -> np.ndarray:
    """The upper 53 bits as a number in [0, 1)."""
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def binomial_quantile(k: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """Least number of hits among ``k`` trials whose distribution function reaches ``u``.

    Probabilities are products of ratios within nine deviations of the mean, where all but 1e-17
    of the law lies.
    """
    out = np.zeros(len(k), np.int64)
    reach = 9 * np.sqrt(k * p * (1 - p)) + 12
    low, high = np.maximum(0, np.floor(k * p - reach)), np.minimum(k, np.ceil(k * p + reach))
    width = int((high - low).max(initial=0)) + 1
    for at in range(0, len(k), max(1, CELLS // width)):
        part = slice(at, at + max(1, CELLS // width))
        x = low[part, None] + np.arange(1, width)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(x <= high[part, None], (k[part, None] - x + 1) / x * (p / (1 - p)), 0.0)
            log = np.concatenate((np.zeros((len(x), 1)), np.cumsum(np.log(ratio), axis=1)), axis=1)
        mass = np.cumsum(np.exp(log - log.max(1, keepdims=True)), axis=1)
        out[part] = np.minimum(low[part] + (mass < u[part, None] * mass[:, -1:]).sum(1), high[part])
    return out


def _shares(blocks: np.ndarray, n: int, block_rows: int, start: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the sorted ``blocks`` the picks of every replicate, by the tree of splits."""
    def rows(a: int, b: int) -> int:
        return min(b * block_rows, n) - a * block_rows

    waiting = [(0, -(-n // block_rows), np.full(len(start), n, np.int64))]
    while waiting:
        a, b, picks = waiting.pop()
        if np.searchsorted(blocks, a) == np.searchsorted(blocks, b):
            continue
        if b - a == 1:
            yield a, picks
            continue
        middle = (a + b) // 2
        u = _unit(_step(_step(start, 2 * a + 1), 2 * b + 1))
        left = binomial_quantile(picks, rows(a, middle) / rows(a, b), u)
        waiting += [(middle, b, picks - left), (a, middle, left)]


def _chosen(picks: np.ndarray, size: int, start: np.ndarray, block: int) -> np.ndarray:
    """How often each replicate picks each of the block's ``size`` rows: replicates x rows."""
    rep = np.repeat(np.arange(len(picks)), picks)
    number = np.arange(len(rep)) - np.repeat(np.cumsum(picks) - picks, picks)
    own = _step(start, 2 * block + 2)
    row = (_unit(_step(own[rep], number + 1)) * size).astype(np.int64)
    return np.bincount(rep * size + row, minlength=len(picks) * size).reshape(len(picks), size)


def bootstrap(df: DataFrame, columns: Sequence[str], features: Mapping[str, Column], value: Column,
              reps: int = 1000, seed: int = 1, block_rows: int | None = None) -> DataFrame:
    """``reps`` bootstrap values of a statistic: (rep, t). Rows with a missing value are left out.

    ``features`` are numbers of a row, expressions over ``columns``; ``value`` is an expression
    over their sums over the picked rows, under the same names, and ``n``, the number of rows. The
    draw depends on the seed and the values of ``columns`` only. Equal rows are folded; a value
    however frequent is cut at the ends of the blocks it fills.
    """
    columns, names, block_rows = list(columns), list(features), block_rows or BLOCK_ROWS
    complete = df.select(*columns).dropna()
    n = complete.count()
    cells = complete.groupBy(*columns).agg(F.count(F.lit(1)).alias("_w"))
    placed = running_total(cells, [], columns, "_w", "_at").withColumn(
        "_block", F.explode(F.expr(f"sequence(_at div {block_rows}, (_at + _w - 1) div {block_rows})")))
    run = max(1, min(MOST_BLOCKS, -(-n // block_rows) // TASKS))
    pieces = placed.select(
        (F.col("_block") / run).cast("long").alias("_run"), "_block", F.greatest("_at", F.col("_block") * block_rows).alias("_from"),
        F.least(F.col("_at") + F.col("_w"), (F.col("_block") + 1) * block_rows).alias("_to"),
        *[c.cast("double").alias(f"_f{i}") for i, c in enumerate(features.values())])

    def sums(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("_from")
        block, first, last = (table.column(c).to_numpy() for c in ("_block", "_from", "_to"))
        values = np.column_stack([np.ones(table.num_rows), *[table.column(f"_f{i}").to_numpy() for i in range(len(names))]])
        start = _step(np.full(reps, seed * GOLDEN & _WORD, np.uint64), np.arange(1, reps + 1))
        total = np.zeros((reps, len(names) + 1))
        for b, picks in _shares(np.unique(block), n, block_rows, start):
            here = slice(*np.searchsorted(block, [b, b + 1]))
            rows = np.repeat(values[here], last[here] - first[here], axis=0)
            for at in range(0, reps, max(1, CELLS // len(rows))):
                part = slice(at, at + max(1, CELLS // len(rows)))
                total[part] += _chosen(picks[part], len(rows), start[part], b) @ rows
        return pa.table({"rep": pa.array(np.arange(1, reps + 1, dtype=np.int32)), **{f"s{i}": total[:, i] for i in range(len(names) + 1)}})

    moments = pieces.groupBy("_run").applyInArrow(sums, "rep int, " + ", ".join(f"s{i} double" for i in range(len(names) + 1)))
    added = moments.groupBy("rep").agg(*[F.sum(f"s{i}").alias(name) for i, name in enumerate(["n", *names])])
    return added.select("rep", value.alias("t"))


# ------------------------------------------------------- statistics of sums

def correlation_sums(x: str, y: str) -> tuple[dict[str, Column], Column]:
    """Pearson's r from sums; x and y should be taken from their means before."""
    a, b, n = F.col(x), F.col(y), F.col("n")
    cov = F.col("xy") - F.col("x") * F.col("y") / n
    vx, vy = F.col("xx") - F.col("x") ** 2 / n, F.col("yy") - F.col("y") ** 2 / n
    varies = (vx > TINY * F.col("xx")) & (vy > TINY * F.col("yy"))
    return {"x": a, "y": b, "xx": a * a, "yy": b * b, "xy": a * b}, F.when(varies, cov / F.sqrt(vx * vy))


def ratio_sums(x: str, y: str) -> tuple[dict[str, Column], Column]:
    """Sum of y to sum of x."""
    return {"x": F.col(x), "y": F.col(y)}, F.try_divide(F.col("y"), F.col("x"))


def jackknife_acceleration(df: DataFrame, x: str, y: str) -> DataFrame:
    """BCa acceleration of Pearson's r from leave-one-out values, one row.

    Leaving a row out changes the five sums by that row only, so every leave-one-out r is
    arithmetic on the totals.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    centre = rows.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    c = attach(rows, centre, []).select((F.col("x") - F.col("mx")).alias("x"),
                                        (F.col("y") - F.col("my")).alias("y"))
    sums = c.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") ** 2).alias("xx"),
                 F.sum(F.col("y") ** 2).alias("yy"), F.sum(F.col("x") * F.col("y")).alias("xy"))
    a, b, m = F.col("x"), F.col("y"), F.col("n") - 1
    grow = 1 + 1 / m
    loo = attach(c, sums, []).select("n", F.try_divide(
        F.col("xy") - a * b * grow,
        F.sqrt((F.col("xx") - a * a * grow) * (F.col("yy") - b * b * grow))).alias("r"))
    mean = loo.agg(F.avg("r").alias("mr"))
    d = F.col("mr") - F.col("r")
    return attach(loo, mean, []).agg(
        (F.try_divide(F.sum(d ** 3), 6 * F.pow(F.sum(d ** 2), F.lit(1.5)))).alias("acceleration"))


def bootstrap_intervals(values: DataFrame, observed: DataFrame, acceleration: DataFrame | None = None,
                        level: float = 0.95) -> DataFrame:
    """Normal, basic, percentile and BCa intervals: (method, estimate, conf_low, conf_high).

    ``values`` are the bootstrap values, ``observed`` the statistic of the data (one row,
    column ``t0``). There are as many values as replicates, so they fit one array. Order
    statistics number (reps + 1) * p are interpolated on the normal scale.
    """
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    z = num(NormalDist().inv_cdf(hi))
    one = values.filter(F.col("t").isNotNull()).agg(
        F.count("t").cast("int").alias("reps"), F.avg("t").alias("mean"), F.stddev_samp("t").alias("sd"),
        F.array_sort(F.collect_list("t")).alias("v"))
    row = attach(one, observed.select("t0"), [])
    row = attach(row, acceleration, []) if acceleration is not None else row.withColumn(
        "acceleration", F.lit(None).cast("double"))
    row = row.withColumn("z0", normal_quantile("size(filter(v, x -> x < t0)) / reps"))

    # one row per wanted order statistic
    def wanted(name: str, shift: str, p: float) -> Column:
        adjusted = f"z0 + (z0 {shift} {z}) / (1 - acceleration * (z0 {shift} {z}))"
        return F.struct(F.lit(name).alias("name"), F.lit(p).alias("plain"), F.expr(adjusted).alias("zp"))

    points = row.select("v", "reps", F.explode(F.array(wanted("low", "-", lo), wanted("high", "+", hi))).alias("s"))
    points = points.select("v", "reps", "s.*").withColumn("bca", normal_cdf("zp"))
    points = points.select("v", "reps", F.explode(F.array(
        F.struct(F.concat("name", F.lit("_plain")).alias("name"), F.col("plain").alias("p")),
        F.struct(F.concat("name", F.lit("_bca")).alias("name"), F.col("bca").alias("p")))).alias("s"))
    points = points.select("v", "reps", "s.*").withColumn(
        "k", F.expr("greatest(1, least(reps - 1, CAST(floor((reps + 1) * p) AS INT)))"))
    points = points.withColumn("zp", normal_quantile("p")).withColumn(
        "zl", normal_quantile("k / (reps + 1)")).withColumn("zh", normal_quantile("(k + 1) / (reps + 1)"))
    found = points.select("name", F.expr(
        "v[k - 1] + (v[k] - v[k - 1]) * (zp - zl) / (zh - zl)").alias("value"))
    names = ["low_plain", "high_plain", "low_bca", "high_bca"]
    bounds = found.agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])

    t0, reach = F.col("t0"), F.expr(f"{z} * sd")
    centre = 2 * t0 - F.col("mean")
    kinds = [("normal", centre - reach, centre + reach),
             ("basic", 2 * t0 - F.col("high_plain"), 2 * t0 - F.col("low_plain")),
             ("percent", F.col("low_plain"), F.col("high_plain")), ("bca", F.col("low_bca"), F.col("high_bca"))]
    return attach(row.drop("v"), bounds, []).select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("method"), t0.alias("estimate"), low.alias("conf_low"),
                 high.alias("conf_high")) for name, low, high in kinds])).alias("ci")).select("ci.*")


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna()


def bootstrap_correlation(df: DataFrame, x: str, y: str, reps: int = 1000, seed: int = 1, level: float = 0.95) -> DataFrame:
    """Bootstrap intervals of Pearson's r; sums are taken from the means, so a large mean costs no digits."""
    pairs = _pairs(df, x, y)
    centre = pairs.agg(F.avg("_x").alias("_mx"), F.avg("_y").alias("_my")).first()
    centred = pairs.select((F.col("_x") - F.lit(centre[0])).alias("_x"), (F.col("_y") - F.lit(centre[1])).alias("_y"))
    features, value = correlation_sums("_x", "_y")
    values = bootstrap(centred, ["_x", "_y"], features, value, reps, seed)
    observed = centred.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in features.items()]).select(value.alias("t0"))
    return bootstrap_intervals(values, observed, jackknife_acceleration(pairs, "_x", "_y"), level)


def bootstrap_ratio(df: DataFrame, x: str, y: str, reps: int = 1000, seed: int = 1, level: float = 0.95) -> DataFrame:
    """Bootstrap intervals of the ratio of two sums, without the one that needs an acceleration."""
    pairs = _pairs(df, x, y)
    features, value = ratio_sums("_x", "_y")
    values = bootstrap(pairs, ["_x", "_y"], features, value, reps, seed)
    observed = pairs.agg(F.sum("_x").alias("x"), F.sum("_y").alias("y")).select(value.alias("t0"))
    return bootstrap_intervals(values, observed, None, level).where("method <> 'bca'")
