"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexigaze.llm.common import written


ROWS = 200_000  # rows of edges a task may hold


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s")).first()
    return row.n, row.s or 0


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node that isn't the least of its component, from edges (u, v) of numbers.

    Each round hangs neighbours on the least one they know, first upwards, then downwards; rounds
    grow with the logarithm of the longest chain. A node with many neighbours is never collected:
    its least neighbour is a partial minimum, and the joins deal both sides out by node. A round's
    results are written by as many tasks as its rows ask for.
    """
    edges = written(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(edges)
    while mark[0]:
        tasks = -(-2 * mark[0] // ROWS)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().coalesce(tasks))
        joined = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")  # by now a node has few lesser neighbours
        small = joined.select("u", F.col("m").alias("v")).unionByName(
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        edges = written(small.coalesce(tasks))
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select("u", F.col("v").alias("root"))
