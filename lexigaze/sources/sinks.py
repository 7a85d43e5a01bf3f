"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexigaze.session import scratch


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_by_month(df: DataFrame, path: str, files_per_month: int | None = None) -> None:
    """Table in folders by month, so that one month can be read alone.

    Without ``files_per_month`` tasks write what they hold. With it, rows are spread over
    that many files per month by hash of the row, so a heavy month is written by many
    tasks.
    """
    if files_per_month:
        slot = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_month))
        df = df.withColumn("_slot", slot).repartition("month", "_slot").drop("_slot")
    df.write.mode("overwrite").partitionBy("month").parquet(path)


def write_delimited(df: DataFrame, path: str, sep: str = ",", line_end: str = "\n") -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=True, lineSep=line_end)


def write_buckets(df: DataFrame, key: str, buckets: int, by_month: bool = True) -> str:
    """Save as a table cut into buckets by ``key``, inside folders by month; returns its name.

    Two tables with the same buckets join by the key without a shuffle. Rows are dealt by the key
    first, so each bucket of a month is one file.
    """
    path = scratch(df.sparkSession)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path)
    (writer.partitionBy("month") if by_month else writer).saveAsTable(name)
    return name
