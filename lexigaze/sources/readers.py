"""Readers. Every schema is given, none is inferred from the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from lexigaze.sources.schemas import COSINES, RELIABILITY


def read_tab_report(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Tab-separated tracker reports in which no text stands for "missing".

    The CSV reader turns an empty field into NULL; here it stays an empty string, and only
    a line that ends early has missing fields. Numbers that do not parse become NULL.
    Every file has a header of its own, its first line, and its columns are found by their
    names there: files may differ in order and in further columns. A file without a wanted
    column is an error. Files can still be cut and read by many tasks.
    """
    lines = spark.read.text(path).select(
        F.rtrim(F.col("value"), F.lit("\r")).alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    # rows of a file's first block are numbered in order, so its least number is the header
    headers = (lines.filter(F.col("start") == 0).withColumn("number", F.monotonically_increasing_id())
               .groupBy("file").agg(F.min_by("line", "number").alias("header")))
    names = F.split("header", "\t")
    places = [F.array_position(names, f.name) for f in schema.fields]
    absent = F.filter(F.array(*[F.lit(f.name) for f in schema.fields]), lambda c: ~F.array_contains(names, c))
    checked = F.when(F.size(absent) > 0, F.raise_error(F.concat_ws(" ", F.col("file"), F.lit("lacks"), absent))).otherwise(F.array(*places))
    headers = headers.select("file", "header", checked.cast("array<int>").alias("places"))

    def field(i, f):
        raw = F.get(F.col("fields"), F.get("places", F.lit(i)) - 1)
        return (raw if isinstance(f.dataType, StringType) else raw.try_cast(f.dataType)).alias(f.name)

    body = lines.join(headers, "file").filter(F.col("line") != F.col("header")).select("places", F.split("line", "\t", -1).alias("fields"))
    return body.select(*[field(i, f) for i, f in enumerate(schema.fields)])


def read_comma(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Comma-separated table with a header, matched by position; "NA" and empty are missing."""
    return spark.read.csv(path, header=True, schema=schema, nullValue="NA", enforceSchema=False)


def read_without_index(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated text table whose unnamed first column is a row number."""
    return spark.read.csv(path, header=True).drop("_c0")


def read_reliability(spark: SparkSession, path: str) -> DataFrame:
    """Words coded by two people; words the second coder could not place ("o") are left out."""
    return read_comma(spark, path, RELIABILITY).filter(F.col("new_utt_type") != "o")


def read_cosines(spark: SparkSession, path: str) -> DataFrame:
    return read_comma(spark, path, COSINES)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Columnar exchange table (Parquet)."""
    return spark.read.parquet(path)


def read_month(spark: SparkSession, path: str, month: str) -> DataFrame:
    """One month of a table written by month; other months are never opened."""
    df = spark.read.parquet(path)
    return df.withColumn("month", F.lpad(F.col("month").cast("string"), 2, "0")).filter(
        F.col("month") == month) if df.schema["month"].dataType != StringType() else df.filter(
        F.col("month") == month)


def read_months(spark: SparkSession, table: str, months: Sequence[str] | DataFrame) -> DataFrame:
    """Some months of a table kept by month and bucket; the folders of others are not opened.

    ``months`` is a list, or a filtered table with a column ``month``: then the folders are found when
    the query runs. The buckets stay as they are for joins by the bucket's column.
    """
    rows = spark.table(table)
    if isinstance(months, DataFrame):
        return rows.join(months.select("month").distinct(), "month", "left_semi")
    return rows.filter(F.col("month").isin(list(months)))
