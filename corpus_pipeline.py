"""A corpus made ready for training: documents through five stages, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexigaze.llm import decontamination, line_dedup, near_dedup, packing, quality_rules
from lexigaze.llm.common import documents, with_number, written


def _rows_that(docs: DataFrame, choose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that ``choose`` keeps, with all their columns.

    It sees the row's number as doc_id and returns those to keep, so rows that share an id, or have
    none, are decided on one by one.
    """
    rows, own = with_number(docs)
    kept = choose(rows.withColumn("doc_id", F.col(own))).select(F.col("doc_id").alias(own))
    return rows.join(kept, own, "left_semi").select(*docs.columns)


def pass_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return _rows_that(docs, lambda rows: quality_rules.judge(rows).where("kept"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines kept elsewhere; n_chars follows the text."""
    return line_dedup.without_repeated_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near-duplicates: the one of least id, one without an id only where there is no other."""
    rows, own = with_number(docs)
    classes = near_dedup.near_classes(rows.withColumn("doc_id", F.col(own))).withColumnRenamed("doc_id", own)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", own)
    heads = classes.join(rows.select(own, "doc_id"), own).groupBy("class_id").agg(F.min(order).alias("head")).select(F.col(f"head.{own}").alias(own))
    return rows.join(heads, own, "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without too many words of benchmark items."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _rows_that(docs, lambda rows: decontamination.decontaminate(rows, benchmark).where("NOT contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", pass_quality_rules),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each_class),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# Packing and near-duplicate classes have no SQL twin; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
