"""The registered queries next to their SQL, and the shape of every one of them."""

import __spark_entry__ as contract
import pytest
from compare import compare, connect
from lexigaze.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    problem, n = compare(contract.queries()[name](spark, FOLDER), connect(FOLDER), contract.oracle_sql()[name])
    assert n and (not problem or problem.startswith("~")), problem


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries.REGISTRY}
    assert {*queries.REGISTRY, "pipeline"} <= set(contract.queries())


@pytest.mark.parametrize("name", ["op1_secret_scan", "op2_repeated_substrings", "op4_near_dedup"])
def test_one_row_per_document(spark, name):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert queries.REGISTRY[name](spark, FOLDER).select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
