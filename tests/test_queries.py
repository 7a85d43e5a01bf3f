"""Every registered query next to its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from compare import compare, connect
from lexigaze.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


# the plain SQL of these needs more than a handful of infants per group
LARGER = {"cor_outcome", "outcome_normality", "bootstrap_presence", "bootstrap_types", "huber_presence", "presence_band", "inline_results", "scenario_normality"}
LARGER_FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(catalog.REGISTRY) <= set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(set(contract.oracle_sql()) & set(catalog.REGISTRY)))
def test_matches_sql(spark, con, name):
    folder = LARGER_FOLDER if name in LARGER else FOLDER
    con = connect(folder) if name in LARGER else con
    problem, _ = compare(contract.queries()[name](spark, folder), con, contract.oracle_sql()[name])
    assert not problem or problem.startswith("~"), problem


def test_entry(spark):
    assert contract.entry(spark).count() > 0
