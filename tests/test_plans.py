"""What the plans of some queries must not hold: repeated scans, exchanges that a layout spares, rows made to be summed."""

import re

import pytest
from lexigaze.operators import correlation, gaze, home, looking, merge, report
from lexigaze.plans.study_tables import TESTED_BRANDS, StudyTables
from lexigaze.sources import readers

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return StudyTables(spark, FOLDER)


def plan(df):
    """The physical plan; with adaptive execution what was planned first."""
    return df._jdf.queryExecution().executedPlan().toString()


def count(df, node):
    return len(re.findall(rf"\b{node}\b", plan(df)))


def test_accounting_takes_few_exchanges(t):
    assert count(gaze.exclusion_totals(t.trials, total=5), "Exchange") <= 3
    assert "Join" not in plan(gaze.exclusion_totals(t.trials, total=5))
    assert count(gaze.window_without_pre(t.trials), "Exchange") <= 1 and count(gaze.no_pre_and_low(t.trials), "Exchange") <= 1


def test_timecourse_makes_no_bins(t):
    assert "Generate" not in plan(looking.timecourse(t.labelled))


def test_low_data_makes_no_bins_and_joins_nothing_to_itself(t):
    flat = plan(gaze.low_data_bins(t.labelled))
    assert "Generate" not in flat and flat.count("Scan parquet") == plan(t.labelled).count("Scan parquet")
    assert plan(gaze.with_low_data(t.labelled)).count("Scan parquet") == plan(t.labelled).count("Scan parquet")


def test_recordings_read_the_annotations_once(t):
    once = plan(t.annotations).count("Scan parquet")
    assert plan(home.recording_summary(t.annotations, TESTED_BRANDS)).count("Scan parquet") == once
    assert plan(home.recording_summary(t.annotations, TESTED_BRANDS, "06")).count("Scan parquet") == once
    assert plan(report.descriptives(t.recordings06)).count("Scan parquet") == once


def test_pearson_pairs_come_from_one_row(t):
    both = correlation.pearson_pairs(merge.by_medium(t.lab_home, "audio"), [("a", "numtokens", "numtypes"), ("b", "numtokens", "r"), ("c", "prop_op", "r")])
    assert "Generate" not in plan(both) and count(both, "Exchange") == 1


def test_buckets_join_without_a_shuffle_and_months_are_pruned(t, spark, tmp_path):
    spoken = readers.read_months(spark, t.spoken_words, ["06"])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spoken.join(spark.table(t.children), "subj", "left")
        text = plan(joined)
        assert "SortMergeJoin" in text and "Exchange hashpartitioning" not in text
        assert "PartitionFilters: [isnotnull(month" in text and joined.count() == spoken.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    spark.createDataFrame([("06", 3), ("07", 0)], "month string, n int").write.parquet(str(tmp_path / "months"))
    found = readers.read_months(spark, t.spoken_words, spark.read.parquet(str(tmp_path / "months")).filter("n > 1"))
    assert "dynamicpruning" in plan(found) and found.count() == spoken.count()


def test_scenarios_come_from_one_pass(t):
    words = looking.in_scenarios(t.counted, t.in_debt, "milk")
    one = plan(looking.without_item(t.counted, t.in_debt, "milk"))
    assert plan(words).count("Scan") == one.count("Scan")


def test_recordings_make_no_row_to_be_counted(t):
    for df in (t.recordings, t.recordings06):
        assert "Expand" not in plan(df) and "ObjectHashAggregate" not in plan(df)


def test_a_month_reads_on_only_its_words_and_own_words_of_the_child(t):
    flat = plan(t.recordings06)
    joins = [line for line in flat.split("\n") if "Join" in line]
    # the join with the parts comes last, above the one with the orders that drops the other words
    assert "= 06" not in joins[0] and any("= 06" in line and "= CHI" in line for line in joins[1:])
