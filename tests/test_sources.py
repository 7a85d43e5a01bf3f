import os

import pytest

from lexigaze.sources import readers, sinks
from lexigaze.sources.schemas import MESSAGES


def write(path, text):
    with open(path, "w", newline="") as f:
        f.write(text)
    return str(path)


def test_tab_report_keeps_empty_text(spark, tmp_path):
    text = ("TRIAL_INDEX\tRECORDING_SESSION_LABEL\tCURRENT_MSG_TIME\tCURRENT_MSG_TEXT\tRT\r\n"
            "1\t01_06\t12.5\t\t.\r\n2\tNA\t.\tx\t7\r\n3\tshort\r\n")
    out = readers.read_tab_report(spark, write(tmp_path / "r.xls", text), MESSAGES).orderBy("TRIAL_INDEX").collect()
    assert [tuple(r) for r in out] == [("01_06", 1, 12.5, "", "."), ("NA", 2, None, "x", "7"),
                                       ("short", 3, None, None, None)]


def test_reports_with_headers_of_their_own(spark, tmp_path):
    write(tmp_path / "a.txt", "TRIAL_INDEX\tRECORDING_SESSION_LABEL\tCURRENT_MSG_TIME\tCURRENT_MSG_TEXT\tRT\n1\t01_06\t12.5\tx\t.\n")
    write(tmp_path / "b.txt", "extra\tRT\tCURRENT_MSG_TEXT\tCURRENT_MSG_TIME\tRECORDING_SESSION_LABEL\tTRIAL_INDEX\n\t7\ty\t3\t02_06\t2\nq\t8\tz\t4\t02_06\t3\n")
    out = sorted(tuple(r) for r in readers.read_tab_report(spark, str(tmp_path), MESSAGES).collect())
    assert out == [("01_06", 1, 12.5, "x", "."), ("02_06", 2, 3.0, "y", "7"), ("02_06", 3, 4.0, "z", "8")]


def test_a_report_without_a_wanted_column_is_an_error(spark, tmp_path):
    write(tmp_path / "a.txt", "TRIAL_INDEX\tRECORDING_SESSION_LABEL\tCURRENT_MSG_TIME\tCURRENT_MSG_TEXT\tRT\n1\t01_06\t12.5\tx\t.\n")
    write(tmp_path / "b.txt", "TRIAL_INDEX\tRT\n1\t2\n")
    with pytest.raises(Exception, match="lacks RECORDING_SESSION_LABEL CURRENT_MSG_TIME CURRENT_MSG_TEXT"):
        readers.read_tab_report(spark, str(tmp_path), MESSAGES).collect()


def test_many_tasks_read_a_report(spark, tmp_path):
    lines = "TRIAL_INDEX\tRECORDING_SESSION_LABEL\tCURRENT_MSG_TIME\tCURRENT_MSG_TEXT\tRT\n" + "".join(f"{i}\ts\t{i}\tx\t.\n" for i in range(5000))
    path = write(tmp_path / "r.txt", lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        out = readers.read_tab_report(spark, path, MESSAGES)
        assert sorted(r.TRIAL_INDEX for r in out.collect()) == list(range(5000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_numbered_table_with_old_line_ends(spark, tmp_path):
    text = ',Measure,Lab Only\r1,All Words,"M=9.43 (16.57), R: 0-75"\r2,Motor,0%'
    out = readers.read_without_index(spark, write(tmp_path / "t.csv", text)).collect()
    assert [tuple(r) for r in out] == [("All Words", "M=9.43 (16.57), R: 0-75"), ("Motor", "0%")]


def test_reliability_drops_unclear_words(spark, tmp_path):
    text = ("file,ordinal,onset,offset,word,orig_utt_type,orig_present,new_utt_type,new_present\n"
            "1_06,1,10,20,ball,d,y,d,y\n1_06,2,30,40,cat,d,n,o,o\n1_06,3,50,60,dog,q,n,NA,n\n")
    out = readers.read_reliability(spark, write(tmp_path / "v.csv", text)).collect()
    assert [(r.ordinal, r.onset, r.new_utt_type) for r in out] == [(1, 10, "d")]


def test_month_folders_are_pruned(spark, tmp_path):
    df = spark.createDataFrame([("06", 1), ("07", 2), ("06", 3)], "month string, v int")
    path = str(tmp_path / "t")
    sinks.write_by_month(df, path, files_per_month=2)
    assert sorted(d for d in os.listdir(path) if d.startswith("month")) == ["month=06", "month=07"]
    out = readers.read_month(spark, path, "06")
    assert sorted(r.v for r in out.collect()) == [1, 3]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    sinks.write_table(df, str(tmp_path / "p"))
    assert readers.read_table(spark, str(tmp_path / "p")).count() == 3
    sinks.write_delimited(df, str(tmp_path / "c"), sep="\t")
    assert spark.read.csv(str(tmp_path / "c"), sep="\t", header=True).count() == 3
