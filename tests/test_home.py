import math

from pyspark.sql import functions as F

from lexigaze.operators import home, merge, report
from lexigaze.sources.schemas import ANNOTATIONS


def ann(spark, *rows):
    return spark.createDataFrame([(s, m, f"{s}_{m}", av, *rest) for s, m, av, *rest in rows], ANNOTATIONS)


def test_recording_summary(spark):
    df = ann(spark,
             ("1", "06", "audio", "MOT", "d", "y", "ball"), ("1", "06", "audio", "MOT", "q", "n", "ball"),
             ("1", "06", "audio", "TVN", "d", "y", "cat"), ("1", "06", "audio", "CHI", "u", "y", None),
             ("1", "06", "audio", "CHI", None, None, "dog"),
             ("2", "06", "video", "FAT", None, "y", "books"))
    out = {r.subj: r for r in home.recording_summary(df).collect()}
    a, b = out["1"], out["2"]
    assert (a.numtokens, a.numspeakers, a.numtypes, a.CHItypes, a.CHI) == (5, 3, 4, 2, 2)
    assert (a.num_exp_tokens, a.num_exp_types, a.y_op, a.n_op, a.prop_op) == (2, 1, 3, 1, 0.75)
    assert a.prop_mom == 0.4 and a.prop_parent == 0.4 and a.tech == 1 and a.propd == 0.4
    assert math.isclose(a.ent_subj_av, -(2 / 3) * math.log2(2 / 3) - (1 / 3) * math.log2(1 / 3))
    assert a.sum_prop_ut == 0.6 and a.noun_chi_onset == 6.0 and a.posttalk is True
    # only "y" answers: the share is missing and becomes 0, not 1
    assert b.prop_op == 0.0 and b.y_op == 1 and b.prop_op_exp == 0.0
    assert b.ent_subj_av is None and b.noun_chi_onset is None and b.posttalk is False
    assert "TVN" not in a.asDict() and a.TOY == 0


def test_one_pass_equals_the_small_aggregates(spark):
    import random

    rng = random.Random(3)
    rows = [(str(rng.randrange(5)), rng.choice(["06", "07"]), rng.choice(["audio", "video"]),
             rng.choice(["MOT", "FAT", "CHI", "TOY", "TVB", "SIS", None]), rng.choice(["d", "i", "q", "r", "s", "n", "u", None]),
             rng.choice(["y", "n", None]), rng.choice(["ball", "books", "cat", "dog", None])) for _ in range(120)]
    df = ann(spark, *rows)
    wide = home.recording_summary(df)
    small = {"tested": home.tested_word_counts(df), "parents": home.parent_counts(df), "utt": home.utterance_counts(df),
             "presence": home.presence_share(df), "tested presence": home.presence_share(df, home.TESTED_WORDS),
             "child": home.child_counts(df), "types": home.child_types(df)}
    for name, part in small.items():
        values = [c for c in part.columns if c not in home.RECORDING]
        got = {tuple(r[k] for k in home.RECORDING): tuple(r[v] for v in values) for r in wide.collect()}
        want = {tuple(r[k] for k in home.RECORDING): tuple(r[v] or 0 for v in values) for r in part.collect()}
        for k, v in got.items():
            assert v == want.get(k, tuple(0 for _ in values)), (name, k)


def test_posttalk_edges(spark):
    df = spark.createDataFrame([("06", 7.0), ("07", 7.0), ("08", None), ("x", 7.0)], "m string, o double")
    assert [r[0] for r in df.select(home.after_onset(F.col("m"), F.col("o"))).collect()] == [False, True, False, None]


def test_checks_and_shares(spark):
    df = ann(spark, ("1", "06", "audio", "MOTH", "d", "y", "ball"), ("1", "06", "audio", "MOT", None, "y", "bat"),
             ("1", "06", "audio", "MOT", "u", "y", "cat"), ("1", "06", "audio", "MOT", "q", "y", "cat"))
    assert home.odd_speaker_codes(df).count() == 1 and home.missing_utterance_type(df).count() == 1
    assert [r[0] for r in home.words_starting_with(df, "b").collect()] == ["ball", "bat"]
    assert sorted((r.utterance_type, r.share) for r in home.utterance_shares(df).collect()) == [("d", 0.5), ("q", 0.5)]
    assert home.label_conflicts(df).count() == 0


def test_merge_masks_one_condition(spark):
    types = spark.createDataFrame(
        [("1", "06", "1_06", t, 2, 1, 0.5, v, 0.1, False) for t, v in (("between", 0.2), ("within", 0.1))]
        + [("2", "06", "2_06", "between", 1, 1, 0.5, 0.3, 0.1, False)],
        "subj string, month string, SubjectNumber string, trialtype string, numtrials long, numtrials_TT long, "
        "cross_item_mean_proptTT double, cross_item_mean_proptcorrTT double, cross_item_mean_proptpreTT double, outlier boolean")
    subjects = spark.createDataFrame([("1", "06", "1_06", 0.5, 0.15, 0.1, False), ("2", "06", "2_06", 0.5, 0.3, 0.1, False)],
                                     "subj string, month string, SubjectNumber string, cross_item_mean_propt double, "
                                     "cross_item_mean_proptcorr double, cross_item_mean_proptpre double, outlier boolean")
    rec = spark.createDataFrame([(s, "06", f"{s}_06", av, p, 0.1, 0.2, 0.3) for s, av, p in
                                 (("1", "audio", 0.4), ("1", "video", 0.6), ("2", "audio", 0.5), ("3", "audio", 0.9))],
                                "subj string, month string, SubjectNumber string, audio_video string, prop_op double, "
                                "prop_mom double, ent_subj_av double, propn double")
    merged = merge.lab_home(types, subjects, rec)
    got = {(r.subj, r.audio_video): (r.between, r.within, r.cross_item_mean_proptcorr) for r in merged.collect()}
    assert got == {("1", "audio"): (0.2, 0.1, 0.15), ("1", "video"): (0.2, 0.1, 0.15),
                   ("2", "audio"): (0.3, None, None), ("3", "audio"): (None, None, None)}
    pooled = merge.pooled_shares(merged).collect()
    assert [(r.subj, r.prop_op_avg) for r in pooled] == [("1", 0.5)]
    assert [tuple(r) for r in merge.audio_video_pairs(merged).collect()] == [("1", "1_06", 0.4, 0.6)]


def test_number_text(spark):
    df = spark.createDataFrame([(714.46,), (100.0,), (0.0,), (None,), (2.25,)], "v double")
    assert [r[0] for r in df.select(report.number_text("v", 1)).collect()] == ["714.5", "100", "0", "NA", "2.2"]


def test_summary_and_headings(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "a"), (None, None)], "v double, s string")
    row = report.column_summary(df).first()
    assert (row.n, row.missing, row.min, row.mean, row.max) == (3, 1, 1.0, 2.0, 3.0)
    assert sorted((r.level or "", r.n) for r in report.level_counts(df, ["s"]).collect()) == [("", 1), ("a", 2)]
    table = report.with_headings(spark.createDataFrame([("aud",) * 8], [f"c{i}" for i in range(8)]))
    assert table.columns[1:] == report.HEADINGS[1:]


def test_one_month_equals_that_month_of_all(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.choice(["1", "2", "3", None]), rng.choice(["05", "06", "07", "x", None]), f"label {rng.randrange(2)}", rng.choice(["audio", "video", None]),
             rng.choice(["MOT", "CHI", "TVB", "SIS", None]), rng.choice(["d", "q", "u", None]), rng.choice(["y", "n", None]),
             rng.choice(["ball", "cat", None])) for _ in range(400)]
    df = spark.createDataFrame(rows, ANNOTATIONS)
    whole = home.recording_summary(df)
    for month in ("05", "06", "07"):
        want = sorted(map(str, whole.filter(F.col("month") == month).collect()))
        assert sorted(map(str, home.recording_summary(df, month=month).collect())) == want and want
    distinct = {}
    for s, m, label, av, speaker, _, _, word in rows:
        distinct.setdefault((s, m, label, av), (set(), set(), set()))
        speakers, words, own = distinct[s, m, label, av]
        speakers.add(speaker), words.add(word), speaker == "CHI" and own.add(word)
    got = {(r.subj, r.month, r.SubjectNumber, r.audio_video): (r.numspeakers, r.numtypes, r.CHItypes) for r in whole.collect()}
    assert got == {k: tuple(map(len, v)) for k, v in distinct.items()}
