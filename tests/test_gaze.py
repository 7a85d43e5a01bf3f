import pytest
from pyspark.sql import functions as F

from lexigaze.operators import gaze, looking
from lexigaze.operators.outliers import flag_outliers, without_outliers

FIX = gaze.BIN_COLUMNS + ["practice", "fix_start", "fix_end"]


def fixation(label="01_06", area="TARGET", trial=1, start=0.0, end=100.0, **kw):
    row = dict(RECORDING_SESSION_LABEL=label, CURRENT_FIX_INTEREST_AREA_LABEL=area, TRIAL_INDEX=trial, RT=900.0,
               TRIAL_START_TIME=0.0, audiotarget="can_ball.wav", carrier="can", distractorimage="car.jpg",
               targetimage="ball.jpg", distractorloc="[960,512]", targetloc="[320,512]", pair="car_ball",
               targetside="L", trial=str(trial), trialtype="between", practice="n", fix_start=start, fix_end=end)
    return {**row, **kw}


def make(spark, fixations, onsets):
    from lexigaze.sources.schemas import FIXATIONS, MESSAGES

    f = spark.createDataFrame([tuple(r[c] for c in FIXATIONS.names) for r in fixations], FIXATIONS)
    m = spark.createDataFrame([(l, t, o, gaze.ONSET_MESSAGE, "900") for l, t, o in onsets]
                              + [("01_06", 1, 1.0, "OTHER", "x")], MESSAGES)
    return f, m


def test_bins_are_half_open(spark):
    df = spark.createDataFrame([(1, 0.0, 40.0), (2, 1.0, 41.0), (3, 5.0, 9.0), (4, 40.0, 40.0)],
                               "id int, fix_start double, fix_end double")
    out = gaze.bin_fixations(df, ["id"]).orderBy("id", "timeBin").collect()
    assert [(r.id, r.timeBin, r.Time) for r in out] == [(1, 0, 0.0), (1, 1, 20.0), (2, 1, 20.0), (2, 2, 40.0)]


@pytest.fixture(scope="module")
def study(spark):
    on = dict(start=2000.0, area="TARGET")
    rows = [
        fixation(trial=1, start=0.0, end=1000.0), fixation(trial=1, end=2000.0 + 77 * 20, **on),
        fixation(trial=2, start=0.0, end=1000.0, area="DISTRACTOR"), fixation(trial=2, end=2000.0 + 78 * 20, **on),
        fixation(trial=3, start=0.0, end=900.0),                       # baseline only
        fixation(trial=4, end=6000.0, **on),                           # window only
        fixation(trial=5, area=".", start=2000.0, end=6000.0), fixation(trial=5, start=0.0, end=90.0),
        fixation(trial=6, start=0.0, end=6000.0, trial_="p", ), fixation(label="ns01", trial=1, start=0.0, end=6000.0),
        fixation(label="21_12_2", trial=1, start=0.0, end=6000.0, area=None),
        fixation(trial=7, start=0.0, end=400.0, audiotarget=None),
        fixation(trial=8, start=0.0, end=400.0), fixation(trial=9, start=0.0, end=400.0, trialtype="."),
        fixation(trial=36, start=0.0, end=6000.0),
    ]
    rows[8]["trial"] = "p4"
    onsets = [("01_06", t, 1000.0) for t in (1, 2, 3, 4, 5, 6, 7, 9, 36)] + [("ns01", 1, 1010.0), ("21_12_2", 1, 1000.0)]
    return make(spark, rows, onsets)


def test_low_data_needs_78_bins(study):
    facts = {(r.SubjectNumber, r.TrialNumber): r.lowdata for r in
             gaze.trial_facts(gaze.label_fixations(gaze.drop_aborted(study[0]), gaze.key_press_messages(study[1]))).collect()}
    assert facts[("01_06", 1)] is True and facts[("01_06", 2)] is False
    assert facts[("01_06", 3)] is None and facts[("01_06", 4)] is False
    assert facts[("01_06", 5)] is True
    # practice, aborted, onset-less and dot trials are gone; labels are repaired
    assert set(facts) == {("01_06", t) for t in (1, 2, 3, 4, 5, 36)} | {("ns01_06", 1), ("21_12_6", 1)}


def test_binned_and_unbinned_routes_agree(study):
    fixations, messages = study
    onsets = gaze.key_press_messages(messages)
    bins = gaze.bin_fixations(gaze.drop_aborted(fixations), gaze.BIN_COLUMNS)
    slow = gaze.flag_low_data(gaze.label_bins(bins, onsets))
    fast = gaze.trial_bins(fixations, messages).select(*slow.columns)
    assert slow.exceptAll(fast).count() == 0 and fast.exceptAll(slow).count() == 0
    labelled = gaze.label_fixations(gaze.drop_aborted(fixations), onsets)
    for by_type in (False, True):
        a = looking.word_means_from_bins(slow, by_type)
        b = looking.word_means(looking.trial_scores(labelled), by_type).select(*a.columns)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_trial_scores_hold_the_trial_facts(study):
    labelled = gaze.label_fixations(gaze.drop_aborted(study[0]), gaze.key_press_messages(study[1]))
    facts, scores = gaze.trial_facts(labelled), looking.trial_scores(labelled)
    same = scores.select(*facts.columns)
    assert facts.exceptAll(same).count() == 0 and same.exceptAll(facts).count() == 0
    assert looking.trial_conflicts(scores).count() == 0


def test_window_edges(study):
    bins = gaze.trial_bins(*study).filter((F.col("SubjectNumber") == "01_06") & (F.col("TrialNumber") == 36))
    spans = {r.whichwin: (r.a, r.b, r.n) for r in bins.groupBy("whichwin").agg(
        F.min("timeBin").alias("a"), F.max("timeBin").alias("b"), F.count("*").alias("n")).collect()}
    assert spans["pre"] == (0, 50, 51) and spans["long"] == (68, 299, 232) and spans["neither"][0] == 51
    first = bins.select("subj", "month", "first", "second", "num", "target", "gaze", "propt").first()
    assert tuple(first) == ("01", "06", "car", "ball", "two", "ball", "TARGET", 1.0)
    late = gaze.trial_bins(*study).filter(F.col("SubjectNumber") == "ns01_06").filter("longwin = 'Y'")
    # onset 1010 is half a bin late: the window opens at 68.5 and closes at 300.5
    assert tuple(late.agg(F.min("timeBin"), F.max("timeBin")).first()) == (69, 299)


def test_timecourse_counts_every_bin(study):
    labelled = gaze.label_fixations(gaze.drop_aborted(study[0]), gaze.key_press_messages(study[1]))
    bins = gaze.to_bins(labelled).filter((F.col("month") == "06") & (F.col("Nonset") > -750) & (F.col("Nonset") < 5000))
    want = {(r.trialtype, r.Nonset): (r.n, r.m) for r in bins.groupBy("trialtype", "Nonset").agg(
        F.count("propt").alias("n"), F.avg("propt").alias("m")).collect()}
    out = looking.timecourse(labelled).collect()
    assert {(r.trialtype, r.Nonset): (r.n, r.propt) for r in out} == want
    assert min(r.Nonset for r in out) == -740 and max(r.Nonset for r in out) == 4980


def test_accounting(study):
    facts = gaze.trial_facts(gaze.label_fixations(gaze.drop_aborted(study[0]), gaze.key_press_messages(study[1])))

    def trials(df):
        return sorted(tuple(r) for r in df.collect())

    assert trials(gaze.window_without_pre(facts)) == [("01_06", 4)]
    assert trials(gaze.no_pre_and_low(facts)) == []
    assert trials(gaze.low_data_trials(facts)) == [("01_06", 1), ("01_06", 5)]
    assert trials(gaze.subject_list(facts, group="lab_only")) == [("ns01_06",)]
    assert [tuple(r) for r in gaze.stopped_early(facts).collect()] == [("ns01_06", 1, 1, 35)]


def test_two_stages_weight_trials_equally(spark):
    cols = "SubjectNumber string, subj string, month string, target string, trialtype string, whichwin string, TrialNumber int, lowdata boolean, propt double"
    rows = [("a", "a", "06", "ball", "within", "long", 1, False, 1.0)] * 9 + [
        ("a", "a", "06", "ball", "within", "long", 2, False, 0.0)]
    out = looking.word_means_from_bins(spark.createDataFrame(rows, cols)).first()
    assert out.propt_long == 0.5 and out.propt_pre is None and out.proptcorr is None


def test_outlier_flags(spark):
    rows = [("m", float(i % 3)) for i in range(40)] + [("m", 100.0), ("one", 1.0), ("m", None)]
    df = flag_outliers(spark.createDataFrame(rows, "g string, v double"), "v", ["g"])
    assert [r.v for r in df.filter("outlier").collect()] == [100.0]
    assert df.filter("outlier is null").count() == 2 and without_outliers(df).count() == 40
    strict = flag_outliers(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], remove_missing=False)
    assert strict.filter("outlier is not null").count() == 0


def test_item_exclusion(spark):
    words = spark.createDataFrame([("1", "milk"), ("1", "ball"), ("2", "milk"), ("1", None), (None, "milk")],
                                  "subj string, target string")
    listed = spark.createDataFrame([("1",), ("1",)], "subj string")
    out = sorted((r.subj or "", r.target or "") for r in looking.without_item(words, listed, "milk").collect())
    assert out == [("", "milk"), ("1", "ball"), ("2", "milk")]
