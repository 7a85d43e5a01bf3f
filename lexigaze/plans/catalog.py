"""Every operator as a query over one folder of tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from lexigaze.functions import nulls
from lexigaze.operators import (
    agreement, correlation, gaze, home, hypothesis, looking, merge, normality, ranks, report,
    resample, robust,
)
from lexigaze.operators.outliers import outliers, without_outliers
from lexigaze.session import scratch
from lexigaze.sources import readers, sinks
from lexigaze.plans.study_tables import TESTED_BRANDS, TRIALS_PER_SESSION, StudyTables

Query = Callable[[StudyTables], DataFrame]
REGISTRY: dict[str, Query] = {}
MEASURES = ["numtypes", "numtokens", "type_token_ratio", "r", "numspeakers"]


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(f"`{f.name}`", digits).alias(f.name) if isinstance(f.dataType, DoubleType)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return _round(REGISTRY[name](StudyTables(spark, folder)))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------------------ gaze

@query
def bin_explode(t):
    bins = gaze.bin_fixations(t.fixations, gaze.BIN_COLUMNS)
    return bins.groupBy("RECORDING_SESSION_LABEL", "TRIAL_INDEX", "CURRENT_FIX_INTEREST_AREA_LABEL").agg(
        F.count(F.lit(1)).alias("n_bins"), F.min("timeBin").alias("first_bin"),
        F.max("timeBin").alias("last_bin"), F.sum("Time").alias("sum_time"))


@query
def label_windows(t):
    return gaze.to_bins(t.labelled).groupBy(
        "SubjectNumber", "subj", "month", "TrialNumber", "trialtype", "target", "pair", "num", "gaze",
        "prewin", "longwin", "whichwin").agg(
        F.count(F.lit(1)).alias("n_bins"), F.sum("propt").alias("looks"),
        F.min("Nonset").alias("first_offset"), F.max("Nonset").alias("last_offset"))


@query
def low_data_flag(t):
    return gaze.low_data_bins(t.labelled)


@query
def low_data_trials(t):
    return gaze.low_data_trials(t.trials)


@query
def kept_trials(t):
    return gaze.low_data_trials(t.trials, low=False)


@query
def semi_in(t):
    return gaze.pre_trials(t.trials)


@query
def window_trials(t):
    return gaze.window_trials(t.trials)


@query
def trials_setdiff(t):
    return gaze.window_without_pre(t.trials)


@query
def trials_intersect(t):
    return gaze.no_pre_and_low(t.trials)


@query
def exclusion_totals(t):
    return gaze.exclusion_totals(t.trials, total=TRIALS_PER_SESSION)


@query
def key_press_problems(t):
    bins = gaze.bin_fixations(gaze.drop_aborted(t.fixations), gaze.BIN_COLUMNS)
    return gaze.key_press_problems(bins)


@query
def subject_lists(t):
    return _union([gaze.subject_list(t.trials, group=g).select(F.lit(g).alias("list"), "SubjectNumber")
                   for g in ("all", "with_data", "lab_only", "enrolled")])


@query
def last_trial(t):
    return gaze.last_trial(t.trials)


@query
def last_kept_trial(t):
    return gaze.last_trial(t.trials, kept_only=True)


@query
def stopped_early(t):
    return gaze.stopped_early(t.trials, total=TRIALS_PER_SESSION)


@query
def stopped_early_kept(t):
    return gaze.stopped_early(t.trials, total=TRIALS_PER_SESSION, kept_only=True)


@query
def natural_left_join(t):
    fixations = t.fixations.select(*gaze.MESSAGE_KEYS)
    return nulls.natural_join(fixations, t.onsets, "left", expect=gaze.MESSAGE_KEYS).groupBy(
        *gaze.MESSAGE_KEYS, "CURRENT_MSG_TIME").agg(F.count(F.lit(1)).alias("n_fixations"))


@query
def recode_separate(t):
    brands = t.read("part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    padded = {f"Brand#{i}": f"Brand#0{i}" for i in range(1, 10)}
    recoded = brands.withColumn("recoded", nulls.recode("p_brand", padded))
    return nulls.separate(recoded, "recoded", ["make", "number", "rest"], sep="#")


@query
def regex_clean(t):
    return t.fixations.select(F.regexp_replace("targetimage", ".jpg", "").alias("target")).groupBy(
        "target").agg(F.count(F.lit(1)).alias("n"))


@query
def prefix_filter(t):
    return t.trials.filter((F.col("month") == "06") & F.col("subj").startswith("ns")).groupBy("subj").agg(
        F.count_distinct("TrialNumber").alias("numtrials"))


# --------------------------------------------------------------------- looking

@query
def two_stage_mean(t):
    return looking.two_stage_scores(t.trials)


@query
def spread_corrected(t):
    return t.words


@query
def spread_corrected_by_type(t):
    return t.words_by_type


@query
def missing_report(t):
    return looking.missing_report(t.words)


@query
def numtrials_window(t):
    return t.counted


@query
def trialtype_report(t):
    return looking.trial_type_report(t.counted)


@query
def subject_means(t):
    return looking.kept(t.subjects, "06")


@query
def subject_outliers(t):
    return t.subject_types


@query
def subject_outlier_flags(t):
    return t.subjects


@query
def grand_mean_sd(t):
    return looking.grand_mean(without_outliers(t.subjects))


@query
def single_condition_subjects(t):
    return looking.single_condition_subjects(without_outliers(t.subject_types))


@query
def anti_not_in(t):
    return t.tested_types.select("subj", "trialtype", "cross_item_mean_proptcorrTT")


@query
def item_means(t):
    return looking.kept(t.items, "06")


@query
def item_outliers(t):
    return t.items


@query
def reorder_by_mean(t):
    return ranks.order_by_mean(looking.kept(t.items, "06"), "target", "cross_item_mean_proptcorrTT")


@query
def timecourse(t):
    return looking.timecourse(t.labelled, t.single_condition)


@query
def points_by_type(t):
    return report.points_by_type(t.tested_types)


@query
def points_with_interval(t):
    return report.points_with_interval(t.tested_types)


# --------------------------------------------------------------------- sources

@query
def tab_report(t):
    report_ = readers.read_tab_report(t.spark, f"{t.event_reports}/*", t.REPORT)
    return report_.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"), F.round(F.sum("value"), 3).alias("values"), F.count_if(F.col("note") == "").alias("empty"))


@query
def month_extract(t):
    spoken = readers.read_months(t.spark, t.spoken_words, ["06"])
    # a plain key: only that meets the buckets of both tables
    return spoken.join(t.spark.table(t.children), "subj", "left").groupBy("subj", "born").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"))


@query
def delimited_round_trip(t):
    path = scratch(t.spark)
    note = F.when(F.col("c_custkey") % 10 > 0, F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')))
    sinks.write_delimited(t.read("customer").select("c_custkey", "c_acctbal", note.alias("note")), path)
    return readers.read_comma(t.spark, path, "c_custkey long, c_acctbal double, note string")


@query
def numbered_table(t):
    """A table of text with row numbers and old line ends, written and read again."""
    path = scratch(t.spark)
    measure = F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))
    rows = t.read("part").select(F.col("p_partkey").alias("_c0"), measure.alias("Measure"), F.concat("p_type", F.lit(", R: 0-"), F.col("p_size").cast("string")).alias("Lab Only"))
    sinks.write_delimited(rows, path, line_end="\r")
    return readers.read_without_index(t.spark, path)


# ------------------------------------------------------------------------ home

@query
def right_join_onset(t):
    return home.with_noun_onset(t.annotations).groupBy("subj", "month", "noun_chi_onset").agg(
        F.count(F.lit(1)).alias("n"))


@query
def noun_onset(t):
    return home.noun_onset(t.annotations)


@query
def tested_word_counts(t):
    return home.tested_word_counts(t.annotations, TESTED_BRANDS)


@query
def speaker_spread(t):
    return home.parent_counts(t.annotations)


@query
def utterance_spread(t):
    return home.utterance_counts(t.annotations)


@query
def device_count(t):
    return home.device_counts(t.annotations)


@query
def presence_prop(t):
    return home.presence_share(t.annotations)


@query
def presence_prop_tested(t):
    return home.presence_share(t.annotations, TESTED_BRANDS)


@query
def child_counts(t):
    return home.child_counts(t.annotations)


@query
def child_types(t):
    return home.child_types(t.annotations)


@query
def recording_agg(t):
    return t.recordings


@query
def entropy_ut(t):
    return t.recordings.select("subj", "month", "audio_video", "ent_subj_av", "sum_prop_ut")


@query
def posttalk(t):
    return t.recordings.select("subj", "month", "audio_video", "noun_chi_onset", "posttalk")


@query
def fill_na_zero(t):
    return nulls.fill_zero(home.parent_counts(t.annotations), home.PARENTS)


@query
def length_check(t):
    parts = {"odd_speaker_code": home.odd_speaker_codes(t.annotations),
             "missing_utterance_type": home.missing_utterance_type(t.annotations),
             "label_conflict": home.label_conflicts(t.annotations),
             "trial_conflict": looking.trial_conflicts(t.trials)}
    return _union([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("problem"), "n")
                   for p, df in parts.items()])


@query
def words_starting_with(t):
    return home.words_starting_with(t.annotations, "B")


@query
def ut_share(t):
    return home.utterance_shares(t.annotations)


@query
def order_by_first(t):
    return ranks.order_by_first(t.recordings, "subj", F.col("propd") + F.col("propq"))


@query
def describe_range(t):
    return report.describe_recordings(t.recordings06, "video")


@query
def union_descriptives(t):
    return report.descriptives(t.recordings06)


@query
def descriptive_table(t):
    return report.with_headings(report.described(t.recordings06))


@query
def level_summary(t):
    return report.level_summary(t.annotations, ["speaker", "utterance_type", "object_present", "basic_level"])


@query
def measures_by_medium(t):
    return report.measures_by_medium(
        t.recordings06.withColumn("numtokens", F.col("numtokens").cast("double")),
        ["numtokens", "prop_mom", "prop_op"])


@query
def null_summary(t):
    return report.column_summary(t.words)


@query
def level_counts(t):
    return report.level_counts(t.annotations, ["speaker", "utterance_type", "object_present", "audio_video"])


@query
def table_size(t):
    return report.table_size(gaze.to_bins(t.labelled))


@query
def ordered_utterance_shares(t):
    return report.ordered_utterance_shares(t.annotations, t.recordings)


# ---------------------------------------------------------------------- merged

@query
def lab_home_merge(t):
    return t.lab_home.select(
        "subj", "month", "SubjectNumber", "audio_video", "numtokens", "prop_op", "numtrials", "between", "within",
        "cross_item_mean_proptcorr", "cross_item_mean_proptpre", "cross_item_mean_propt")


@query
def pooled_props(t):
    return t.pooled


@query
def positional_pair_join(t):
    return merge.audio_video_pairs(t.lab_home)


# ------------------------------------------------------------------ statistics

def _subject_t(df: DataFrame) -> DataFrame:
    return hypothesis.t_test(df, "cross_item_mean_proptcorrTT", ["trialtype"])


@query
def ttest_one(t):
    return _subject_t(t.tested_types)


@query
def ttest_overall(t):
    enrolled = looking.kept(t.subjects, "06").filter(~F.col("subj").startswith("ns"))
    return hypothesis.t_test(nulls.not_in_table(enrolled, t.single_condition, "subj"), "cross_item_mean_proptcorr")


@query
def ttest_paired(t):
    return hypothesis.paired_t_test(t.tested_types, "cross_item_mean_proptcorrTT", "trialtype", "between", "within", ["subj"])


@query
def ttest_welch(t):
    return hypothesis.welch_t_test(t.read("lineitem"), "l_discount", "l_returnflag", "A", "R")


@query
def ttest_welch_items(t):
    return hypothesis.welch_t_test(looking.kept(t.items, "06"), "cross_item_mean_proptcorrTT", "trialtype",
                                   "between", "within")


@query
def ttest_balance(t):
    return hypothesis.t_test(t.read("customer"), "c_acctbal", ["c_mktsegment"])


@query
def binom_exact(t):
    return hypothesis.positive_share(t.tested_types, "cross_item_mean_proptcorrTT", ["trialtype"])


@query
def positive_text(t):
    shares = hypothesis.positive_share(t.tested_types, "cross_item_mean_proptcorrTT", ["trialtype"])
    return shares.select("trialtype", "proppos", report.mean_sd_p_text("mean", "sd", "p_value").alias("text"))


@query
def mean_ci(t):
    return hypothesis.mean_interval(t.read("customer"), "c_acctbal", ["c_mktsegment"])


@query
def cor_pearson(t):
    return correlation.pearson_test(t.customers, "n_orders", "spent")


@query
def cor_spearman(t):
    return correlation.spearman_test(t.customers, "n_orders", "spent")


@query
def cor_spearman_trials(t):
    return correlation.spearman_test(without_outliers(t.subject_types), "numtrials", "cross_item_mean_proptcorrTT")


@query
def cor_spearman_untied(t):
    balances = nulls.natural_join(t.customers, t.read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_nationkey"), "left")
    return correlation.spearman_test(balances, "spent", "c_acctbal", ["c_nationkey"])


@query
def cor_kendall(t):
    return correlation.kendall_test(t.customers, "n_orders", "spent")


# name, medium, two measures, method: how the measures of quantity go together
QUANTITY = [
    ("a", "audio", "r", "numtokens", "kendall"), ("b", "audio", "r", "numtypes", "kendall"), ("c", "audio", "numtokens", "numtypes", "pearson"),
    ("d", "audio", "numtokens", "type_token_ratio", "pearson"), ("e", "audio", "numtypes", "type_token_ratio", "pearson"),
    ("f", "audio", "r", "type_token_ratio", "kendall"), ("g", "video", "r", "numtokens", "kendall"), ("h", "video", "r", "numtypes", "kendall"),
    ("i", "video", "numtokens", "numtypes", "kendall"), ("j", "video", "numtokens", "type_token_ratio", "kendall"),
    ("k", "video", "numtypes", "type_token_ratio", "kendall"), ("l", "video", "r", "type_token_ratio", "kendall"),
]


def _sweep(t) -> DataFrame:
    return correlation.correlation_sweep([
        (merge.by_medium(t.lab_home, m), [(name, x, y, how) for name, medium, x, y, how in QUANTITY if medium == m]) for m in ("audio", "video")])


@query
def cor_sweep(t):
    return _sweep(t)


@query
def cor_sweep_range(t):
    return correlation.sweep_range(_sweep(t))


@query
def cor_lab_home(t):
    score = "cross_item_mean_proptcorr"
    audio = merge.by_medium(t.lab_home, "audio")
    parts = [("aud_numtypes", audio, score, "numtypes"), ("prop_op", t.pooled, score, "prop_op_avg"),
             ("entropy", t.pooled, score, "ent_subj_avg"),
             ("av_prop_op", merge.audio_video_pairs(t.lab_home), "aprop_op", "vprop_op")]
    return _union([correlation.pearson_pairs(df, [(name, x, y)]) for name, df, x, y in parts])


# name, table, measure, method: how the outcome goes with each measure of the homes
OUTCOME = [
    ("aud_numtypes", "audio", "numtypes", "pearson"), ("aud_numtokens", "audio", "numtokens", "pearson"),
    ("aud_read", "audio", "r", "kendall"), ("aud_ratio", "audio", "type_token_ratio", "pearson"),
    ("aud_speakers", "audio", "numspeakers", "kendall"),
    ("vid_numtypes", "video", "numtypes", "pearson"), ("vid_numtokens", "video", "numtokens", "kendall"),
    ("vid_ratio", "video", "type_token_ratio", "pearson"), ("vid_read", "video", "r", "pearson"),
    ("vid_speakers", "video", "numspeakers", "kendall"),
    ("prop_op", "pooled", "prop_op_avg", "pearson"), ("entropy", "pooled", "ent_subj_avg", "pearson"),
    ("prop_mom", "pooled", "prop_mom_avg", "kendall"), ("prop_n", "pooled", "prop_n_avg", "pearson"),
]


@query
def cor_outcome(t):
    tables = {"audio": merge.by_medium(t.lab_home, "audio"), "video": merge.by_medium(t.lab_home, "video"), "pooled": t.pooled}
    parts = [(df, [(n, "cross_item_mean_proptcorr", m, how) for n, table, m, how in OUTCOME if table == name]) for name, df in tables.items()]
    both = merge.audio_video_pairs(t.lab_home)
    return correlation.correlation_sweep([*parts, (both, [("av_prop_op", "aprop_op", "vprop_op", "pearson")])])


def _normality(t) -> DataFrame:
    long = t.lab_home.select("audio_video", F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in MEASURES])).alias("s")
    ).select("audio_video", "s.*")
    return normality.shapiro_wilk(long, "v", ["audio_video", "measure"])


@query
def outcome_normality(t):
    score = "cross_item_mean_proptcorr"
    parts = [("subjects", looking.kept(t.subjects, "06"), score),
             *[(medium, merge.by_medium(t.lab_home, medium), score) for medium in ("audio", "video")],
             *[(f"pooled {c}", t.pooled, c) for c in (score, "prop_op_avg", "prop_mom_avg", "ent_subj_avg")]]
    long = _union([df.select(F.lit(name).alias("part"), F.col(c).cast("double").alias("v")) for name, df, c in parts])
    return normality.shapiro_wilk(long, "v", ["part"])


@query
def ttest_items(t):
    return hypothesis.t_test(looking.kept(t.items, "06"), "cross_item_mean_proptcorrTT", ["trialtype"])


@query
def positive_items(t):
    return hypothesis.positive_share(looking.kept(t.items, "06"), "cross_item_mean_proptcorrTT", ["trialtype"])


@query
def shapiro_wilk(t):
    return _normality(t)


@query
def shapiro_choose_method(t):
    p = nulls.spread(_normality(t), ["audio_video"], "measure", ["numtypes", "numtokens"], "p_value")
    return p.select("audio_video", correlation.choose_method(F.col("numtypes"), F.col("numtokens")).alias("method"))


@query
def kappa(t):
    return agreement.cohen_kappa(t.coders, "orig_utt_type", "new_utt_type", ["audio_video"])


@query
def kappa_presence(t):
    return agreement.cohen_kappa(t.coders, "orig_present", "new_present", ["audio_video"])


@query
def kappa_labels(t):
    two = t.read("labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"),
                                  F.lit("labels").alias("audio_video"))
    return agreement.cohen_kappa(two, "a", "b", ["audio_video"])


@query
def agreement_(t):
    return agreement.agreement(t.coders, "orig_utt_type", "new_utt_type", ["audio_video"])


REGISTRY["agreement"] = REGISTRY.pop("agreement_")


@query
def mean_agreement(t):
    return agreement.mean_rounded(
        agreement.agreement(t.coders, "orig_present", "new_present", ["audio_video"]), "value", 0)


@query
def mean_agreement_type(t):
    return agreement.mean_rounded(
        agreement.agreement(t.coders, "orig_utt_type", "new_utt_type", ["audio_video"]), "value", 0)


@query
def mean_kappa_type(t):
    return agreement.mean_rounded(agreement.cohen_kappa(t.coders, "orig_utt_type", "new_utt_type", ["audio_video"]), "value", 1)


@query
def mean_kappa_presence(t):
    return agreement.mean_rounded(agreement.cohen_kappa(t.coders, "orig_present", "new_present", ["audio_video"]), "value", 1)


@query
def agreement_flags(t):
    flagged = agreement.with_agreement(t.coders, {"utrel": ("orig_utt_type", "new_utt_type"),
                                                  "oprel": ("orig_present", "new_present")})
    return flagged.groupBy("utrel", "oprel").agg(F.count(F.lit(1)).alias("n"))


@query
def exclusion_rerun(t):
    rest = looking.without_item(t.counted, t.in_debt, "milk")
    types = looking.kept(looking.subject_type_means(rest), "06")
    missing = looking.single_condition_subjects(types, ["subj"])
    return _subject_t(looking.both_types(types, missing))


@query
def scenario_subject_types(t):
    return t.scenario_types


@query
def scenario_items(t):
    words = looking.in_scenarios(t.counted, t.in_debt, "milk")
    return looking.item_means(words, None, None, ["scenario"]).filter(F.col("month") == "06")


@query
def scenario_subjects(t):
    return t.scenario_subjects


@query
def scenario_single_condition(t):
    return t.scenario_single


@query
def scenario_normality(t):
    parts = [(t.scenario_types, "cross_item_mean_proptcorrTT"), (t.scenario_subjects, "cross_item_mean_proptcorr")]
    long = _union([df.select("scenario", F.lit(c).alias("measure"), F.col(c).alias("v")) for df, c in parts])
    return normality.shapiro_wilk(long, "v", ["scenario", "measure"])


@query
def scenario_tests(t):
    tested = looking.both_types(t.scenario_types, t.scenario_single, ["scenario", "subj"])
    score = "cross_item_mean_proptcorrTT"
    one = hypothesis.t_test(tested, score, ["scenario", "trialtype"]).withColumnRenamed("trialtype", "test")
    paired = hypothesis.paired_t_test(tested, score, "trialtype", "between", "within", ["subj"], group=["scenario"])
    enrolled = t.scenario_subjects.filter(~F.col("subj").startswith("ns"))
    overall = hypothesis.t_test(nulls.not_in_table(enrolled, t.single_condition, "subj"), "cross_item_mean_proptcorr", ["scenario"])
    return _union([one, paired.withColumn("test", F.lit("paired")), overall.withColumn("test", F.lit("overall"))])


@query
def result_lines(t):
    tests = hypothesis.t_test(t.tested_types, "cross_item_mean_proptcorrTT", ["trialtype"])
    named = [(report.TYPE_LABELS[k], tests.filter(F.col("trialtype") == k)) for k in looking.TRIAL_TYPES]
    return report.result_lines(*named)


@query
def inline_results(t):
    one, outcome = _subject_t(t.tested_types), cor_outcome(t)
    named = [(report.TYPE_LABELS[k], one.filter(F.col("trialtype") == k)) for k in looking.TRIAL_TYPES]
    wanted = ["prop_op", "aud_numtypes", "aud_numtokens", "aud_read", "entropy", "prop_n"]
    return report.result_lines(*named, ("paired", ttest_paired(t)), ("overall", ttest_overall(t)),
                               *[(F.col("pair"), outcome.filter(F.col("pair").isin(wanted)))])


@query
def bootstrap_corr(t):
    return resample.bootstrap_correlation(t.customers, "n_orders", "spent")


@query
def bootstrap_presence(t):
    return resample.bootstrap_correlation(t.pooled, "cross_item_mean_proptcorr", "prop_op_avg")


@query
def bootstrap_types(t):
    return resample.bootstrap_correlation(merge.by_medium(t.lab_home, "audio"), "cross_item_mean_proptcorr", "numtypes")


@query
def bootstrap_spending(t):
    return resample.bootstrap_ratio(t.customers, "n_orders", "spent")


@query
def huber_fit(t):
    return robust.line_table(t.spark, robust.huber_line(t.customers, "n_orders", "spent"))


@query
def robust_band(t):
    line = robust.huber_line(t.customers, "n_orders", "spent")
    return line.band(t.customers.select(F.col("n_orders").alias("x")).distinct())


def _presence_line(t) -> robust.Line:
    return robust.huber_line(t.pooled, "prop_op_avg", "cross_item_mean_proptcorr")


@query
def huber_presence(t):
    return robust.line_table(t.spark, _presence_line(t))


@query
def presence_band(t):
    drawn = t.pooled.dropna(subset=["prop_op_avg", "cross_item_mean_proptcorr"])
    return _presence_line(t).band(drawn.select(F.col("prop_op_avg").alias("x")).distinct())


@query
def outlier_rows(t):
    return outliers(looking.flag_outliers(t.read("part"), "p_retailprice", ["p_brand"], width=1.5)).select(
        "p_partkey", "p_brand", "p_retailprice", "outlier")
