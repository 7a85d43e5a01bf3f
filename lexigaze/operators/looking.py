"""Looking measures: bins to trials to words to subjects and items.

Every stage weights its inputs equally (each trial of a word, each word of a subject),
so the stages are separate aggregations and must not be merged into one mean.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexigaze.functions.nulls import (
    n_missing, n_rows, natural_join, not_in_table, ratio, spread, strict,
)
from lexigaze.functions.special import t_quantile
from lexigaze.operators.gaze import (
    BIN_MS, MAX_BINS, MAX_MISSING_MS, low_data_flag,
)
from lexigaze.operators.outliers import flag_outliers, without_outliers
from lexigaze.operators.smooth import with_spline

SUBJECT = ["SubjectNumber", "subj", "month"]
WINDOWS = ["long", "pre"]
TRIAL_TYPES = ["between", "within"]


def _word_keys(by_type: bool) -> list[str]:
    return [*SUBJECT, "target", *(["trialtype"] if by_type else [])]


# -------------------------------------------------------------- trials, words

def trial_means(bins: DataFrame, by_type: bool = False) -> DataFrame:
    """Mean target looking per trial and window of a binned table, low trials left out."""
    return (bins.filter((F.col("lowdata") == F.lit(False)) & (F.col("whichwin") != "neither"))
            .groupBy(*_word_keys(by_type), "whichwin", "TrialNumber")
            .agg(F.avg("propt").alias("propt")))


def two_stage_means(bins: DataFrame, by_type: bool = False) -> DataFrame:
    """Trial means averaged per word and window (long form)."""
    return (trial_means(bins, by_type).groupBy(*_word_keys(by_type), "whichwin")
            .agg(F.avg("propt").alias("propt")))


def correct_for_baseline(wide: DataFrame) -> DataFrame:
    """long - pre; NULL when either window is missing."""
    return (wide.withColumn("proptcorr", F.col("long") - F.col("pre"))
            .withColumnsRenamed({"long": "propt_long", "pre": "propt_pre"}))


def word_means_from_bins(bins: DataFrame, by_type: bool = False) -> DataFrame:
    """Baseline-corrected looking per subject and word, from the binned table."""
    return correct_for_baseline(
        spread(two_stage_means(bins, by_type), _word_keys(by_type), "whichwin", WINDOWS, "propt"))


TRIAL = [*SUBJECT, "TrialNumber", "target", "trialtype", "pair"]


def trial_scores(labelled: DataFrame, max_bins: int = MAX_BINS,
                 max_missing: float = MAX_MISSING_MS) -> DataFrame:
    """One row per trial from labelled fixations, never exploding them.

    Holds the bins in both windows, the low-data flag and the mean target looking in each
    window, so this one pass over the fixations feeds the trial accounting and all looking
    measures. All bins of a fixation share one ``propt``: the mean over bins is a mean over
    fixations weighted by their bins. The low-data rule is one of the trial: where a trial shows
    several targets, their bins count together and all its rows share the flag.
    """
    def seen(bins: str) -> Column:
        return F.sum(F.when(F.col("propt").isNotNull(), F.col(bins)).otherwise(F.lit(0)))

    def mean_in(bins: str) -> Column:
        return ratio(F.sum(F.col("propt") * F.col(bins)), seen(bins))

    per_target = labelled.groupBy(*TRIAL).agg(
        F.sum("pre_bins").alias("pre_bins"), F.sum("long_bins").alias("long_bins"), seen("long_bins").alias("_seen"),
        mean_in("long_bins").alias("long"), mean_in("pre_bins").alias("pre"))
    trial = Window.partitionBy("SubjectNumber", "TrialNumber")  # as many rows as the trial has targets
    flag = low_data_flag(F.sum("long_bins").over(trial), F.sum("_seen").over(trial), max_bins, max_missing)
    return per_target.select(*TRIAL, "pre_bins", "long_bins", flag.alias("lowdata"), "long", "pre")


def trial_conflicts(trials: DataFrame) -> DataFrame:
    """Trials that show more than one target, type or pair (expected empty)."""
    return trials.groupBy("SubjectNumber", "TrialNumber").agg(n_rows().alias("n")).filter(F.col("n") > 1)


def word_means(trials: DataFrame, by_type: bool = False) -> DataFrame:
    """Same as ``word_means_from_bins`` from ``trial_scores``, both windows side by side."""
    kept_trials = trials.filter((F.col("lowdata") == F.lit(False))
                                & (F.col("pre_bins") + F.col("long_bins") > 0))
    return correct_for_baseline(kept_trials.groupBy(*_word_keys(by_type)).agg(
        F.avg("long").alias("long"), F.avg("pre").alias("pre")))


def two_stage_scores(trials: DataFrame, by_type: bool = False) -> DataFrame:
    """``two_stage_means`` from ``trial_scores``: one row per word and window that has any bin."""
    low = trials.filter(F.col("lowdata") == F.lit(False))
    windows = [low.filter(F.col(f"{w}_bins") > 0).select(*_word_keys(by_type), F.lit(w).alias("whichwin"), F.col(w).alias("propt")) for w in WINDOWS]
    return windows[0].unionByName(windows[1]).groupBy(*_word_keys(by_type), "whichwin").agg(F.avg("propt").alias("propt"))


def missing_report(words: DataFrame) -> DataFrame:
    """Per month: words, words without a baseline, subjects (two steps of counting)."""
    per_subject = words.groupBy("SubjectNumber", "month").agg(
        n_rows().alias("missing_trials"), n_missing("propt_pre").alias("missing_predata"))
    return per_subject.groupBy("month").agg(
        F.sum("missing_trials").alias("missing_trials"),
        F.sum("missing_predata").alias("missing_predata"), n_rows().alias("n_subjects"))


def with_trial_counts(words_by_type: DataFrame) -> DataFrame:
    """Rows with a corrected score, plus their number per subject and per subject and type.

    The input has one row per subject, word and type, so a window over a subject is
    bounded by the word list.
    """
    per_subject = Window.partitionBy("SubjectNumber")
    per_type = Window.partitionBy("SubjectNumber", "trialtype")
    return (words_by_type.filter(F.col("proptcorr").isNotNull())
            .withColumn("numtrials", F.count(F.lit(1)).over(per_subject))
            .withColumn("numtrials_TT", F.count(F.lit(1)).over(per_type)))


def trial_type_report(counted: DataFrame) -> DataFrame:
    return counted.groupBy("month", "trialtype").agg(
        F.avg("numtrials").alias("numtrials"), F.avg("numtrials_TT").alias("numtrials_TT"),
        F.avg("proptcorr").alias("proptcorr"))


# ----------------------------------------------------------- subjects, items

def _cross_item(suffix: str = "") -> list[Column]:
    return [F.avg("propt_long").alias(f"cross_item_mean_propt{suffix}"),
            F.avg("proptcorr").alias(f"cross_item_mean_proptcorr{suffix}"),
            F.avg("propt_pre").alias(f"cross_item_mean_proptpre{suffix}")]


def subject_means(words: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Subject means over words, flagged against the month (all within each value of ``by``)."""
    means = words.groupBy(*by, "subj", "month", "SubjectNumber").agg(*_cross_item())
    return flag_outliers(means, "cross_item_mean_proptcorr", [*by, "month"])


def subject_type_means(counted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Subject means per trial type, flagged against the month."""
    means = counted.groupBy(*by, "subj", "month", "SubjectNumber", "trialtype", "numtrials",
                            "numtrials_TT").agg(*_cross_item("TT"))
    return flag_outliers(means, "cross_item_mean_proptcorrTT", [*by, "month"], remove_missing=False)


def grand_mean(subjects: DataFrame, month: str = "06") -> DataFrame:
    """Mean and sd of the subject means of one month; missing if any subject's is."""
    c = "cross_item_mean_proptcorr"
    return subjects.filter(F.col("month") == month).groupBy("month").agg(
        strict(F.avg, c).alias("mean_of_means"), strict(F.stddev_samp, c).alias("sd_of_means"))


def single_condition_subjects(subject_types: DataFrame,
                              keys: Sequence[str] = ("subj", "month", "SubjectNumber")) -> DataFrame:
    """Subjects that do not have a score in exactly two conditions."""
    return (subject_types.filter(F.col("cross_item_mean_proptcorrTT").isNotNull())
            .groupBy(*keys).agg(n_rows().alias("n")).filter(F.col("n") != 2))


def item_means(counted: DataFrame, excluded: DataFrame | None, pairs: DataFrame | None, by: Sequence[str] = ()) -> DataFrame:
    """Item means over subjects per month and type, flagged within month and type.

    ``excluded`` lists subjects left out; ``pairs`` maps (trialtype, target) to the pair.
    """
    rows = counted if excluded is None else not_in_table(counted, excluded, "SubjectNumber")
    items = rows.groupBy(*by, "target", "month", "trialtype").agg(*_cross_item("TT"))
    flagged = flag_outliers(items, "cross_item_mean_proptcorrTT", [*by, "month", "trialtype"],
                            remove_missing=False)
    if pairs is None:
        return flagged
    return natural_join(flagged, pairs, "left", expect=["trialtype", "target"])


def item_pairs(trials: DataFrame) -> DataFrame:
    return trials.select("trialtype", "pair", "target").distinct()


def in_scenarios(words: DataFrame, subjects: DataFrame, item: str) -> DataFrame:
    """Each row once for every scenario it belongs to, named in ``scenario``.

    ``all`` holds all rows; ``without_item`` lacks one item of the listed subjects (a missing target
    is kept out, too). Everything computed by scenario then comes from one pass over the words.
    """
    listed = natural_join(words, subjects.select("subj", F.lit(True).alias("_listed")).distinct(),
                          "left", expect=["subj"])
    stays = F.when(F.col("_listed"), F.col("target") != item).otherwise(F.lit(True))
    both = F.when(stays, F.array(F.lit("all"), F.lit("without_item"))).otherwise(F.array(F.lit("all")))
    return listed.select(F.explode(both).alias("scenario"), *words.columns)


def without_item(words: DataFrame, subjects: DataFrame, item: str) -> DataFrame:
    """Leave out one item for the listed subjects (missing targets are kept out, too)."""
    return in_scenarios(words, subjects, item).filter(F.col("scenario") == "without_item").drop("scenario")


def both_types(subject_types: DataFrame, missing: DataFrame, key: str | Sequence[str] = "subj") -> DataFrame:
    return not_in_table(subject_types, missing, key)


def kept(flagged: DataFrame, month: str | None = None) -> DataFrame:
    rows = without_outliers(flagged)
    return rows if month is None else rows.filter(F.col("month") == month)


def looks_by_offset(labelled: DataFrame, start: float, stop: float) -> DataFrame:
    """Rows, looks on an image and looks on the target per trial type and 20 ms bin from onset.

    A fixation opens at its first bin and closes after its last one. Fixations of the same two
    ends are counted first; a running sum over the openings and closings then gives how many are
    open at each bin, so no row stands for a single bin before there is one per trial type and bin.
    """
    onset = F.floor(F.col("TargetOnset") / BIN_MS)
    first, last = math.floor(start / BIN_MS) + 1, math.ceil(stop / BIN_MS) - 1
    spans = (labelled.select("trialtype", "propt", F.greatest(F.lit(first), F.col("bin_from") - onset).cast("long").alias("lo"),
                             F.least(F.lit(last), F.col("bin_to") - onset).cast("long").alias("hi"))
             .filter(F.col("lo") <= F.col("hi")).groupBy("trialtype", "lo", "hi")
             .agg(n_rows().alias("rows"), F.count("propt").alias("n"), F.coalesce(F.sum("propt"), F.lit(0.0)).alias("looks")))
    counts = ["rows", "n", "looks"]
    opened = spans.select("trialtype", F.col("lo").alias("bin"), *counts)
    closed = spans.select("trialtype", (F.col("hi") + 1).alias("bin"), *[(-F.col(c)).alias(c) for c in counts])
    changes = opened.unionByName(closed).groupBy("trialtype", "bin").agg(*[F.sum(c).alias(c) for c in counts])
    # as many rows as there are bins between the two times
    so_far = Window.partitionBy("trialtype").orderBy("bin")
    held = changes.select("trialtype", "bin", F.lead("bin").over(so_far).alias("until"), *[F.sum(c).over(so_far).alias(c) for c in counts])
    bins = labelled.sparkSession.range(first, last + 1).withColumnRenamed("id", "at")
    return held.join(F.broadcast(bins), (F.col("at") >= F.col("bin")) & (F.col("at") < F.col("until")) & (F.col("rows") > 0)).select(
        "trialtype", (F.col("at") * BIN_MS).cast("double").alias("Nonset"), *counts)


def timecourse(labelled: DataFrame, excluded: DataFrame | None = None, month: str = "06",
               start: float = -750, stop: float = 5000) -> DataFrame:
    """Target looking by time from onset and trial type, with its interval and a smooth curve with its band."""
    shown = labelled.filter(F.col("month") == month)
    if excluded is not None:
        shown = not_in_table(shown, excluded, "subj")
    n, looks = F.col("n"), F.col("looks")
    # looks are 0 or 1, so their sum is also the sum of their squares
    points = looks_by_offset(shown, start, stop).withColumn("propt", F.try_divide(looks, n)).withColumn(
        "sd", F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), looks * (1 - F.col("propt")) / (n - 1)))))
    half = t_quantile(0.975, "(n - 1)") * F.col("sd") / F.sqrt("n")
    curve = with_spline(points, ["trialtype"], "Nonset", "n", "looks", "looks", start, stop)
    return curve.withColumns({"conf_low": F.col("propt") - half, "conf_high": F.col("propt") + half}).select(
        "trialtype", "Nonset", "n", "propt", "sd", "conf_low", "conf_high", "smooth", "smooth_low", "smooth_high")
