"""Lab scores next to home measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexigaze.functions.nulls import in_table, natural_join, spread
from lexigaze.operators.looking import TRIAL_TYPES
from lexigaze.operators.outliers import without_outliers

PERSON = ["subj", "month", "SubjectNumber"]
POOLED = {"prop_op": "prop_op_avg", "prop_mom": "prop_mom_avg", "ent_subj_av": "ent_subj_avg",
          "propn": "prop_n_avg", "cross_item_mean_proptcorr": "cross_item_mean_proptcorr",
          "between": "between", "within": "within"}


def lab_home(subject_types: DataFrame, subjects: DataFrame, recordings: DataFrame,
             month: str = "06") -> DataFrame:
    """Every recording of the month with its child's lab scores, where there are any.

    Both lab tables come in flagged and lose their outliers here. The overall scores are
    blanked for children without a score in both conditions: such a score would not
    average the two.
    """
    lab = (without_outliers(subject_types).filter(F.col("month") == month)
           .drop("cross_item_mean_proptTT", "cross_item_mean_proptpreTT", "outlier", "numtrials_TT"))
    wide = spread(lab, [*PERSON, "numtrials"], "trialtype", TRIAL_TYPES, "cross_item_mean_proptcorrTT")
    home = recordings.filter(F.col("month") == month)
    merged = natural_join(home, wide, "left", expect=PERSON)
    merged = natural_join(merged, without_outliers(subjects), "left", expect=PERSON)
    complete = F.col("between").isNotNull() & F.col("within").isNotNull()
    scores = ["cross_item_mean_proptcorr", "cross_item_mean_proptpre", "cross_item_mean_propt"]
    return merged.withColumns({c: F.when(complete, F.col(c)) for c in scores})


def by_medium(merged: DataFrame, medium: str) -> DataFrame:
    return merged.filter(F.col("audio_video") == medium)


def pooled_shares(merged: DataFrame) -> DataFrame:
    """Audio and video shares averaged per child, for children recorded in both."""
    both = in_table(in_table(merged, by_medium(merged, "video"), "subj"),
                    by_medium(merged, "audio"), "subj")
    return both.groupBy("subj", "SubjectNumber", "month").agg(
        *[F.avg(c).alias(new) for c, new in POOLED.items()])


def audio_video_pairs(merged: DataFrame, measure: str = "prop_op") -> DataFrame:
    """The same measure from both media side by side, paired by child."""
    audio = by_medium(merged, "audio").select("subj", "SubjectNumber", F.col(measure).alias(f"a{measure}"))
    video = by_medium(merged, "video").select("subj", "SubjectNumber", F.col(measure).alias(f"v{measure}"))
    return natural_join(audio, video, "inner", expect=["subj", "SubjectNumber"])
