"""Gaze logs to labelled trials.

A fixation covers many 20 ms bins, and every label of a bin except its time is a
property of the fixation. So rows are joined, filtered and labelled while there is one
row per fixation, and the explosion into bins comes last. What a window needs from a
fixation is how many of its bins fall inside, which is arithmetic on the two ends; the
low-data rule and the looking means are therefore computed without exploding at all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexigaze.functions.nulls import (
    if_else, is_one_of, natural_join, recode, separate, to_number,
)

BIN_MS = 20
# bins after target onset that open and close the analysis window
LONG_FROM, LONG_TO = 18, 250
# low-data rule: bins in the window and missing milliseconds still allowed
MAX_BINS, MAX_MISSING_MS = 232, 3089
TRIALS_PER_SESSION = 36

# fixed values: column names and codes of the tracker's reports
MESSAGE_KEYS = ["RECORDING_SESSION_LABEL", "TRIAL_INDEX"]
ONSET_MESSAGE = "EL_BUTTON_CRIT_WORD"
PRACTICE_TRIALS = ["p4", "p3", "p2", "p1"]
BIN_COLUMNS = [
    "RECORDING_SESSION_LABEL", "CURRENT_FIX_INTEREST_AREA_LABEL", "TRIAL_INDEX", "RT",
    "TRIAL_START_TIME", "audiotarget", "carrier", "distractorimage", "targetimage",
    "distractorloc", "targetloc", "pair", "targetside", "trial", "trialtype",
]
# fixed values: session labels typed wrongly during testing, and what they should be
SUBJECT_REPAIRS = {
    "01_06_18": "01_18_6",
    "11_06_18": "11_18_6",
    "16_18_18": "16_18_6",
    "18_18_18": "18_18_6",
    "21_12_2": "21_12_6",
    "39_12": "39_12_6",
    "ns01": "ns01_06",
    "ns02": "ns02_06",
    "ns03": "ns03_06",
    "ns04": "ns04_06",
    "ns05": "ns05_06",
    "ns06": "ns06_06",
    "ns07": "ns07_06",
    "ns08": "ns08_06",
    "ns09": "ns09_06",
    "ns10": "ns10_06",
    "ns12": "ns12_06",
}


# ------------------------------------------------------------------- binning

def first_bin(start: Column, bin_ms: int = BIN_MS) -> Column:
    return F.ceil(start / F.lit(bin_ms))


def last_bin(end: Column, bin_ms: int = BIN_MS) -> Column:
    return F.ceil(end / F.lit(bin_ms)) - 1


def _explode_span(lo: Column, hi: Column) -> Column:
    # sequence() would count downwards for an empty span
    return F.explode(F.when(lo <= hi, F.sequence(lo, hi)))


def bin_fixations(
    df: DataFrame, keep: Sequence[str], start: str = "fix_start", end: str = "fix_end",
    bin_ms: int = BIN_MS,
) -> DataFrame:
    """One row per bin covered by a fixation: ``start <= bin * bin_ms < end``."""
    span = _explode_span(first_bin(F.col(start), bin_ms), last_bin(F.col(end), bin_ms))
    return df.select(*keep, span.alias("timeBin")).withColumn(
        "Time", (F.col("timeBin") * bin_ms).cast("double"))


def drop_aborted(fixations: DataFrame) -> DataFrame:
    """Rows after the session ended early carry no sound file."""
    return fixations.filter(F.col("audiotarget").isNotNull())


def key_press_messages(messages: DataFrame) -> DataFrame:
    """Target onsets: the experimenter's key press, one row per session and trial."""
    return (messages.filter(F.col("CURRENT_MSG_TEXT") == ONSET_MESSAGE)
            .withColumn("RT", to_number("RT"))
            .select("RECORDING_SESSION_LABEL", "CURRENT_MSG_TIME", "TRIAL_INDEX"))


def key_press_problems(bins: DataFrame) -> DataFrame:
    """Test trials whose key press went wrong (RT of -1)."""
    return (bins.filter((F.col("RT") == -1) & ~is_one_of("trial", PRACTICE_TRIALS))
            .select("RECORDING_SESSION_LABEL", "TRIAL_INDEX", "RT", "audiotarget").distinct())


# ------------------------------------------------------------------ labelling

def _label(df: DataFrame, repairs: Mapping[str, str]) -> DataFrame:
    """Trial labels shared by fixations and bins; needs CURRENT_MSG_TIME attached."""
    out = (
        df.filter(~is_one_of("trial", PRACTICE_TRIALS) & F.col("CURRENT_MSG_TIME").isNotNull()
                  & ~(F.col("trialtype") == "."))
        .withColumnsRenamed({
            "RECORDING_SESSION_LABEL": "SubjectNumber", "CURRENT_MSG_TIME": "TargetOnset",
            "CURRENT_FIX_INTEREST_AREA_LABEL": "gaze", "TRIAL_INDEX": "TrialNumber"})
        .withColumn("propt", if_else(F.col("gaze") == "TARGET", F.lit(1.0), if_else(
            F.col("gaze") == "DISTRACTOR", F.lit(0.0), F.lit(None))))
        # the dot stands for any character, as in the original pattern
        .withColumn("target", F.regexp_replace("targetimage", ".jpg", ""))
        .withColumn("gaze", recode("gaze", {".": None}))
        .withColumn("SubjectNumber", recode("SubjectNumber", repairs))
    )
    out = separate(out, "SubjectNumber", ["subj", "month"])
    out = separate(out, "pair", ["first", "second"])
    return out.withColumn(
        "num", if_else(F.col("second") == F.col("target"), F.lit("two"), F.lit("one"))
    ).drop("trial")


def _window_labels(df: DataFrame, bin_ms: int = BIN_MS) -> DataFrame:
    onset_bin = F.col("TargetOnset") / bin_ms
    return (
        df.withColumn("Nonset", ((F.col("timeBin") - F.floor(onset_bin)) * bin_ms).cast("double"))
        .withColumn("prewin", if_else(F.col("Time") <= F.col("TargetOnset"), F.lit("Y"), F.lit("N")))
        .withColumn("longwin", if_else(
            (F.col("timeBin") >= onset_bin + LONG_FROM) & (F.col("timeBin") <= onset_bin + LONG_TO),
            F.lit("Y"), F.lit("N")))
        .withColumn("whichwin", if_else(F.col("prewin") == "Y", F.lit("pre"), if_else(
            F.col("longwin") == "Y", F.lit("long"), F.lit("neither"))))
    )


def label_bins(bins: DataFrame, messages: DataFrame,
               repairs: Mapping[str, str] = SUBJECT_REPAIRS) -> DataFrame:
    """Labelled trial table from an already binned log (one row per bin)."""
    joined = natural_join(bins, messages, "left", expect=MESSAGE_KEYS)
    return _window_labels(_label(joined, repairs))


def label_fixations(fixations: DataFrame, messages: DataFrame,
                    repairs: Mapping[str, str] = SUBJECT_REPAIRS) -> DataFrame:
    """Labelled fixations: ``bin_from``/``bin_to`` and the number of bins in each window.

    ``pre_bins`` counts bins up to target onset, ``long_bins`` those in the analysis
    window. Fixations that cover no bin start are dropped: they have no row in a binned
    table either.
    """
    lo, hi = first_bin(F.col("fix_start")), last_bin(F.col("fix_end"))
    spans = fixations.select(*BIN_COLUMNS, lo.alias("bin_from"), hi.alias("bin_to")).filter(
        F.col("bin_from") <= F.col("bin_to"))
    labelled = _label(natural_join(spans, messages, "left", expect=MESSAGE_KEYS), repairs)
    onset_bin = F.col("TargetOnset") / BIN_MS
    opens, closes = F.ceil(onset_bin + LONG_FROM), F.floor(onset_bin + LONG_TO)
    return (
        labelled
        .withColumn("pre_bins", F.greatest(
            F.lit(0), F.least("bin_to", F.floor(onset_bin)) - F.col("bin_from") + 1))
        .withColumn("long_bins", F.greatest(
            F.lit(0), F.least(F.col("bin_to"), closes) - F.greatest(F.col("bin_from"), opens) + 1))
    )


# ------------------------------------------------------------------- low data

def low_data_flag(rows: Column, on_image: Column, max_bins: int = MAX_BINS,
                  max_missing: float = MAX_MISSING_MS, bin_ms: int = BIN_MS) -> Column:
    """TRUE when too much of the window lacks gaze on an image, NULL without window rows."""
    return F.when(rows > 0, (F.lit(max_bins) - on_image) * bin_ms > max_missing)


def flag_low_data(bins: DataFrame, window: str = "longwin", max_bins: int = MAX_BINS,
                  max_missing: float = MAX_MISSING_MS, bin_ms: int = BIN_MS) -> DataFrame:
    """Add ``lowdata`` to every row of a binned table; no row is removed.

    A trial is low when too much of the window lacks gaze on either image; a trial with
    no row in the window has a NULL flag.
    """
    per_trial = (bins.filter(F.col(window) == "Y").groupBy("SubjectNumber", "TrialNumber")
                 .agg(low_data_flag(F.count(F.lit(1)), F.count("propt"), max_bins, max_missing, bin_ms)
                      .alias("lowdata")))
    return natural_join(bins, per_trial, "left", expect=["SubjectNumber", "TrialNumber"])


TRIAL_KEYS = ["SubjectNumber", "subj", "month", "TrialNumber"]


def trial_facts(labelled: DataFrame, max_bins: int = MAX_BINS,
                max_missing: float = MAX_MISSING_MS, extra: Sequence[Column] = ()) -> DataFrame:
    """One row per trial: bins before onset, bins in the window, low-data flag."""
    on_image = F.sum(F.when(F.col("propt").isNotNull(), F.col("long_bins")).otherwise(F.lit(0)))
    return labelled.groupBy(*TRIAL_KEYS).agg(
        F.sum("pre_bins").alias("pre_bins"), F.sum("long_bins").alias("long_bins"),
        low_data_flag(F.sum("long_bins"), on_image, max_bins, max_missing).alias("lowdata"), *extra)


def low_data_bins(labelled: DataFrame) -> DataFrame:
    """One row per trial: its flag and how many bins its fixations cover, without making a bin."""
    facts = trial_facts(labelled.withColumn("_bins", F.col("bin_to") - F.col("bin_from") + 1), extra=[F.sum("_bins").alias("n_bins")])
    return facts.select("SubjectNumber", "TrialNumber", "lowdata", "n_bins")


def with_low_data(labelled: DataFrame, max_bins: int = MAX_BINS,
                  max_missing: float = MAX_MISSING_MS) -> DataFrame:
    """``flag_low_data`` for labelled fixations; a window over the few fixations of a trial."""
    trial = Window.partitionBy(*TRIAL_KEYS)
    on_image = F.sum(F.when(F.col("propt").isNotNull(), F.col("long_bins")).otherwise(F.lit(0))).over(trial)
    return labelled.withColumn("lowdata", low_data_flag(F.sum("long_bins").over(trial), on_image, max_bins, max_missing))


def to_bins(labelled: DataFrame) -> DataFrame:
    """Explode labelled fixations into the labelled bin table."""
    span = _explode_span(F.col("bin_from"), F.col("bin_to"))
    plain = [c for c in labelled.columns if c not in ("bin_from", "bin_to", "pre_bins", "long_bins")]
    return _window_labels(labelled.select(*plain, span.alias("timeBin")).withColumn(
        "Time", (F.col("timeBin") * BIN_MS).cast("double")))


def trial_bins(fixations: DataFrame, messages: DataFrame,
               repairs: Mapping[str, str] = SUBJECT_REPAIRS) -> DataFrame:
    """Raw reports to the labelled, low-data-flagged bin table."""
    onsets = key_press_messages(messages)
    return to_bins(with_low_data(label_fixations(drop_aborted(fixations), onsets, repairs)))


# ----------------------------------------------------------- trial accounting

def subject_list(facts: DataFrame, month: str = "06", group: str = "all") -> DataFrame:
    """Distinct subjects of a month: all, with_data, lab_only ("ns" ids) or enrolled."""
    lab_only = F.col("subj").startswith("ns")
    pick = {"all": F.lit(True), "with_data": F.col("lowdata") == F.lit(False),
            "lab_only": lab_only, "enrolled": ~lab_only}[group]
    return facts.filter((F.col("month") == month) & pick).select("SubjectNumber").distinct()


def last_trial(facts: DataFrame, month: str = "06", kept_only: bool = False) -> DataFrame:
    rows = facts.filter(F.col("month") == month)
    if kept_only:
        rows = rows.filter(F.col("lowdata") == F.lit(False))
    return rows.groupBy("SubjectNumber").agg(
        F.max("TrialNumber").alias("maxtrial"), F.count_distinct("TrialNumber").alias("numtrials"))


def stopped_early(facts: DataFrame, month: str = "06", total: int = TRIALS_PER_SESSION,
                  kept_only: bool = False) -> DataFrame:
    """Subjects whose last trial came before the end, with the number of trials missed."""
    return (last_trial(facts, month, kept_only).filter(F.col("maxtrial") < total)
            .withColumn("missedtrials_endedearly", F.lit(total) - F.col("maxtrial")))


# bits of a trial's mask
PRE, WINDOW, LOW, KEPT, WITH_DATA = 1, 2, 4, 8, 16


def trial_masks(facts: DataFrame, month: str = "06") -> DataFrame:
    """(SubjectNumber, TrialNumber, mask): what is known of each trial of a month, as bits.

    Bins before onset, bins in the window, the low-data flag either way, and whether any trial of
    the subject is kept. Rows are dealt by subject once; a subject has few trials, so both the
    trials and the subject's bit are found where its rows lie.
    """
    def bit(test: Column, value: int) -> Column:
        return F.when(test, value).otherwise(0)

    flags = bit(F.col("pre_bins") > 0, PRE) + bit(F.col("long_bins") > 0, WINDOW) + bit(F.col("lowdata"), LOW) + bit(~F.col("lowdata"), KEPT)
    per_trial = facts.filter(F.col("month") == month).select("SubjectNumber", "TrialNumber", flags.alias("mask")).repartition("SubjectNumber").groupBy(
        "SubjectNumber", "TrialNumber").agg(F.bit_or("mask").alias("mask"))
    any_kept = F.max(F.col("mask").bitwiseAND(KEPT)).over(Window.partitionBy("SubjectNumber")) > 0
    return per_trial.withColumn("mask", F.col("mask") + bit(any_kept, WITH_DATA))


def _has(bits: int, none_of: int = 0) -> Column:
    """All of these bits are set in the mask and none of the others."""
    return F.col("mask").bitwiseAND(bits | none_of) == bits


def trials_with(facts: DataFrame, bits: int, none_of: int = 0, month: str = "06") -> DataFrame:
    """(SubjectNumber, TrialNumber) of subjects with usable data whose mask fits."""
    return trial_masks(facts, month).filter(_has(bits | WITH_DATA, none_of)).drop("mask")


def pre_trials(facts: DataFrame, month: str = "06") -> DataFrame:
    return trials_with(facts, PRE, month=month)


def window_trials(facts: DataFrame, month: str = "06") -> DataFrame:
    return trials_with(facts, WINDOW, month=month)


def window_without_pre(facts: DataFrame, month: str = "06") -> DataFrame:
    return trials_with(facts, WINDOW, PRE, month)


def low_data_trials(facts: DataFrame, month: str = "06", low: bool = True) -> DataFrame:
    return trials_with(facts, LOW if low else KEPT, month=month)


def no_pre_and_low(facts: DataFrame, month: str = "06") -> DataFrame:
    return trials_with(facts, WINDOW | LOW, PRE, month)


def exclusion_totals(facts: DataFrame, month: str = "06",
                     total: int = TRIALS_PER_SESSION) -> DataFrame:
    """Why trials were lost: (reason, n), all from one pass over the trials' masks."""
    reasons = {"low_data": _has(LOW | WITH_DATA), "low_data_and_no_baseline": _has(WINDOW | LOW | WITH_DATA, PRE),
               "no_baseline": _has(WINDOW | WITH_DATA, PRE)}
    per_subject = trial_masks(facts, month).groupBy("SubjectNumber").agg(
        *[F.count_if(test).alias(name) for name, test in reasons.items()],
        F.greatest(F.lit(0), F.lit(total) - F.max("TrialNumber")).cast("long").alias("ended_early"))
    names = [*reasons, "ended_early"]
    sums = per_subject.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names])
    return sums.unpivot([], names, "reason", "n")
