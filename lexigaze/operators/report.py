"""Tables for the report: descriptives, summaries, result lines, figure data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

from lexigaze.functions.nulls import attach, col_of, lookup, n_missing, n_rows, natural_join, strict
from lexigaze.operators.home import utterance_shares
from lexigaze.operators.hypothesis import mean_interval, positive_share
from lexigaze.operators.ranks import order_by_first, value_ranks

# fixed values: trial types as they are called in the text
TYPE_LABELS = {"between": "unrelated", "within": "related"}

# measure, name in the table, digits of the sd in the audio row
DESCRIBED = [
    ("numtokens", "numtokens_avg", 1), ("numtypes", "numtypes_avg", 1),
    ("numspeakers", "numspeakers_avg", 1), ("prop_mom", "prop_mom_avg", 1),
    ("prop_op", "prop_op_avg", 1), ("ent_subj_av", "subj_entropy", 1), ("propn", "prop_n", 2),
]
# fixed values: headings of the printed table
HEADINGS = ["", "# tokens", "# types", "# speakers", "prop mat input", "prop obj.co-p.",
            "utt type ent", "prop short phrase"]


def trial_type_label(c: Column | str) -> Column:
    return lookup(c, TYPE_LABELS)


def number_text(c: Column | str, digits: int) -> Column:
    """Rounded half to even, printed without trailing zeros, "NA" when missing."""
    rounded = F.bround(col_of(c).cast("double"), digits)
    # format_string would print a missing value as "null"
    text = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", rounded), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(rounded.isNotNull(), text).otherwise(F.lit("NA"))


def range_text(c: str, digits: int = 1, sd_digits: int = 1) -> Column:
    """"min-max,mean(sd)". Range is missing when a value is; mean and sd skip missing ones."""
    return F.concat(number_text(strict(F.min, c), digits), F.lit("-"),
                    number_text(strict(F.max, c), digits), F.lit(","),
                    number_text(F.avg(c), digits), F.lit("("),
                    number_text(F.stddev_samp(c), sd_digits), F.lit(")"))


MEDIA = {"audio": "aud", "video": "vid"}


def described(recordings: DataFrame) -> DataFrame:
    """One row of descriptives for audio, one for video and one for both, from one aggregate.

    The spread of the last measure is printed with more digits for audio; both forms are made
    and the row's label picks one.
    """
    by_medium = F.grouping("audio_video") == 0
    texts = [F.when(by_medium & (F.col("audio_video") == "audio"), range_text(c, 1, digits)).otherwise(range_text(c, 1, 1)).alias(name)
             for c, name, digits in DESCRIBED]
    label = F.when(~by_medium, F.lit("both")).otherwise(lookup("audio_video", MEDIA)).alias("recording_type")
    return recordings.rollup("audio_video").agg(label, *texts).drop("audio_video")


def describe_recordings(recordings: DataFrame, medium: str) -> DataFrame:
    """One row of descriptives for one medium."""
    return described(recordings.filter(F.col("audio_video") == medium)).filter(F.col("recording_type") == MEDIA[medium])


def descriptives(recordings: DataFrame) -> DataFrame:
    """The audio and the video row."""
    return described(recordings).filter(F.col("recording_type") != "both")


def with_headings(table: DataFrame, headings: Sequence[str] = HEADINGS) -> DataFrame:
    """Display names; a heading left empty is a blank, since columns need a name."""
    return table.toDF(*[h or " " for h in headings])


def measures_by_medium(recordings: DataFrame, measures: Sequence[str]) -> DataFrame:
    """min, max, mean and sd of every measure by medium."""
    fns = {"min": F.min, "max": F.max, "mean": F.avg, "sd": F.stddev_samp}
    return recordings.groupBy("audio_video").agg(
        *[f(m).alias(f"{m}_{name}") for m in measures for name, f in fns.items()])


def column_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column: rows, missing, min, exact quartiles (linear between neighbours), mean, max.

    Values are ranked over range slices, so no task sorts or holds a whole column.
    """
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in names])).alias("s")).select("s.*")
    sizes = long.groupBy("column").agg(
        n_rows().alias("n"), n_missing("v").alias("missing"), F.min("v").alias("min"), F.avg("v").alias("mean"), F.max("v").alias("max"))
    ranked = attach(value_ranks(long, ["column"], "v"), sizes.select("column", (F.col("n") - F.col("missing") - 1).alias("_last")), ["column"], salts=64)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("ties")), F.col("v")))

    quartiles = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    ends = [f(F.col("_last") * share) for share in quartiles.values() for f in (F.floor, F.ceil)]
    found = ranked.groupBy("column").agg(F.first("_last").alias("_last"), *[at(e).alias(f"_e{i}") for i, e in enumerate(ends)])
    between = [(F.col(f"_e{2 * i}") + (F.col("_last") * share - F.floor(F.col("_last") * share)) * (F.col(f"_e{2 * i + 1}") - F.col(f"_e{2 * i}"))).alias(name)
               for i, (name, share) in enumerate(quartiles.items())]
    return attach(sizes, found.select("column", *between), ["column"]).select("column", "n", "missing", "min", "q1", "median", "mean", "q3", "max")


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per value of each text column, in one pass; a missing value is a level."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns
    ])).alias("s")).select("s.*")
    return long.groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))


def level_summary(df: DataFrame, columns: Sequence[str], most: int = 7) -> DataFrame:
    """The most frequent values of each text column and a row for the rest: (column, place, level, n).

    A column of up to ``most`` values shows them all; otherwise the last of ``most`` rows counts what
    is left. Missing values are a level. Each task passes on no more rows of a column than are shown,
    so the levels of a column never come together.
    """
    counts = level_counts(df, columns)
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_last("level"))
    shown = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    totals = counts.groupBy("column").agg(F.sum("n").alias("_n"), n_rows().alias("_levels"))
    cut = attach(shown, totals, ["column"]).filter((F.col("_levels") <= most) | (F.col("place") < most))
    rest = cut.filter(F.col("_levels") > most).groupBy("column").agg((F.first("_n") - F.sum("n")).alias("n"))
    return cut.select("column", "place", "level", "n").unionByName(
        rest.select("column", F.lit(most).alias("place"), F.lit("(Other)").alias("level"), "n"))


def table_size(df: DataFrame) -> DataFrame:
    """Rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


# ------------------------------------------------------------------ result lines

def result_lines(*named: tuple[str | Column, DataFrame]) -> DataFrame:
    """All tests of a report in one table, each with its line for the text; a name may be a column of its tests."""
    out = None
    for name, tests in named:
        text = F.concat(F.lit("estimate="), number_text("estimate", 3), F.lit(", statistic="),
                        number_text("statistic", 2), F.lit(", df="), number_text("parameter", 2),
                        F.lit(", p="), number_text("p_value", 3))
        rows = tests.select((F.lit(name) if isinstance(name, str) else name).alias("name"), "estimate", "statistic", "parameter", "p_value",
                            "conf_low", "conf_high", "method", text.alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out


def mean_sd_p_text(mean: Column | str, sd: Column | str, p: Column | str) -> Column:
    """"M=.., SD=.., p = .." with three digits each; missing as soon as one part is."""
    parts = [col_of(c) for c in (mean, sd, p)]
    text = F.concat(F.lit("M="), number_text(parts[0], 3), F.lit(", SD="), number_text(parts[1], 3),
                    F.lit(", p = "), number_text(parts[2], 3))
    return F.when(parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull(), text)


# --------------------------------------------------------------------- figure data

def points_by_type(subject_types: DataFrame) -> DataFrame:
    """Points of the comprehension figure, with the label of the trial type."""
    return subject_types.select("subj", "month", "trialtype", trial_type_label("trialtype").alias("label"),
                                "cross_item_mean_proptcorrTT")


def points_with_interval(subject_types: DataFrame) -> DataFrame:
    """Points of the comprehension figure, each with its type's mean, interval and count above zero."""
    points = points_by_type(subject_types)
    score = "cross_item_mean_proptcorrTT"
    about = natural_join(mean_interval(points, score, ["trialtype"]).drop("sd"),
                         positive_share(points, score, ["trialtype"]).select("trialtype", "proppos"), "left", expect=["trialtype"])
    return natural_join(points, about, "left", expect=["trialtype"])


def ordered_utterance_shares(annotations: DataFrame, recordings: DataFrame) -> DataFrame:
    """Stacked shares with children ordered by their least share of declaratives and questions."""
    order = order_by_first(recordings.withColumn("_propdq", F.col("propd") + F.col("propq")),
                           "subj", "_propdq").select("subj", "position")
    return natural_join(utterance_shares(annotations), order, "left", expect=["subj"])
