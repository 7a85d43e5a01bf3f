"""Home recordings: word annotations to one row per recording."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexigaze.functions.nulls import (
    fill_zero, is_one_of, n_distinct, n_rows, natural_join, ratio, spread_counts, to_number,
)

RECORDING = ["subj", "month", "audio_video"]
PARENTS = ["MOT", "FAT"]
DEVICES = ["TOY", "TVN", "TVF", "TVM", "TVS", "TVB"]
UTTERANCE_TYPES = ["d", "i", "q", "r", "s", "n"]
PRESENCE = ["n", "y"]

# fixed values: spellings counted as one of the words tested in the lab
TESTED_WORDS = [
    "baby", "babe", "baby+doll",
    "ball", "bally",
    "blanket", "blankey", "blanky",
    "book", "books",
    "bottle", "baba", "ba",
    "car", "car+car",
    "diaper", "diape", "diapey", "diapers", "diatee", "didey", "diadey",
    "foot", "footsy", "footy", "feet", "feetsie", "footsie", "feetsy", "feety",
    "hair", "hairs",
    "hand",
    "juice", "juices", "juice+box", "juice+boxes", "juicey",
    "milk", "milkies", "milky", "milk+water", "milk+jug", "milks",
    "mouth",
    "nose", "nosey",
    "spoon", "spoony",
    "stroller",
]


# ------------------------------------------------------------ noun onset

def noun_onset(annotations: DataFrame) -> DataFrame:
    """Age in months at the child's first own noun."""
    return (annotations.filter(F.col("speaker") == "CHI").groupBy("subj")
            .agg(F.min(to_number("month")).alias("noun_chi_onset")))


def with_noun_onset(annotations: DataFrame) -> DataFrame:
    """All annotations, each with its child's noun onset (NULL if none yet)."""
    return natural_join(annotations, noun_onset(annotations), "left", expect=["subj"])


# --------------------------------------- the small aggregates, one by one

def tested_word_counts(annotations: DataFrame, words: Sequence[str] = TESTED_WORDS) -> DataFrame:
    return (annotations.filter(is_one_of("basic_level", words)).groupBy(*RECORDING)
            .agg(n_rows().alias("num_exp_tokens"), n_distinct("basic_level").alias("num_exp_types")))


def parent_counts(annotations: DataFrame) -> DataFrame:
    return spread_counts(annotations, RECORDING, "speaker", PARENTS)


def device_counts(annotations: DataFrame) -> DataFrame:
    return spread_counts(annotations, RECORDING, "speaker", DEVICES)


def utterance_counts(annotations: DataFrame) -> DataFrame:
    return spread_counts(annotations, RECORDING, "utterance_type", UTTERANCE_TYPES)


def presence_share(annotations: DataFrame, words: Sequence[str] | None = None) -> DataFrame:
    """Object presence counts and share; NULL share unless both answers occur."""
    end = "" if words is None else "_exp"
    rows = annotations if words is None else annotations.filter(is_one_of("basic_level", words))
    wide = spread_counts(rows, RECORDING, "object_present", PRESENCE)
    return (wide.withColumn(f"prop_op{end}", ratio("y", F.col("n") + F.col("y")))
            .withColumnsRenamed({"y": f"y_op{end}", "n": f"n_op{end}"}))


def child_counts(annotations: DataFrame) -> DataFrame:
    return spread_counts(annotations, RECORDING, "speaker", ["CHI"])


def child_types(annotations: DataFrame) -> DataFrame:
    return (annotations.filter(F.col("speaker") == "CHI").groupBy(*RECORDING)
            .agg(n_distinct("basic_level").alias("CHItypes")))


# ------------------------------------------------------------- entropy

def entropy_bits(counts: Sequence[Column | str]) -> Column:
    """Plug-in entropy (base 2) of the shares of ``counts``; NULL when all are zero.

    Written out term by term, so it stays inside generated code.
    """
    cols = [F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in counts]
    total = sum(cols[1:], cols[0])
    terms = [F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(F.lit(0.0)) for c in cols]
    return F.when(total > 0, sum(terms[1:], terms[0]))


# ------------------------------------------------- the recording table

def _share_columns(df: DataFrame) -> DataFrame:
    per_token = lambda c: ratio(c, "numtokens")
    tech = sum([F.col(c) for c in DEVICES[1:]], F.col(DEVICES[0]))
    shares = {u: per_token(u) for u in UTTERANCE_TYPES}
    order = ["d", "q", "s", "r", "n", "i"]
    return (
        df.withColumns({"prop_mom": per_token("MOT"), "prop_dad": per_token("FAT"),
                        "tech": tech, **{f"prop{u}": shares[u] for u in UTTERANCE_TYPES},
                        "type_token_ratio": per_token("numtypes"),
                        "exp_type_ratio": ratio("num_exp_types", "numtypes"),
                        "exp_token_ratio": per_token("num_exp_tokens"),
                        "ent_subj_av": entropy_bits(order)})
        .withColumn("prop_parent", F.col("prop_mom") + F.col("prop_dad"))
        .withColumn("prop_tech", per_token("tech"))
        .withColumn("sum_prop_ut", F.bround(
            sum([F.col(f"prop{u}") for u in order[1:]], F.col(f"prop{order[0]}")), 2))
    )


COUNT_COLUMNS = ["MOT", "FAT", "num_exp_tokens", "num_exp_types", *UTTERANCE_TYPES, *DEVICES,
                 "n_op", "y_op", "prop_op", "n_op_exp", "y_op_exp", "prop_op_exp", "CHI", "CHItypes"]


LABELLED = ["subj", "month", "SubjectNumber", "audio_video"]


def recording_counts(annotations: DataFrame, words: Sequence[str] = TESTED_WORDS) -> DataFrame:
    """Base counts and the eight small aggregates of every recording, from one scan.

    Annotations are first counted per recording, speaker and word, before the shuffle already; a missing
    speaker or word is one more value. These cells are dealt by recording once. The first cell of a speaker
    and the first of a word carry a mark there, so that distinct values are sums as well and no row is made
    to be counted. All steps group by the recording label as well; ``label_conflicts`` must be empty
    for that to be the same. A presence share is missing, hence later 0, when only one answer occurs.
    """
    def n(test: Column, name: str) -> Column:
        return F.count_if(test).alias(name)

    def present(value: str) -> Column:
        return F.col("object_present") == value

    def first_of(column: str, other: str) -> Column:
        return F.row_number().over(Window.partitionBy(*LABELLED, column).orderBy(other)) == 1

    kinds = ["tokens", *UTTERANCE_TYPES, "n_op", "y_op"]
    cells = annotations.groupBy(*LABELLED, "speaker", "basic_level").agg(
        n_rows().alias("tokens"), *[n(F.col("utterance_type") == u, u) for u in UTTERANCE_TYPES], n(present("n"), "n_op"), n(present("y"), "y_op"))
    cells = (cells.repartition(*LABELLED).withColumn("new_speaker", first_of("speaker", "basic_level"))
             .withColumn("new_word", first_of("basic_level", "speaker")))
    tested = is_one_of("basic_level", words)

    def total(c: str, test: Column | None = None) -> Column:
        return F.coalesce(F.sum(c if test is None else F.when(test, F.col(c))), F.lit(0))

    counts = cells.groupBy(*LABELLED).agg(
        *[total(k).alias("numtokens" if k == "tokens" else k) for k in kinds],
        *[total("tokens", F.col("speaker") == s).alias(s) for s in [*PARENTS, *DEVICES, "CHI"]],
        total("tokens", tested).alias("num_exp_tokens"), total("n_op", tested).alias("n_op_exp"), total("y_op", tested).alias("y_op_exp"),
        n(F.col("new_speaker"), "numspeakers"), n(F.col("new_word"), "numtypes"), n(F.col("new_word") & tested, "num_exp_types"),
        n(F.col("speaker") == "CHI", "CHItypes"))

    def share(y: str, no: str) -> Column:
        return F.when((F.col(y) > 0) & (F.col(no) > 0), ratio(y, F.col(y) + F.col(no)))

    return counts.withColumns({"prop_op": share("y_op", "n_op"), "prop_op_exp": share("y_op_exp", "n_op_exp")})


def recording_summary(annotations: DataFrame, words: Sequence[str] = TESTED_WORDS,
                      month: str | None = None) -> DataFrame:
    """One row per recording: counts, shares, entropy, noun onset, talker status.

    A child's noun onset is the least month of its recordings with a word of its own, so it is
    found among the child's few rows. With ``month`` only that month's recordings are returned; of
    other months only the child's own words are read on, as one count per child and month.
    """
    if month is not None:
        inside = F.col("month") == month
        annotations = annotations.filter(inside | (F.col("speaker") == "CHI")).withColumns(
            {c: F.when(inside, F.col(c)) for c in ["SubjectNumber", "audio_video", "utterance_type", "object_present", "basic_level"]})
    filled = fill_zero(recording_counts(annotations, words), COUNT_COLUMNS)
    onset = F.min(F.when(F.col("CHI") > 0, to_number("month"))).over(Window.partitionBy("subj"))
    rows = filled.withColumn("noun_chi_onset", onset)
    if month is not None:
        rows = rows.filter(F.col("month") == month)
    return _share_columns(rows).drop(*DEVICES[1:]).withColumn("posttalk", after_onset(F.col("month"), F.col("noun_chi_onset")))


def after_onset(month: Column, onset: Column) -> Column:
    """FALSE before the first noun and when there is none, TRUE from then on."""
    age = to_number(month)
    early = (age < onset) | onset.isNull()
    return F.when(early, F.lit(False)).when(~early, F.lit(True))


def label_conflicts(annotations: DataFrame) -> DataFrame:
    """Recordings that carry more than one label (expected empty)."""
    return (annotations.groupBy("subj", "month").agg(n_distinct("SubjectNumber").alias("n_labels"))
            .filter(F.col("n_labels") > 1))


# ------------------------------------------------------------- checks, shares

def odd_speaker_codes(annotations: DataFrame) -> DataFrame:
    """Speaker codes are three letters; anything else is a typing error."""
    return annotations.filter(F.length("speaker") != 3)


def missing_utterance_type(annotations: DataFrame) -> DataFrame:
    return annotations.filter(F.col("utterance_type").isNull())


def words_starting_with(annotations: DataFrame, letters: str) -> DataFrame:
    """Distinct words by first letter, in order (used to find spellings of one word)."""
    return (annotations.select("basic_level").distinct()
            .filter(F.col("basic_level").rlike(f"^[{letters}]")).orderBy("basic_level"))


def utterance_shares(annotations: DataFrame) -> DataFrame:
    """Share of each utterance type per child and medium, unclear ones ("u") left out."""
    counts = (annotations.filter(F.col("utterance_type") != "u")
              .groupBy("subj", "audio_video", "utterance_type").agg(n_rows().alias("n")))
    totals = counts.groupBy("subj", "audio_video").agg(F.sum("n").alias("total"))
    return natural_join(counts, totals, "left", expect=["subj", "audio_video"]).withColumn(
        "share", ratio("n", "total")).drop("total")
