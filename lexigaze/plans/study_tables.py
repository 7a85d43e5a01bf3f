"""The library's input tables, derived from general-purpose tables.

``events`` plays the tracker log: a user is an infant, three days are a trial (one hour
is read as 100 ms), five trials are a session, the first sign-up of a trial is the target
onset, views fall on the target and clicks on the distractor. ``lineitem`` with its order
and part plays the annotated words. Customers and users map onto the same infants, so
their number grows with the data on both sides.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from lexigaze.operators import gaze, home, looking, merge
from lexigaze.session import scratch, stable
from lexigaze.sources import sinks

TARGETS = ["ball", "car", "juice", "milk"]
CARRIERS = ["can", "do", "look", "where"]
TRIALS_PER_SESSION = 5
TRIAL_US = 3 * 24 * 3600 * 1_000_000
US_PER_MS = 36_000_000.0
DURATION_MS = 25.0
SPEAKERS = ["MOT", "FAT", "CHI", "TOY", "TVN", "TVF", "TVM", "TVS", "TVB", "SIS"]
UTTERANCES = ["d", "q", "i", "n", "r", "s", "u"]
TESTED_BRANDS = [f"Brand#{i}" for i in range(1, 9)]


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


class StudyTables:
    """Lazily built tables over one folder of Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ------------------------------------------------------------------ lab

    @cached_property
    def _log(self) -> DataFrame:
        seconds = F.expr("cast(cast(ts - timestamp_ntz'2024-01-01 00:00:00' as interval second) as decimal(20,6))")
        user, block = F.col("user_id"), F.col("block")
        return (
            self.read("events").select("user_id", "event_type", "value",
                                       (seconds * 1_000_000).cast("long").alias("us"))
            .withColumn("block", F.floor(F.col("us") / TRIAL_US))
            .withColumn("ms", (F.col("us") - block * TRIAL_US) / US_PER_MS)
            .withColumn("month", F.when(block < TRIALS_PER_SESSION, "06").otherwise("12"))
            .withColumn("subj", F.concat(F.when(user % 5 == 0, "ns").otherwise(""), user.cast("string")))
            .withColumn("RECORDING_SESSION_LABEL", F.concat_ws("_", "subj", "month"))
            .withColumn("TRIAL_INDEX", (block % TRIALS_PER_SESSION + 1).cast("int")))

    @cached_property
    def fixations(self) -> DataFrame:
        user, block, target = F.col("user_id"), F.col("block"), F.col("target")
        practice = (block == 9) & (user % 7 == 0)
        left = user % 2 == 0
        sides = ["[320,512]", "[960,512]"]
        pair = F.when(F.col("unrelated"), F.when(target.isin("ball", "milk"), "ball_milk").otherwise("car_juice")
                      ).otherwise(F.when(target.isin("ball", "car"), "ball_car").otherwise("juice_milk"))
        other = F.when(F.split("pair", "_")[0] == target, F.split("pair", "_")[1]).otherwise(
            F.split("pair", "_")[0])
        return (
            self._log
            .withColumn("unrelated", (block + user) % 2 == 0)
            .withColumn("target", _pick(TARGETS, (block + F.floor(user / 2)) % 4))
            .withColumn("carrier", _pick(CARRIERS, block % 4))
            .withColumn("pair", pair)
            .select(
                "RECORDING_SESSION_LABEL",
                F.when(F.col("event_type") == "view", "TARGET").when(
                    F.col("event_type") == "click", "DISTRACTOR").otherwise(".").alias(
                    "CURRENT_FIX_INTEREST_AREA_LABEL"),
                "TRIAL_INDEX",
                F.when((user + block) % 11 == 0, -1.0).otherwise(1000.0).alias("RT"),
                F.lit(0.0).alias("TRIAL_START_TIME"),
                F.when(F.col("event_type") != "error", F.concat("carrier", F.lit("_"), target, F.lit(".wav"))
                       ).alias("audiotarget"),
                "carrier", F.concat(other, F.lit(".jpg")).alias("distractorimage"),
                F.concat(target, F.lit(".jpg")).alias("targetimage"),
                F.when(left, sides[1]).otherwise(sides[0]).alias("distractorloc"),
                F.when(left, sides[0]).otherwise(sides[1]).alias("targetloc"),
                "pair", F.when(left, "L").otherwise("R").alias("targetside"),
                F.when(practice, "p1").otherwise(F.col("TRIAL_INDEX").cast("string")).alias("trial"),
                F.when(practice, ".").when(F.col("unrelated"), "between").otherwise("within").alias("trialtype"),
                F.when(practice, "y").otherwise("n").alias("practice"),
                F.col("ms").alias("fix_start"),
                (F.col("ms") + F.col("value") * DURATION_MS).alias("fix_end")))

    @cached_property
    def messages(self) -> DataFrame:
        return (self._log.filter(F.col("event_type") == "signup")
                .groupBy("RECORDING_SESSION_LABEL", "TRIAL_INDEX")
                .agg(F.min("ms").alias("CURRENT_MSG_TIME"))
                .withColumn("CURRENT_MSG_TEXT", F.lit(gaze.ONSET_MESSAGE)).withColumn("RT", F.lit("1000")))

    @cached_property
    def onsets(self) -> DataFrame:
        return gaze.key_press_messages(self.messages)

    @cached_property
    def labelled(self) -> DataFrame:
        return gaze.label_fixations(gaze.drop_aborted(self.fixations), self.onsets)

    @cached_property
    def trials(self) -> DataFrame:
        # one row per trial, read by the accounting and every measure: written once
        return stable(looking.trial_scores(self.labelled))

    @cached_property
    def bins(self) -> DataFrame:
        return gaze.trial_bins(self.fixations, self.messages)

    @cached_property
    def words(self) -> DataFrame:
        return looking.word_means(self.trials)

    @cached_property
    def words_by_type(self) -> DataFrame:
        return looking.word_means(self.trials, by_type=True)

    @cached_property
    def counted(self) -> DataFrame:
        return looking.with_trial_counts(self.words_by_type)

    @cached_property
    def subjects(self) -> DataFrame:
        return looking.subject_means(self.words)

    @cached_property
    def subject_types(self) -> DataFrame:
        # a few rows per infant, read by a dozen branches: written once
        return stable(looking.subject_type_means(self.counted))

    @cached_property
    def single_condition(self) -> DataFrame:
        """Subjects of the month without a score in both conditions."""
        return looking.single_condition_subjects(looking.kept(self.subject_types, "06"), ["subj"])

    @cached_property
    def tested_types(self) -> DataFrame:
        """Subject scores the tests run on: month 06, no outliers, both conditions."""
        return looking.both_types(looking.kept(self.subject_types, "06"), self.single_condition)

    @cached_property
    def items(self) -> DataFrame:
        excluded = looking.single_condition_subjects(looking.kept(self.subject_types))
        return looking.item_means(self.counted, excluded, looking.item_pairs(self.trials))

    # scenarios: all words, and without one item of some subjects

    @cached_property
    def scenario_types(self) -> DataFrame:
        """Subject means per trial type in both scenarios; read by the tests and their exclusions."""
        return stable(looking.kept(looking.subject_type_means(
            looking.in_scenarios(self.counted, self.in_debt, "milk"), ["scenario"]), "06"))

    @cached_property
    def scenario_subjects(self) -> DataFrame:
        return looking.kept(looking.subject_means(looking.in_scenarios(self.words, self.in_debt, "milk"), ["scenario"]), "06")

    @cached_property
    def scenario_single(self) -> DataFrame:
        return looking.single_condition_subjects(self.scenario_types, ["scenario", "subj"])

    # --------------------------------------------------------------- written

    REPORT = StructType([StructField("user_id", LongType()), StructField("event_type", StringType()), StructField("value", DoubleType()), StructField("note", StringType())])

    @cached_property
    def event_reports(self) -> str:
        """Folder of tab-separated reports of the events, in two folders whose files order their columns differently."""
        path = scratch(self.spark)
        late = F.col("event_id") % 2 == 1
        rows = self.read("events").select("event_id", "user_id", "event_type", F.col("value").cast("string").alias("value"),
                                          F.when(F.col("event_id") % 3 == 0, "").otherwise("x").alias("note"))
        for folder, test, order in (("early", ~late, ["user_id", "event_type", "value", "note"]), ("late", late, ["note", "event_id", "value", "user_id", "event_type"])):
            rows.filter(test).select(order).write.option("emptyValue", "").csv(f"{path}/{folder}", sep="\t", header=True)
        return path

    @cached_property
    def spoken_words(self) -> str:
        """Words per child, month and speaker, in buckets by child within folders by month."""
        words = self.annotations.groupBy("subj", "month", "speaker").agg(F.count(F.lit(1)).alias("words"))
        return sinks.write_buckets(words, "subj", 8)

    @cached_property
    def children(self) -> str:
        """One row per child, in the same buckets."""
        born = self.read("customer").groupBy(F.floor(F.col("c_custkey") / 10).cast("string").alias("subj")).agg(F.min("c_custkey").alias("born"))
        return sinks.write_buckets(born, "subj", 8, by_month=False)

    # ----------------------------------------------------------------- home

    @cached_property
    def annotations(self) -> DataFrame:
        # joined are narrow codes; they become texts after the joins
        line = self.read("lineitem").select(
            "l_orderkey", "l_partkey", (F.col("l_suppkey") % 10).alias("speaker"), (F.col("l_linenumber") - 1).alias("utterance"),
            (F.col("l_discount") >= 0.05).alias("present"), (F.col("l_linestatus") == "F").alias("audio"))
        orders = self.read("orders").select("o_orderkey", F.floor(F.col("o_custkey") / 10).alias("child"), F.month("o_orderdate").alias("at"))
        part = self.read("part").select("p_partkey", "p_brand")
        joined = (line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
                  .join(part, F.col("l_partkey") == F.col("p_partkey")))
        return joined.select(
            F.col("child").cast("string").alias("subj"),
            F.lpad(F.col("at").cast("string"), 2, "0").alias("month"),
            F.when(F.col("audio"), "audio").otherwise("video").alias("audio_video"),
            _pick(SPEAKERS, F.col("speaker")).alias("speaker"),
            _pick(UTTERANCES, F.col("utterance")).alias("utterance_type"),
            F.when(F.col("present"), "y").otherwise("n").alias("object_present"),
            F.col("p_brand").alias("basic_level"),
        ).withColumn("SubjectNumber", F.concat_ws("_", "subj", "month"))

    @cached_property
    def recordings(self) -> DataFrame:
        return home.recording_summary(self.annotations, TESTED_BRANDS)

    @cached_property
    def recordings06(self) -> DataFrame:
        return home.recording_summary(self.annotations, TESTED_BRANDS, "06")

    @cached_property
    def lab_home(self) -> DataFrame:
        return stable(merge.lab_home(self.subject_types, self.subjects, self.recordings06))

    @cached_property
    def pooled(self) -> DataFrame:
        return merge.pooled_shares(self.lab_home)

    @cached_property
    def coders(self) -> DataFrame:
        """Every word coded twice; the second coder slips to the next code now and then."""
        slip = F.col("l_orderkey") % 10 == 0
        first = F.col("l_linenumber") - 1
        present = F.col("l_discount") >= 0.05
        return self.read("lineitem").select(
            _pick(UTTERANCES, first).alias("orig_utt_type"),
            _pick(UTTERANCES, F.when(slip, (first + 1) % 7).otherwise(first)).alias("new_utt_type"),
            F.when(present, "y").otherwise("n").alias("orig_present"),
            F.when(present != (F.col("l_tax") >= 0.08), "y").otherwise("n").alias("new_present"),
            F.when(F.col("l_linestatus") == "F", "audio").otherwise("video").alias("audio_video"))

    @cached_property
    def customers(self) -> DataFrame:
        """Orders and spending per customer: a count with ties and an amount without."""
        return self.read("orders").groupBy("o_custkey").agg(
            F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("spent"))

    @cached_property
    def in_debt(self) -> DataFrame:
        """A list of infants from a questionnaire: those of customers with a negative balance."""
        return self.read("customer").filter(F.col("c_acctbal") < 0).select(
            F.floor(F.col("c_custkey") / 10).cast("string").alias("subj")).distinct()
