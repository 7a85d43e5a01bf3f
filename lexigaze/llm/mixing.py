"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Among all ways to give each document a rate between 0 and 2, those rates are wanted that are
closest in entropy to one copy each and make every source's words meet its target. They have
the form min(2, exp(lambda * size)) with one multiplier a source, the maximum of a convex dual;
Newton steps find it from sums over the documents. Rates depend on a document's source and size
only, so the sums run over the counted sizes of a source, a table far smaller than the corpus.

Rates become copies: the whole part is taken, then further copies go to the documents of least
u / fraction, with u a hash of the document as a number in (0, 1), until the source's words meet
the rounded target. The last such copy of a source is cut to the words still missing, so a mix
misses no target by more than half a word.

Cases: a null or empty text has size 0 and takes nothing; a null source is a source of its own,
the last one; a null doc_id is an id like any other; repeated rows are documents each, and rows
alike in id, source and text take their copies in any order; sources without words have target 0;
an empty table gives an empty result; further columns are left behind.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexigaze.llm.common import discard, written
from lexigaze.operators.ranks import running_total

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
TOLERANCE = 1e-12
STEPS_AT_ONCE, MOST_STEPS = 4, 80


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (the source, never null), size in words, u: one row per row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)
    number = F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("key"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        ((number + 0.5) / float(1 << 52)).alias("u"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """key, source_size, target: one row per source.

    Sources in order of most * size / weight reach their limit one after the other while the level,
    words per unit of weight, rises; the first that doesn't sets the level of all that are left.
    """
    per_source = sizes.groupBy("source", "key").agg(F.sum("size").alias("source_size"))
    # one row per source: both windows are as small as the list of sources
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = per_source.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.asc_nulls_last("source"))
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    staged = ranked.withColumn("level", level).withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
    settled = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(whole)
    return staged.select("key", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(settled * F.col("weight")).alias("target"))


def _rate(most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.col("multiplier") * F.col("size")))


def _newton(cells: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """One step for every source: the words its multiplier gives, then the next multiplier.

    The step is Newton's for the logarithm of the words; one that leaves the bracket halves it.
    """
    words = F.col("n") * F.col("size") * F.col("rate")
    sums = cells.join(state.select("key", "multiplier"), "key").withColumn("rate", _rate(most)).groupBy("key").agg(
        F.sum(words).alias("words"), F.sum(F.when(F.col("rate") < most, words * F.col("size")).otherwise(F.lit(0.0))).alias("slope"))
    at, target, found = F.col("multiplier"), F.col("target"), F.col("words")
    moved = state.join(sums, "key", "left").withColumns({
        "low": F.when(found <= target, at).otherwise(F.col("low")), "high": F.when(found >= target, at).otherwise(F.col("high")),
        "step": at - F.log(F.try_divide(found, target)) * F.try_divide(found, F.col("slope")), "close": F.abs(found - target) <= TOLERANCE * target})
    inside = (F.col("step") >= F.col("low")) & (F.col("step") <= F.col("high"))
    following = F.when(inside, F.col("step")).otherwise((F.col("low") + F.col("high")) / 2)
    narrow = F.col("high") - F.col("low") <= 1e-17
    return moved.select("key", "source_size", "target", F.when(F.col("done"), at).otherwise(following).alias("multiplier"), "low", "high",
                        (F.col("done") | F.col("close") | narrow).alias("done"))


def multipliers(sizes: DataFrame, aims: DataFrame, most: int = MOST) -> DataFrame:
    """key, source_size, target, multiplier. A source at its limit gets a multiplier that fills every document."""
    cells = written(sizes.where("size > 0").groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")))
    full = math.log(most) + 0.01  # beyond it even a document of one word has the highest rate
    at_limit = F.col("target") >= F.lit(float(most)) * F.col("source_size")
    state = written(aims.select(
        "key", "source_size", "target", F.when(at_limit, F.lit(full)).otherwise(F.lit(0.0)).alias("multiplier"),
        F.least(F.lit(0.0), F.log(F.try_divide("target", "source_size"))).alias("low"), F.lit(full).alias("high"), at_limit.alias("done")))
    for _ in range(0, MOST_STEPS, STEPS_AT_ONCE):
        if state.where("NOT done").isEmpty():
            break
        moved = state
        for _ in range(STEPS_AT_ONCE):
            moved = _newton(cells, moved, most)
        moved = written(moved)
        discard(state)
        state = moved
    return state.select("key", "source_size", "target", "multiplier")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, taken: one row per row of ``docs``.

    ``weights`` go round the sources in order of their names, ``share`` is the mix's part of all
    words, ``most`` the highest number of copies. ``taken`` is the words the mix takes of a
    document, repeats counted.
    """
    sizes = written(measured(docs).withColumn("row", F.monotonically_increasing_id()))
    tilt = multipliers(sizes, targets(sizes, weights, share, most), most)
    rated = sizes.join(tilt, "key").withColumn("rate", _rate(most)).withColumn("copies", F.floor("rate")).withColumn(
        "part", F.when(F.col("size") > 0, F.col("rate") - F.col("copies")).otherwise(F.lit(0.0)))
    missing = rated.groupBy("key").agg((F.floor(F.first("target") + 0.5) - F.sum(F.col("copies") * F.col("size"))).alias("missing"))
    queue = running_total(rated.where("part > 0").withColumn("turn", F.col("u") / F.col("part")), ["key"], ["turn", "row"], "size", "before").drop("turn")
    extra = F.greatest(F.lit(0), F.least("size", F.col("missing") - F.col("before")))
    both = queue.join(missing, "key").withColumn("extra", extra).drop("missing", "before").unionByName(
        rated.where("NOT part > 0").withColumn("extra", F.lit(0).cast("long")))
    return both.select("doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), F.round("rate", 6).alias("rate"),
                       (F.col("copies") * F.col("size") + F.col("extra")).cast("long").alias("taken"))
