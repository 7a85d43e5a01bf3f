"""Quality rules by distribution divergence, in DataFrame functions only.

Each document's histograms of character classes and of common words are held against the
histogram of its language (summed over the corpus) by the Jensen-Shannon distance; beside
that stand the plain counts (short texts, repeated passages). Cases: a null or empty text has
no words and fails the base rule; a document shorter than ``min_words`` is not judged by its
distances; a null language is judged by the character classes of the whole corpus alone;
repeated rows are judged each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexigaze.llm.common import texts, written

# Frequent short words of English, German, French and Spanish.
COMMON_WORDS = ["the", "of", "and", "to", "in", "is", "that", "der", "die", "und", "den", "zu", "von", "das",
                "le", "les", "et", "des", "un", "est", "el", "los", "las", "en", "de", "la", "que", "a"]
CLASSES = ["lower", "upper", "digit", "space", "symbol", "other_ascii", "beyond_ascii"]
WINDOW = 8
_BLANK = " \t\n\x0b\x0c\r"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "\\'") + "'"


def features(docs: DataFrame) -> DataFrame:
    """Counts of every document; one pass over the text, no shuffle."""
    blank = F.lit(_BLANK)
    df = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("t"))
    df = df.select(
        "doc_id", "lang", F.char_length("t").alias("n_chars"),
        F.expr(f"CASE WHEN btrim(t, {_lit(_BLANK)}) = '' THEN CAST(array() AS array<string>) ELSE split(btrim(t, {_lit(_BLANK)}), '[ \\\\t-\\\\r]+') END").alias("words"),
        # what is left without the most frequent characters is short, so the class counts cost little
        F.regexp_replace("t", "[a-z ]+", "").alias("rare"),
        F.filter(F.split("t", "\n"), lambda line: F.btrim(line, blank) != "").alias("lines"))
    df = df.select(
        "doc_id", "lang", "n_chars", "words", "rare",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("ids"))
    hits = F.filter("words", lambda w: w.isin(COMMON_WORDS))
    df = df.select("*", hits.alias("hits"), _count("[^#*$%&|<>]+").alias("symbol"), _count("[^A-Z]+").alias("upper"),
                   _count("[^0-9]+").alias("digit"), _count("[^\\x00-\\x1F!-/:-@\\[-`{-\\x7F]+").alias("ascii_rest"),
                   _count("[\\x00-\\x7F]+").alias("beyond_ascii"))
    # hashes of 2, 4 and 8 words from hashes of 1, 2 and 4
    for step in (1, 2, 4):
        df = df.withColumn("ids", F.expr(f"zip_with(ids, slice(ids, {step + 1}, size(ids)), (a, b) -> xxhash64(a, b))"))
    df = df.withColumn("windows", F.expr(f"slice(ids, 1, greatest(size(ids) - {WINDOW - 1}, 0))"))
    space = F.col("n_chars") - F.col("word_chars")
    blanks = F.char_length(F.regexp_replace("rare", "[^\\t-\\r]+", ""))  # blanks other than the space itself
    other = F.col("ascii_rest") - F.col("symbol") - blanks
    lower = F.col("n_chars") - space - F.col("upper") - F.col("digit") - F.col("symbol") - other - F.col("beyond_ascii")
    counts = F.array(*[c.cast("double") for c in (lower, F.col("upper"), F.col("digit"), space, F.col("symbol"), other, F.col("beyond_ascii"))])
    common = F.array(*[(F.size("hits") - F.size(F.array_remove("hits", w))).cast("double") for w in COMMON_WORDS])
    return df.select("doc_id", "lang", "n_words", "word_chars", F.col("symbol").cast("long").alias("n_symbols"), "n_dup_lines",
                     _repeated().alias("n_repeat_words"), counts.alias("chars"),
                     F.concat(common, F.array((F.col("n_words") - F.size("hits")).cast("double"))).alias("commons"))


def _count(others: str) -> Column:
    return F.char_length(F.regexp_replace("rare", others, ""))


def _repeated() -> Column:
    """Words in windows found twice or more: windows sorted with their places, those equal to a neighbour kept."""
    return F.expr(f"""
        CASE WHEN size(array_distinct(windows)) = size(windows) THEN 0L ELSE
        aggregate(array_sort(flatten(transform(
            array(array_sort(transform(windows, (h, i) -> struct(h AS h, i AS i)))),
            s -> transform(filter(transform(s, (x, k) -> struct(x.i AS i,
                (k > 0 AND s[greatest(k - 1, 0)].h = x.h) OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].h = x.h) AS twice)),
                y -> y.twice), y -> y.i)))),
            named_struct('covered', 0L, 'last', -{WINDOW}),
            (a, i) -> named_struct('covered', a.covered + least({WINDOW}, i - a.last), 'last', i),
            a -> a.covered) END""")


def _share(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1.0)))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance of two arrays of shares, 0 to 1 (base 2); null if either is null."""
    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def references(facts: DataFrame, min_words: int) -> DataFrame:
    """Shares of classes and common words per language, and under the null language of all; sums of partial sums.

    Documents that fail the base rule or hold a symbol for every tenth word don't count as references.
    """
    sound = facts.where((F.col("n_words") >= min_words) & ~F.col("base_failed") & (10 * F.col("n_symbols") <= F.col("n_words")))
    sums = [F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(len(CLASSES))] + [
        F.sum(F.col("commons")[i]).alias(f"w{i}") for i in range(len(COMMON_WORDS) + 1)]
    rows = sound.where("lang IS NOT NULL").groupBy("lang").agg(*sums).unionByName(
        sound.agg(F.lit(None).cast("string").alias("lang"), *sums))
    return rows.select(F.col("lang").alias("ref_lang"),
                       _share(F.array(*[f"c{i}" for i in range(len(CLASSES))])).alias("ref_chars"),
                       _share(F.array(*[f"w{i}" for i in range(len(COMMON_WORDS) + 1)])).alias("ref_commons"))


def judge(docs: DataFrame, min_words: int = 50, max_char_distance: float = 0.2, max_word_distance: float = 0.45) -> DataFrame:
    """One row per document: the base counts, both distances (null below ``min_words``) and ``kept``.

    The counts are written once to the shared folder, since the references need all of them
    before the first document can be judged.
    """
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    facts = written(features(docs).withColumn("base_failed", base))
    refs = references(facts, min_words)
    both = facts.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    long = F.col("n_words") >= min_words
    both = both.withColumn("char_distance", F.when(long, jensen_shannon(_share(F.col("chars")), F.col("ref_chars")))).withColumn(
        "word_distance", F.when(long & F.col("lang").isNotNull(), jensen_shannon(_share(F.col("commons")), F.col("ref_commons"))))
    far = F.coalesce(F.col("char_distance") > max_char_distance, F.lit(False)) | F.coalesce(
        F.col("word_distance") > max_word_distance, F.lit(False))
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       (~F.col("base_failed") & ~far).alias("kept"),
                       F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))
