"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexigaze.llm import (
    bond, decontamination, language_id, lexical, line_dedup, mixing, near_dedup, packing, pitman_yor, quality_model, quality_rules,
    repeats, secrets,
)
from lexigaze.llm.common import documents, texts

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


@query
def op10_quality_rules(spark, folder):
    return quality_rules.judge(documents(spark, folder))


@query
def op3_line_dedup(spark, folder):
    return line_dedup.dedup_lines(documents(spark, folder)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL["op3_line_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line FROM d, unnest(range(1, len(ls) + 1)) AS r(i)),
k AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.i, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query
def op5_decontamination(spark, folder):
    found = decontamination.decontaminate(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query
def op6_packing(spark, folder):
    return packing.pack_documents(documents(spark, folder))


@query
def op1_secret_scan(spark, folder):
    return secrets.scan_secrets(documents(spark, folder)).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


@query
def op8_quality_classifier(spark, folder):
    return quality_model.classify(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


@query
def op9_language_id(spark, folder):
    return language_id.identify(documents(spark, folder))


@query
def op4_near_dedup(spark, folder):
    return near_dedup.near_classes(documents(spark, folder))


@query
def op2_repeated_substrings(spark, folder):
    return repeats.remove_repeats(documents(spark, folder)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_pitman_yor(spark, folder):
    return pitman_yor.score_held_out(documents(spark, folder))


@query
def op11_lexical_search(spark, folder):
    return lexical.rank_documents(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


@query
def op12_source_mixing(spark, folder):
    return mixing.mix(documents(spark, folder))


@query
def op13_hard_negatives(spark, folder):
    return bond.hard_negatives(bond.relabelled(bond.usable(spark.read.parquet(f"{folder}/embeddings.parquet"))))


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL["op5_decontamination"] = rf"""
WITH i AS (SELECT item_id, {_W} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, CASE WHEN len(w) < 13 THEN array_to_string(w, ' ') ELSE array_to_string(w[k:k + 12], ' ') END AS win, least(len(w), 13) AS n
  FROM i, unnest(range(1, greatest(len(w) - 11, 2))) AS r(k) WHERE len(w) > 0),
d AS (SELECT doc_id, {_W} AS w FROM documents),
dw AS (SELECT doc_id, s.n, k, array_to_string(w[k:k + s.n - 1], ' ') AS win
  FROM d, (SELECT DISTINCT n FROM iw) s, unnest(range(1, greatest(len(w) - s.n + 2, 1))) AS r(k)),
h AS (SELECT DISTINCT dw.doc_id, dw.k, dw.n, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(k, k + n)) AS r(p) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""

_COMMON = ", ".join(f"'{w}'" for w in quality_rules.COMMON_WORDS)
_SHARES = "list_transform({0}, lambda x: x / greatest(list_sum({0}), 1.0))"
_PART = "CASE WHEN {0} > 0 THEN {0} * log2({0} / (({0} + {1}) / 2)) ELSE 0.0 END"


def _js(a: str, b: str) -> str:
    p, q = f"list_extract({_SHARES.format(a)}, j)", f"list_extract({_SHARES.format(b)}, j)"
    return f"round(sqrt(greatest(list_sum(list_transform(range(1, len({a}) + 1), lambda j: {_PART.format(p, q)} + {_PART.format(q, p)})) / 2, 0.0)), 6)"


SQL["op10_quality_rules"] = rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
a AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, k, array_to_string(w[k:k + 7], ' ') AS win FROM a, unnest(range(1, greatest(len(w) - 6, 1))) AS r(k)),
z AS (SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1),
v AS (SELECT doc_id, count(DISTINCT p) AS n FROM z, unnest(range(k, k + 8)) AS r(p) GROUP BY doc_id),
f AS (SELECT a.doc_id, lang, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(v.n, 0)::BIGINT AS n_repeat_words,
  [length(regexp_replace(t, '[^a-z]', '', 'g')), length(regexp_replace(t, '[^A-Z]', '', 'g')), length(regexp_replace(t, '[^0-9]', '', 'g')),
   length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')), length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')),
   length(regexp_replace(t, '[^\x00-\x08\x0E-\x1F!"''()+,\-./:;=?@\[\\\]^_`{{}}~\x7F]', '', 'g')), length(regexp_replace(t, '[\x00-\x7F]', '', 'g'))]::DOUBLE[] AS chars,
  list_append(list_transform([{_COMMON}], lambda c: len(list_filter(w, lambda x: x = c))::DOUBLE),
    len(list_filter(w, lambda x: x NOT IN ({_COMMON})))::DOUBLE) AS commons
  FROM a LEFT JOIN v ON a.doc_id = v.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
s AS (SELECT * FROM b WHERE n_words >= 50 AND NOT base_failed AND 10 * n_symbols <= n_words),
y AS (SELECT lang, false AS whole, chars, commons FROM s WHERE lang IS NOT NULL UNION ALL SELECT NULL, true, chars, commons FROM s),
rc AS (SELECT lang, whole, list(x ORDER BY j) AS ref_chars FROM (SELECT lang, whole, j, sum(chars[j]) AS x FROM y, unnest(range(1, 8)) AS r(j) GROUP BY ALL) GROUP BY ALL),
rw AS (SELECT lang, whole, list(x ORDER BY j) AS ref_commons FROM (SELECT lang, whole, j, sum(commons[j]) AS x FROM y, unnest(range(1, {len(quality_rules.COMMON_WORDS) + 2})) AS r(j) GROUP BY ALL) GROUP BY ALL),
j AS (SELECT b.*, CASE WHEN n_words >= 50 AND ref_chars IS NOT NULL THEN {_js("chars", "ref_chars")} END AS char_distance,
  CASE WHEN n_words >= 50 AND b.lang IS NOT NULL AND ref_commons IS NOT NULL THEN {_js("commons", "ref_commons")} END AS word_distance
  FROM b LEFT JOIN rc ON b.lang IS NOT DISTINCT FROM rc.lang LEFT JOIN rw ON b.lang IS NOT DISTINCT FROM rw.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(char_distance > 0.2, false) AND NOT coalesce(word_distance > 0.45, false) AS kept, char_distance, word_distance FROM j
"""

_TERM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL["op11_lexical_search"] = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, {_TERM} AS w FROM documents),
c AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
i AS (SELECT DISTINCT item, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS item, item_id, {_TERM} AS w FROM benchmark)),
p AS (SELECT doc, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM i) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, c GROUP BY term, docs),
s AS (SELECT item, item_id, doc, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM i JOIN f USING (term) JOIN p USING (term), c GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""

# Rates are found by halving an interval 64 times, copies by a running total over each source.
SQL["op12_source_mixing"] = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce('=' || source, '-') AS key,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
s AS (SELECT *, 2.0::DOUBLE * source_size AS limit_, row_number() OVER (ORDER BY limit_ / weight, source NULLS LAST) AS place FROM (
  SELECT key, source, sum(size)::BIGINT AS source_size, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight
  FROM d GROUP BY key, source)),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(limit_) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
  / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (SELECT key, source_size, CASE WHEN limit_ <= level * weight THEN limit_ ELSE weight * (SELECT arg_min(level, place) FROM l WHERE limit_ > level * weight) END AS target FROM l),
c AS (SELECT key, size, count(*)::DOUBLE AS n FROM d WHERE size > 0 GROUP BY ALL),
b AS (SELECT key, source_size, target, CASE WHEN target > 0 THEN least(0.0::DOUBLE, ln(target / source_size)) ELSE 0.0::DOUBLE END AS low, ln(2.0::DOUBLE) + 0.01::DOUBLE AS high, 0 AS i FROM t
  UNION ALL
  SELECT b.key, source_size, target, CASE WHEN sum(n * size * least(2.0::DOUBLE, exp((low + high) / 2 * size))) < target THEN (low + high) / 2 ELSE low END,
    CASE WHEN sum(n * size * least(2.0::DOUBLE, exp((low + high) / 2 * size))) < target THEN high ELSE (low + high) / 2 END, i + 1
  FROM b JOIN c ON b.key = c.key WHERE i < 64 GROUP BY b.key, source_size, target, low, high, i),
m AS (SELECT key, source_size, target, CASE WHEN target >= 2 * source_size THEN ln(2.0::DOUBLE) + 0.01::DOUBLE ELSE (low + high) / 2 END AS multiplier
  FROM b QUALIFY row_number() OVER (PARTITION BY key ORDER BY i DESC) = 1),
r AS (SELECT d.*, source_size, target, least(2.0::DOUBLE, exp(multiplier * size)) AS rate FROM d JOIN m ON d.key = m.key),
q AS (SELECT *, floor(rate)::BIGINT AS copies, CASE WHEN size > 0 THEN rate - floor(rate) ELSE 0 END AS part FROM r),
z AS (SELECT *, floor(target + 0.5) - sum(copies * size) OVER (PARTITION BY key) AS missing,
  coalesce(sum(CASE WHEN part > 0 THEN size ELSE 0 END) OVER (PARTITION BY key ORDER BY CASE WHEN part > 0 THEN u / part END NULLS LAST, row
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
SELECT doc_id, source, size, source_size, round(target, 6) AS target, round(rate, 6) AS rate,
  (copies * size + CASE WHEN part > 0 THEN greatest(0, least(size, missing - before)) ELSE 0 END)::BIGINT AS taken FROM z
"""

SQL["op13_hard_negatives"] = r"""
WITH v AS (SELECT row_number() OVER () AS row, vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, v.row, v.vec_id, a.label = v.label AS same, list_dot_product(a.e, v.e)::BIGINT AS score
  FROM v AS a JOIN v ON a.row <> v.row WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY s.score DESC, s.vec_id NULLS LAST))::INTEGER AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score QUALIFY rank <= 5
"""
