"""Quality rules against plain Python, and the pipeline stage by stage."""

import math
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from lexigaze.llm import decontamination, line_dedup, quality_rules
from test_near_dedup import classes_by_hand

WORD = re.compile("[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    places = defaultdict(list)
    for k in range(len(w) - 7):
        places[tuple(w[k:k + 8])].append(k)
    covered = {p for v in places.values() if len(v) > 1 for k in v for p in range(k, k + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def histograms(text):
    chars = [0] * 7
    for c in text:
        chars[0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in " \t\n\x0b\x0c\r" else
              4 if c in "#*$%&|<>" else 6 if ord(c) > 127 else 5] += 1
    w = WORD.findall(text)
    words = Counter(x for x in w if x in quality_rules.COMMON_WORDS)
    return chars, [words[x] for x in quality_rules.COMMON_WORDS] + [len(w) - sum(words.values())]


def distance(a, b):
    p, q = [x / max(sum(a), 1) for x in a], [x / max(sum(b), 1) for x in b]
    part = lambda x, m: x * math.log2(x / m) if x > 0 else 0.0
    return math.sqrt(max(sum(part(x, (x + y) / 2) + part(y, (x + y) / 2) for x, y in zip(p, q)) / 2, 0))


def judged_by_hand(rows, min_words=50):
    facts, sums = {}, defaultdict(lambda: ([0] * 7, [0] * (len(quality_rules.COMMON_WORDS) + 1)))
    for i, t, lang in rows:
        n = counts(t)
        failed = n[0] < 20 or 100 * n[4] > 30 * n[0]
        facts[i] = n, failed, lang, histograms(t or "")
        if n[0] >= min_words and not failed and 10 * n[2] <= n[0]:
            for key in {lang, None}:
                for total, own in zip(sums[key], facts[i][3]):
                    total[:] = [a + b for a, b in zip(total, own)]
    out = {}
    for i, (n, failed, lang, own) in facts.items():
        far = char = word = None
        if n[0] >= min_words and (lang in sums or lang is None):
            char = distance(own[0], sums[lang][0])
            word = distance(own[1], sums[lang][1]) if lang is not None else None
            far = char > 0.2 or (word is not None and word > 0.45)
        out[i] = (*n, failed, not failed and not far, char, word)
    return out


def check_judged(rows, got):
    want = judged_by_hand(rows)
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == w[:7]
        for a, b in ((r.char_distance, w[7]), (r.word_distance, w[8])):
            assert a is None and b is None or a == pytest.approx(b, abs=2e-6)


EDGE = [(1, None, None), (2, "", "en"), (3, " \t\n", "en"), (4, "a b c d e f g h a b c d e f g h", "en"), (5, "x " * 400, "en"), (6, "1 2 3 4 5 6 7 8", None),
        (7, "é ü\x0b#|\n\né ü\x0b#|\n ", "xx"), (8, " ".join(f"w{i}" for i in range(60)), None), (9, " ".join(f"v{i}" for i in range(60)) + "\r\n", "en"),
        (10, " ".join(f"w{i % 30}" for i in range(70)), "en"), (11, "the of and " * 2 + " ".join(f"q{i}" for i in range(70)), "en")]


def test_rules_edge(spark):
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in EDGE], DOCS)
    check_judged(EDGE, quality_rules.judge(docs).collect())
    assert quality_rules.judge(docs.where("false")).count() == 0
    assert quality_rules.judge(docs.unionByName(docs)).count() == 2 * len(EDGE)


def test_rules_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check_judged([(r.doc_id, r.text, r.lang) for r in docs.collect()], quality_rules.judge(docs).collect())


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    from lexigaze.llm.common import written
    from test_lines_and_benchmark import hits_by_hand, lines_by_hand
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        rows = {r.doc_id: r for r in docs.collect()}
        after = written(stage(spark, docs, folder))
        got = {r.doc_id: r for r in after.collect()}
        plain = [(i, r.text) for i, r in rows.items()]
        if name == "quality_rules":
            want = {i: rows[i].text for i, j in judged_by_hand([(i, r.text, r.lang) for i, r in rows.items()]).items() if j[6]}
        elif name == "line_dedup":
            want = {i: x[2] for i, x in lines_by_hand(plain).items()}
        elif name == "near_dedup":
            want = {i: rows[i].text for i, c in classes_by_hand(plain).items() if i == c}
        elif name == "decontamination":
            want = {i: rows[i].text for i, x in hits_by_hand(plain, bench).items() if not x[3]}
        else:
            assert set(got) == set(rows)
            continue
        assert {i: r.text for i, r in got.items()} == want and after.columns == docs.columns
        assert all(r.n_chars == len(r.text) for r in got.values()) if name == "line_dedup" else True
        docs = after


def test_run_and_odd_rows(spark, tmp_path):
    rows = [(None, "null id " * 3 + " ".join(f"k{i}" for i in range(30)), None, None, None), (1, None, "en", "s", 0), (2, "", "en", None, 0),
            *[(5, " ".join(f"w{i}" for i in range(40)), "en", "s", 1)] * 2]
    spark.createDataFrame([(*r, "extra", 1) for r in rows], DOCS + ", dropped string, kept int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "w1")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {None, 5} and sum(r.start == 0 for r in got) == 2
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_rows_of_one_id_are_decided_on_one_by_one(spark, tmp_path):
    """Null ids, an id of two texts, repeated rows: each stage keeps exactly the rows it should."""
    long = lambda x, n=60: " ".join(f"{x}{i}" for i in range(n))
    bench = long("bench", 13)
    rows = [(1, long("a"), "en"), (1, "too short", "en"), (None, long("b"), "en"), (None, "short", "en"), (None, long("b") + " end", "en"), (2, long("a") + " end", "en"),
            (3, bench + " " + long("c", 40), "en"), (3, long("d"), "en"), (4, long("e"), "en"), (4, long("e"), "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], DOCS)
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)

    def kept(name, df):
        return sorted(((r.doc_id, r.text) for r in stages[name](spark, df, str(tmp_path)).collect()), key=str)

    def want(*places):
        return sorted(((rows[p][0], rows[p][1]) for p in places), key=str)

    assert kept("quality_rules", docs) == want(0, 2, 4, 5, 6, 7, 8, 9)
    assert kept("decontamination", docs) == want(0, 1, 2, 3, 4, 5, 7, 8, 9)
    one = kept("near_dedup", docs)
    assert len(one) == 7 and (1, rows[0][1]) in one and (1, "too short") in one and (None, "short") in one and [x for x in one if x[0] == 4] == want(8)
    assert [x[0] for x in one].count(None) == 2 and (3, rows[6][1]) in one and (3, rows[7][1]) in one


def test_lines_of_rows_with_one_id_or_none(spark):
    line = "a line that stands in many documents"
    rows = [(1, f"{line}\nown one"), (1, f"own two\n{line}"), (2, f"x\ny\n{line}"), (None, f"{line}\nz"), (None, line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect()), key=str)
    assert got == sorted([(1, "own one", 2, 1), (1, "own two", 2, 1), (2, f"x\ny\n{line}", 3, 0), (None, "z", 2, 1), (None, "", 1, 1)], key=str)
    # two rows of one document and one of another are two documents
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, line), (1, line), (2, line)], "doc_id long, text string")).collect()
    assert all(r.n_dropped == 0 for r in got)


def test_replaced_lines_keep_columns(spark):
    docs = spark.createDataFrame([(i, "the same long line of text here\nown", "x", i) for i in (1, 2, 3)] + [(4, None, "y", 4)], "doc_id long, text string, dropped string, place int")
    got = {r.doc_id: tuple(r) for r in line_dedup.without_repeated_lines(docs).collect()}
    assert got == {1: (1, "own", "x", 1), 2: (2, "own", "x", 2), 3: (3, "the same long line of text here\nown", "x", 3), 4: (4, None, "y", 4)}
    assert decontamination.decontaminate(docs, docs.select(docs["doc_id"].alias("item_id"), "text")).count() == 4
