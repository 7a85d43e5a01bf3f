"""Line dedup and decontamination against plain Python."""

import hashlib
import re
from collections import defaultdict

import pytest

from lexigaze.llm import decontamination, line_dedup

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

EDGE = [(1, None), (2, ""), (3, "\n"), (4, "  Same line of more than twenty chars \nb"), (5, "same line of more than twenty chars"),
        (6, "SAME line of more than twenty chars\nSAME line of more than twenty chars"), (7, "é" * 19 + "\nx"), (8, "é" * 20), (9, "É" * 20),
        (10, "é" * 20), (11, " " + "é" * 20 + "\x0b"), (12, "a\r\nb"), (13, "word " * 3000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "src", i) for i, t in rows], "doc_id long, text string, lang string, source string, keeper long")


def lines_by_hand(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def table(spark, name):
    return spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")


def test_lines_edge(spark):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(frame(spark, EDGE)).collect()}
    assert got == lines_by_hand(EDGE)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_lines_table(spark):
    docs = table(spark, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == lines_by_hand(rows)
    assert sum(x[1] for x in got.values()) > 0


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def hits_by_hand(rows, items, window=13):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - window + 1, 1) if w else 0):
            windows[tuple(w[k:k + window])].add(str(i))
    sizes = {len(k) for k in windows}
    out = {}
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                which = windows.get(tuple(w[k:k + n]))
                if which:
                    hit.update(range(k, k + n))
                    found |= which
        out[i] = (len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block_bytes", [4 << 20, 40])
def test_benchmark_edge(spark, block_bytes):
    items = [(1, "a b c d e f g h i j k l m n o"), (2, "C D E F G H I J K L M N O P"), (3, "short one"), (4, None), (5, "..."), (6, "one"),
             (7, "short one"), (8, "a b a b a b a b a b a b a b a b")]
    rows = [(1, None), (2, ""), (3, "x, a b c d e f g h i j k l m! n"), (4, "c d e f g h i j k l m n o p q"), (5, "one"), (6, "a short, ONE."),
            (7, "a b c d e f g h i j k l"), (8, "a b a b a b a b a b a b a b a b a b a"), (9, "b a b a b a b a b a b a b a"), (10, "short"),
            (11, "z " * 5000 + "short one"), (12, "one\none")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    hits = decontamination.find_hits(frame(spark, rows), bench, block_bytes=block_bytes)
    from pyspark.sql import functions as F
    got = {r.doc_id: (r.n_words, r.n, sorted(set(r.items))) for r in hits.withColumn("n", decontamination.covered(F.col("spans"))).collect()}
    assert got == {k: v[:3] for k, v in hits_by_hand(rows, items).items()}
    assert decontamination.decontaminate(frame(spark, []), bench).count() == 0
    assert {r.n_hit for r in decontamination.decontaminate(frame(spark, rows), bench.where("item_id = 4")).collect()} == {0}


@pytest.mark.parametrize("block_bytes", [4 << 20, 10])
def test_benchmark_rows_of_one_id_or_none(spark, block_bytes):
    """One result per row, however many blocks the items make."""
    items = [(1, "red green blue"), (2, "one two"), (3, "far away")]
    rows = [(None, "red green blue x"), (None, "one two three"), (7, "nothing here"), (7, "so far away it is"), (8, "one two"), (8, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hits = decontamination.find_hits(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).collect()
    got = sorted(((r.doc_id, r.n_words, sorted(set(r["items"]))) for r in hits), key=str)
    assert got == sorted([(None, 4, ["1"]), (None, 3, ["2"]), (7, 2, []), (7, 5, ["3"]), (8, 2, ["2"]), (8, 2, ["2"])], key=str)


def test_benchmark_table(spark):
    docs, bench = table(spark, "documents"), table(spark, "benchmark")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontamination.decontaminate(docs, bench).collect()}
    want = hits_by_hand([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert got == want
    assert any(x[3] for x in got.values())
