"""Repeated substrings against all substrings."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from lexigaze.llm import repeats


def frame(spark, rows):
    return spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, start long")


def by_hand(rows, length):
    raw = {n: (t or "").encode() for n, (_, t) in enumerate(rows)}
    seen = Counter(b[s:s + length] for b in raw.values() for s in range(len(b) - length + 1))
    out = []
    for n, b in raw.items():
        covered = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] > 1:
                covered[s:s + length] = True
        runs = int(np.diff(np.concatenate(([0], covered.view(np.int8)))).clip(0).sum())
        out.append((rows[n][0], len(b), int(covered.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~covered])))
    return sorted(out, key=order)


def order(row):
    return row[0] is None, row[0] or 0, *row[1:]


def got(spark, rows, **kw):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(frame(spark, rows), **kw).collect()), key=order)


def edge():
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abc dé"), n))
    shared, other = word(90), word(41)
    rows = [None, "", "x", "a" * 300, shared, shared, "p" + shared[:60] + "q" + shared[20:], word(50) + other + word(30) + other, other + "!", shared[5:70] + other,
            "ab" * 100, word(3000), "é" * 30, "b" + "é" * 30]
    rows += [word(30) + shared[10:75] + word(int(rng.integers(5, 60))) for _ in range(12)]
    return list(enumerate(rows))


@pytest.mark.parametrize("group", [4096, 3])
def test_edge(spark, group):
    rows = edge()
    assert got(spark, rows, length=40, anchor=8, group=group) == by_hand(rows, 40)


def test_empty_and_repeated_rows(spark):
    assert got(spark, [], length=40, anchor=8) == []
    rows = [(1, "unique text " + "z" * 60), (1, "unique text " + "z" * 60), (2, None)]
    assert [r[2] for r in got(spark, rows, length=40, anchor=8)] == [72, 72, 0]


@pytest.mark.parametrize("group", [4096, 1])
def test_null_and_repeated_ids(spark, group):
    rng = np.random.default_rng(9)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage, other = word(70), word(50)
    rows = [(1, passage + word(20)), (None, passage), (2, word(10) + passage), (1, word(90)), (3, other), (3, other + "!"), (None, other + word(33)), (None, word(60)), (None, None)]
    assert got(spark, rows, length=40, anchor=8, group=group) == by_hand(rows, 40)
    same = [(None, passage), (None, passage), (4, word(80)), (4, passage)]
    assert got(spark, same, length=40, anchor=8, group=group) == by_hand(same, 40)


def test_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = by_hand(rows, 400)
    assert got(spark, rows) == want and got(spark, rows, group=1) == want


def test_groups_hold_all_occurrences(spark):
    """Every group is one string, found at all its places and in at least two."""
    rows = [(i, t) for i, t in edge() if t]
    raw = {i: t.encode() for i, t in rows}
    groups = defaultdict(set)
    for r in repeats.repeat_groups(frame(spark, rows), length=40, anchor=8).collect():
        groups[r.repeat, r.length].add((r.doc_id, r.start))
    assert groups
    for (_, length), places in groups.items():
        strings = {raw[d][s:s + length] for d, s in places}
        assert len(strings) == 1 and len(places) > 1


def test_maximal_groups():
    contexts = [b"xabcdey", b"xabcdez", b"wabcdey"]
    found = {(b, a, tuple(sorted(m))) for b, a, m in repeats.maximal_groups(contexts, [3, 3, 3], 3)}
    assert found == {(3, 3, (0, 1)), (2, 4, (0, 2)), (2, 3, (0, 1, 2))}
