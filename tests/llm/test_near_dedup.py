"""Near-duplicate classes against all pairs; the signatures against the similarity they estimate."""

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from lexigaze.llm import components, near_dedup

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return Counter(tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))) if w else Counter()


def similarity(a, b):
    keys = list(a.keys() | b.keys())
    return near_dedup.probability_jaccard(np.array([a[k] for k in keys], float), np.array([b[k] for k in keys], float))


def classes_by_hand(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a].keys() & sets[b].keys():
            if similarity(sets[a], sets[b]) >= 0.8:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in parent}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, class_id long")


def classes(spark, rows):
    return {r.doc_id: r.class_id for r in near_dedup.near_classes(frame(spark, rows)).collect()}


def test_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert classes(spark, rows) == classes_by_hand(rows)


def test_edge(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, None), (2, ""), (3, "..."), (4, "one two"), (5, "One, TWO!"), (6, "one"), (7, long), (8, long + " end"), (9, long.replace("w100", "x")), (10, "w " * 20000)]
    assert classes(spark, rows) == classes_by_hand(rows)
    assert near_dedup.near_classes(frame(spark, [])).count() == 0
    twice = near_dedup.near_classes(frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")])).collect()
    assert sorted((r.doc_id is None, r.class_id) for r in twice) == [(False, 1), (False, 1), (True, 1)]


def test_null_and_repeated_ids(spark):
    """Rows are known by their numbers: a shared or missing id joins no classes."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, b + " end"), (None, c), (None, c + " end"), (None, None), (None, "alone here"), (7, a + " end"), (3, "")]
    got = sorted(((r.doc_id, r.class_id) for r in near_dedup.near_classes(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (None, None), (None, None), (None, None), (None, None), (7, 1), (3, 3)], key=str)
    one = near_dedup.near_classes(frame(spark, [(5, a), (5, b), (6, a), (8, b)])).collect()
    assert sorted((r.doc_id, r.class_id) for r in one) == [(5, 5), (5, 5), (6, 5), (8, 5)]
    apart = near_dedup.near_classes(frame(spark, [(1, a), (1, b), (2, c)])).collect()
    assert sorted((r.doc_id, r.class_id) for r in apart) == [(1, 1), (1, 1), (2, 2)]


def test_similar_is_the_exact_similarity():
    rng = np.random.default_rng(7)
    for _ in range(200):
        one = Counter(rng.integers(0, 30, 40).tolist()) if rng.random() < 0.5 else Counter(rng.permutation(40)[:30].tolist())
        two = one.copy()
        for k in rng.integers(0, 40, int(rng.integers(0, 6))).tolist():
            two[k] = int(rng.integers(0, 3))
        two = +two
        sides = [(np.array(sorted(c), np.uint64), None if set(c.values()) == {1} else np.array([c[k] for k in sorted(c)], np.int32)) for c in (one, two)]
        for limit in (0.7, 0.8, 0.9):
            assert near_dedup._similar(*sides, limit) == (similarity(one, two) >= limit - 1e-12)


def variants(seed, n, words, edits):
    """Texts of the same words but for ``edits`` of them, none of them the base text; ids from 1000 * seed."""
    rng = np.random.default_rng(seed)
    for i in range(1000 * seed, 1000 * seed + n):
        w = [f"b{seed}x{k}" for k in range(words)]
        for k in rng.choice(words, edits, replace=False):
            w[k] = f"e{i} {k}"
        yield i, " ".join(w)


def test_variants_around_the_limit_without_a_base(spark):
    """Most pairs look near but are not; the nearest three of each by sketch and a spanning forest would leave the family split."""
    rows = list(variants(2, 150, 330, 4))
    got, want = classes(spark, rows), classes_by_hand(rows)
    assert sum(got[i] != want[i] for i in want) == 0


def test_crowded_buckets_are_split(spark, monkeypatch):
    """A large group whose buckets are many times one part: nothing is merged that isn't linked, and links that
    go through the group's center are all found (those between two outlying texts only where they share further bands)."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        w = list(base)
        for k in rng.choice(150, int(rng.integers(1, 4)), replace=False):
            w[k] = f"e{i}_{k}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(f"u{i}_{k}" for k in range(60))) for i in range(30)]
    monkeypatch.setattr(near_dedup, "GROUP", 16)
    got, want = classes(spark, rows), classes_by_hand(rows)
    center = shingles(rows[0][1])
    assert all(got[i] == want[i] for i, t in rows if similarity(shingles(t), center) >= 0.8)
    assert all(got[i] in (i, want[i]) for i, _ in rows)
    assert np.mean([got[i] == want[i] for i, _ in rows]) >= 0.98


def test_crowded_buckets_without_a_base(spark, monkeypatch):
    """Links between texts that are neither a bucket's least nor its hub, in buckets of many parts."""
    rows = list(variants(2, 150, 330, 4)) + list(variants(3, 60, 340, 4))
    monkeypatch.setattr(near_dedup, "GROUP", 16)
    got, want = classes(spark, rows), classes_by_hand(rows)
    assert sum(got[i] != want[i] for i in want) == 0


def test_signatures_estimate_the_similarity():
    a, b = " ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in range(40, 440))
    text, grams, counts = near_dedup.weighted_shingles(pa.array([a, b]), 5)
    signs = near_dedup.prob_min_hash(text, grams, counts, 2, registers=4096)
    assert abs((signs[0] == signs[1]).mean() - similarity(shingles(a), shingles(b))) < 0.03
    text, grams, counts = near_dedup.weighted_shingles(pa.array(["x y " * 50 + a, a + " x y" * 5]), 5)
    signs = near_dedup.prob_min_hash(text, grams, counts, 2, registers=4096)
    assert abs((signs[0] == signs[1]).mean() - similarity(shingles("x y " * 50 + a), shingles(a + " x y" * 5))) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.u: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, **{i: 100 for i in range(101, 140)}, 201: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
