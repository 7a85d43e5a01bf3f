"""Mixing next to a plain calculation of targets, rates and totals."""

import math
from collections import defaultdict

import numpy as np
import pytest

from lexigaze.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, target string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows], SCHEMA)


def corpus(seed, n, sources):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(["w"] * int(rng.exponential(40))), sources[int(rng.integers(len(sources)))]) for i in range(n)]


def targets(size, weights=(5, 2, 1), share=1.5, most=2):
    """Weights go round the sources; what lies above a limit is shared among those below, again and again."""
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, free = share * sum(size.values()), {}, list(names)
    while free:
        left = total - sum(target.values())
        level = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if level[s] >= most * size[s]]
        if not over:
            target |= level
            break
        target |= {s: most * size[s] for s in over}
        free = [s for s in free if s not in over]
    return target


@pytest.mark.parametrize("seed, n, sources", [(1, 300, ["a"]), (2, 500, ["b", "a", None, "é", "z", "zz"]), (3, 200, [f"s{i}" for i in range(12)])])
def test_targets_are_met(spark, seed, n, sources):
    rows = corpus(seed, n, sources)
    got = mixing.mix(table(spark, rows)).collect()
    size, taken = defaultdict(int), defaultdict(int)
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = targets(size)
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in size) and len(got) == n
    # whole copies but for one document a source
    assert all(sum(bool(r.size) and r.taken % r.size > 0 for r in got if r.source == s) <= 1 for s in size)


def test_rates_are_tilted_exponentials(spark):
    rows = corpus(5, 400, ["a", "b", "c"])
    got = mixing.mix(table(spark, rows)).collect()
    for s in "abc":
        mine = [r for r in got if r.source == s and r.size]
        tilt = [math.log(r.rate) / r.size for r in mine if 1e-3 < r.rate < 2 and r.size > 5]
        assert max(tilt) - min(tilt) < 1e-4 if tilt else all(r.rate == 2 for r in mine)
        exact = sum(min(2.0, math.exp(np.median(tilt) * r.size)) * r.size for r in mine) if tilt else 0
        assert not tilt or math.isclose(exact, mine[0].target, rel_tol=1e-2)


def test_runs_agree(spark):
    rows = corpus(6, 300, ["a", "b", None])
    first, second = (sorted((r.doc_id, r.taken) for r in mixing.mix(table(spark, x).repartition(k)).collect()) for x, k in ((rows, 3), (rows[::-1], 7)))
    assert first == second


def test_edges(spark):
    rows = [(1, None, "a"), (1, None, "a"), (None, "one two", None), (None, "one two", None), (2, "", "b"), (3, " \t\n", "b"), (4, "x " * 50000, "c"), (5, "x y z", "a"), (5, "x y z", "a")]
    got = mixing.mix(table(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r.size for r in got) == 50010
    assert all(r.taken == 0 and r.target == 0 for r in got if r.source == "b") and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix(table(spark, [])).collect() == []
    assert [r.taken for r in mixing.mix(table(spark, [(1, None, None), (2, "", "a")])).collect()] == [0, 0]


def test_alike_rows_share_what_is_missing(spark):
    rows = [(1, "a b c d", "only")] * 7
    got = mixing.mix(table(spark, rows)).collect()
    assert sum(r.taken for r in got) == 42 and all(r.taken in (4, 6, 8) for r in got)
