"""Hard negatives next to all inner products."""

import numpy as np
import pytest

from lexigaze.llm import bond

SCHEMA = "vec_id long, embedding array<float>, label int, score string, anchor int"


def brute(rows, every=100, n_positives=5, n_negatives=5, lowest=80):
    used = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64), lab) for i, v, lab in rows
            if v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v)]
    used = [(i, v, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab) for i, v, lab in used]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for at, (anchor, vector, label) in enumerate(used):
        if anchor is None or anchor % every:
            continue
        dots = [(sum(int(a) * int(b) for a, b in zip(vector, v)), i, lab == label) for k, (i, v, lab) in enumerate(used) if k != at]
        for top, positive, _ in sorted((d for d in dots if d[2]), key=order)[:n_positives]:
            fit = sorted((d for d in dots if not d[2] and lowest * top <= 100 * d[0] <= 100 * top), key=order)[:n_negatives]
            out += [(anchor, positive, rank, i, top, s) for rank, (s, i, _) in enumerate(fit, 1)]
    return out


def key(row):
    return tuple((v is None, v or 0) for v in row)


def found(spark, rows, **more):
    # float32, as the table holds them
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    df = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], SCHEMA)
    return sorted((tuple(r) for r in bond.hard_negatives(bond.relabelled(bond.usable(df)), **more).collect()), key=key), sorted(brute(rows, **{k: v for k, v in more.items() if k != "block_rows"}), key=key)


def vectors(n, dims, seed, labels=4, spread=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims))
    return [(i, (centres[i % labels] * spread + rng.normal(size=dims) * 0.5).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("n, dims, block, every", [(400, 16, 2048, 20), (600, 24, 50, 10), (300, 3, 40, 7), (120, 70, 16, 1)])
def test_equals_all_inner_products(spark, n, dims, block, every):
    got, want = found(spark, vectors(n, dims, n), block_rows=block, every=every)
    assert got == want and want


def test_ties_repeats_and_nulls(spark):
    base = [1.0, 0.5, -0.25, 0.0]
    rows = [(100, base, 1), (100, base, 1), (200, base, 2), (3, base, 1), (4, base, 1), (None, base, 1), (None, base, 2), (5, base, 2), (6, base, 2), (8, base, 3),
            (9, [1.0, None, 0.0, 0.0], 1), (10, None, 1), (11, base, None), (12, [float("nan"), 0.0, 0.0, 0.0], 1), (13, [float("inf"), 0.0, 0.0, 0.0], 2),
            (300, [1.0], 1), (400, [], 1), (15, [1.0, 0.5, -0.25, 0.0, 9.0], 2), (14, base, 1), (7, base, 0), (500, [-1.0, 0.0, 0.0, 0.0], 1), (16, [1.0, 0.4, -0.25, 0.0], 2)]
    got, want = found(spark, rows)
    assert got == want and want
    got, want = found(spark, rows, block_rows=4)
    assert got == want


def nodes(node):
    """Every node of a plan that ran, with those below its stages."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return nodes(node.executedPlan())
    below = [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
    return [(kind, node), *(x for child in below for x in nodes(child))]


def test_what_is_sent_to_all_tasks_does_not_grow_with_the_blocks(spark, monkeypatch):
    ran, write = [], bond.written
    monkeypatch.setattr(bond, "written", lambda df, **options: ran.append(df) or write(df, **options))
    rows = vectors(600, 8, 5)
    got, want = found(spark, rows, every=5, block_rows=1)  # 120 anchors beside 600 blocks
    assert got == want and want
    sent = []
    for df in ran:
        df.collect()
        sent += [node.metrics().get("dataSize").get().value() for kind, node in nodes(df._jdf.queryExecution().executedPlan()) if kind == "BroadcastExchangeExec"]
    assert sent and max(sent) <= 1 << 21  # a hash table of long keys has 1 MB, however few they are


def test_anchors_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(bond, "GROUP_ANCHORS", 8)
    rows = vectors(300, 5, 9) + [(None, [0.5] * 5, 1), (100, [0.5] * 5, 1), (100, [0.5] * 5, 1), (None, [0.5] * 5, 2), (100, [0.5] * 5, 2)]
    whole, want = found(spark, rows, every=7, block_rows=30)
    sizes, grid = [], bond._grid
    monkeypatch.setattr(bond, "ROUND_BYTES", 8 * (5 * 8 + 256) * 2)  # two groups
    monkeypatch.setattr(bond, "_grid", lambda blocks, anchors, n: sizes.append(anchors.select("group").distinct().count()) or grid(blocks, anchors, n))
    got, _ = found(spark, rows, every=7, block_rows=30)
    assert got == whole == want and len(sizes) > 2 and max(sizes) <= 2


def test_negative_scores_have_an_empty_window(spark):
    got, want = found(spark, [(100, [1.0], 1), (1, [-0.5], 1), (2, [-0.6], 2), (200, [1.0], 3), (201, [0.0], 3), (202, [0.0], 4)])
    assert got == want and all(r[4] >= 0 for r in got)


def test_wide_numbers(spark):
    got, want = found(spark, [(i * 100, [float(1 << 21) * (i % 5 + 1), float(i)], i % 2) for i in range(30)])
    assert got == want


@pytest.mark.parametrize("rows", [[], [(1, [0.5], 1)], [(100, [0.5], 1)], [(100, None, 1)]])
def test_small_tables(spark, rows):
    got, want = found(spark, rows)
    assert got == want == []


def test_scan_lets_rows_go_early():
    rng = np.random.default_rng(0)
    columns = (rng.normal(size=(64, 2048)) * 40).astype(np.int64)
    columns[:, :20] = (np.arange(64) % 5)[:, None] * 60
    block = bond._Block({"block": 0, "n": 2048, "dims": 64, "ids": np.arange(2048).tobytes(), "nulls": np.zeros(2048, bool).tobytes(),
                         "labels": np.zeros(2048, np.int64).tobytes(), "columns": columns.tobytes()})
    left = []

    def keep(low, high):
        alive = high >= bond._kth(low, 5, bond._LEAST)
        left.append(int(alive.sum()))
        return alive

    rows, scores = block.scan(columns[:, 0], np.ones(2048, bool), keep)
    exact = columns.T @ columns[:, 0]
    assert (scores == exact[rows]).all() and set(np.argsort(-exact, kind="stable")[:5]) <= set(rows)
    assert left[-2] < 1024 and len(left) == 8
