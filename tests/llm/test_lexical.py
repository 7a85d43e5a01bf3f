"""Ranked search next to a plain loop over all documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from lexigaze.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """(item_id, rank, doc_id, score), a list per item."""
    counts = [(doc_id, Counter(words(text))) for doc_id, text in docs]
    held = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c, n in held:
            m = 50 + 50 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(words(text)) if c[t])
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scores)[:k], 1)]
    return out


def key(row):
    return tuple((v is None, v or 0) for v in row)


def found(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x", 3) for i, t in docs], "doc_id long, text string, terms string, row int")
    b = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double")
    return sorted((tuple(r) for r in lexical.rank_documents(d, b, **more).collect()), key=key)


def corpus(n, seed, vocabulary=120):
    rng = np.random.default_rng(seed)
    topics = [rng.permutation(vocabulary)[:30] for _ in range(5)]
    texts = []
    for i in range(n):
        mine = topics[i % 5]
        texts.append(" ".join(f"w{mine[min(29, int(rng.exponential(6)))]}" for _ in range(int(rng.integers(1, 60)))))
    return list(enumerate(texts)), [(i, " ".join(f"W{rng.integers(vocabulary)}" for _ in range(12))) for i in range(9)]


@pytest.mark.parametrize("k, segment, block", [(5, 64, 8), (50, 1024, 128), (3, 1000, 16)])
def test_equals_a_loop_over_all_documents(spark, k, segment, block):
    docs, items = corpus(400, k)
    assert found(spark, docs, items, k=k, segment_docs=segment, block_docs=block) == sorted(brute(docs, items, k), key=key)


def test_edges(spark):
    docs = [(7, None), (6, ""), (5, "alpha beta"), (5, "alpha beta"), (4, "ALPHA, beta!"), (None, "alpha"), (None, None), (3, "ärger Ärger 中文"),
            (2, "gamma " * 30000), (1, "... --- ..."), (9, "alpha beta")]
    items = [(1, "Alpha beta"), (1, "gamma"), (2, None), (3, ""), (None, "beta"), (4, "nowhere"), (5, "ärger 中文"), (6, "alpha alpha alpha")]
    for k in (2, 50):
        assert found(spark, docs, items, k=k) == sorted(brute(docs, items, k), key=key)


@pytest.mark.parametrize("docs, items", [([], []), ([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")])])
def test_empty_tables(spark, docs, items):
    assert found(spark, docs, items) == []


def _segment(docs, block):
    rows = [Counter(words(t)) for _, t in docs]
    names = {t: i * 7919 + 11 for i, t in enumerate(sorted(set().union(*rows)))}
    n = np.array([sum(c.values()) for c in rows])
    lengths = np.array([len(c) for c in rows])
    terms = np.array([names[t] for c in rows for t in sorted(c)], np.uint64)
    counts = np.array([c[t] for c in rows for t in sorted(c)], np.int64)
    impacts = lexical.impacts_of(counts, np.repeat(n, lengths), len(rows), int(n.sum()))
    arrays = lexical.build_segment(np.arange(len(rows)), np.zeros(len(rows), bool), lengths, terms, impacts.astype(np.int32), block)
    return lexical.Segment({name: a.tobytes() for name, a in arrays.items()}), names


def test_blocks_hold_each_list_once_and_bound_their_documents():
    docs, _ = corpus(500, 3)
    s, _ = _segment(docs, 16)
    assert len(s.block_term) > len(s.terms) and len(s.sum_most)
    for t in range(len(s.terms)):
        listed = s.block_docs[s.block_starts[s.first_block[t]]:s.block_starts[s.first_block[t + 1]]]
        assert sorted(listed) == sorted(np.repeat(np.arange(500), s.lengths)[s.at == t])
    most = {}
    for t in range(len(s.terms)):
        for p in range(s.sum_starts[t], s.sum_starts[t + 1]):
            most[s.sum_block[p], t] = s.sum_most[p]
    for b in {b for b, _ in most}:
        want = {}
        for d in s.block_docs[s.block_starts[b]:s.block_starts[b + 1]]:
            for p in range(s.starts[d], s.starts[d + 1]):
                want[s.at[p]] = max(want.get(s.at[p], 0), s.impacts[p])
        assert want == {t: m for (own, t), m in most.items() if own == b}


def test_blocks_are_passed_over_without_losing_a_document():
    docs, items = corpus(2000, 4)
    s, names = _segment(docs, 16)
    rng = np.random.default_rng(1)
    for _, text in items:
        terms = np.array(sorted({names[t] for t in words(text) if t in names}), np.uint64)
        weights = rng.integers(1, 3000, len(terms))
        scores, ids, _ = s.search(terms, weights, lexical._nothing(), 4)
        every = np.zeros(len(docs), np.int64)
        for t, w in zip(terms, weights):
            at = np.searchsorted(s.terms, t)
            here = s.at == at
            every[np.repeat(np.arange(len(docs)), s.lengths)[here]] += w * s.impacts[here]
        order = np.lexsort((np.arange(len(docs)), -every))[:4]
        assert ids.tolist() == order.tolist() and scores.tolist() == every[order].tolist()
    assert s.skipped > 0 and s.scored < len(items) * len(docs)
