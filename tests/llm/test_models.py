"""Learned operators: counts against plain Python, held-out accuracy, edge rows."""

import math
import os
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from lexigaze.llm import common, conv, language_id, pitman_yor, quality_model
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \n", "A b A", "É é", "word " * 9000, "12 34", "\x0b"]


def table(spark, name, sf="0.01"):
    return spark.read.parquet(f"/root/testdata/sf{sf}/{name}.parquet")


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def scored(spark, rows):
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, score long")
    return pitman_yor.score_held_out(docs).collect()


def base_by_hand(rows):
    toks = [WORD.findall((t or "").translate(LOWER)) + [None] for _, t in rows]
    c = Counter()
    for (i, _), t in zip(rows, toks):
        if fold(i, 10):
            c.update(t)
    n, v = sum(c.values()), len(c)
    return sorted((i, fold(i, 10) == 0, len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), 4))
                  for (i, _), t in zip(rows, toks))


@pytest.mark.parametrize("which", ["odd", "table"])
def test_pitman_yor(spark, which):
    rows = list(enumerate(ODD)) + [(3, "A b A")] if which == "odd" else [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    got = scored(spark, rows)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == base_by_hand(rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    if which == "table":
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_pitman_yor_without_rows(spark):
    assert scored(spark, []) == []
    assert [r.n_known for r in scored(spark, [(i, "a b") for i in range(200) if fold(i, 10) == 0][:2])] == [0, 0]


def test_predictions_sum_to_one(spark):
    """Over all known words and the unknown one, after a frequent word and after a rare one."""
    docs = table(spark, "documents", "0.001").limit(40)
    model = pitman_yor.fit(docs)
    rows = model.seats.collect()
    for u in (0, len(model.contexts) // 2, -1):
        total = sum(model.back_offs[s][u] * model.unknown[s] for s in range(model.samples)) / model.samples
        for r in rows:
            if u >= 0 and u in r.contexts:
                total += r.sums[r.contexts.index(u)] / model.samples
            else:
                total += sum(model.back_offs[s][u] * r.parents[s] for s in range(model.samples)) / model.samples
        assert total == pytest.approx(1.0, abs=1e-6)


def test_seats_of_one_dish():
    n = np.array([1.0, 2.0, 50.0, 5000.0, 1e6])
    t = pitman_yor.seat(n, np.full(5, 1.0), 0.8, np.full(5, 0.5), np.arange(5, dtype=np.uint64), 1)
    assert (t >= 1).all() and (t <= n).all() and t[4] > t[3] > t[2]
    runs = [pitman_yor.seat(np.full(2000, 40.0), np.full(2000, 2.0), 0.0, np.ones(2000), np.arange(2000, dtype=np.uint64), k).mean() for k in range(3)]
    want = 1 + sum(2.0 / (2.0 + k) for k in range(1, 40))
    assert np.mean(runs) == pytest.approx(want, rel=0.03)


def test_language(spark):
    docs = table(spark, "documents")
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    rows = [(r.doc_id, r.lang) for r in docs.collect() if fold(r.doc_id, 5) == 0 and r.lang]
    assert all(got[i].held_out for i, _ in rows) and len(got) == docs.count()
    assert np.mean([got[i].lang_pred == lang for i, lang in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edge(spark):
    rows = [(i, t, "xx" if i % 2 else None) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs).collect()}
    assert all(got[i] == (("xx", 1.0) if any(c.isalpha() for c in t or "") else ("und", 0.0)) for i, t, _ in rows)
    odd = spark.createDataFrame([(None, "word", "xx"), (None, "\u00bd \u00b2 \u2167 7 _", None), (1, "\u4e2d", "xx")], "doc_id long, text string, lang string")
    assert sorted((str(r.doc_id), r.held_out, r.lang_pred) for r in language_id.identify(odd).collect()) == [("1", False, "xx"), ("None", False, "und"), ("None", False, "xx")]
    assert language_id.identify(docs.where("false")).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def grams_by_hand(text):
    """How often each n-gram of one to three characters stands in the text, by its place in the table."""
    out, chars = Counter(), [ord(c) for c in text.lower()]
    for n in (1, 2, 3):
        for at in range(len(chars) - n + 1):
            code = 0
            for order in range(1, n + 1):
                code = (code * 0x100000001B3 + chars[at + order - 1] + order) % 2 ** 64
            out[code * 0x9E3779B97F4A7C15 % 2 ** 64 >> 64 - language_id.BITS] += 1
    return out


def test_language_by_plain_steps():
    """Training and prediction next to loops over single numbers."""
    rows = [(t, lang) for lang, words in (("aa", ["alpha beta", "alpha gamma", "beta beta"]), ("bb", ["omega psi", "psi chi", "omega omega"]), ("cc", ["123 xyz", "zyx", "xyzzy"]))
            for t in words for _ in range(2)]
    df = np.zeros(language_id.SIZE)
    for t, _ in rows:
        df[list(grams_by_hand(t))] += 1
    model = language_id.train(rows, df, len(rows), epochs=2)

    def vector(t):
        v = {g: math.log(1 + c) * (math.log((1 + len(rows)) / (1 + df[g])) + 1) for g, c in grams_by_hand(t).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / norm for g, x in v.items()}

    def soft(z):
        e = [math.exp(x - max(z)) for x in z]
        return [x / sum(e) for x in e]

    z, squares = Counter(), Counter()

    def weight(g, k):
        if abs(z[g, k]) <= 0.05:
            return 0.0
        return -(z[g, k] - math.copysign(0.05, z[g, k])) / (1.0 + math.sqrt(squares[g, k]) + 0.01)

    rng = np.random.default_rng(5)
    order = rng.permutation(len(rows))
    used, names = np.delete(order, np.s_[::5]), ["aa", "bb", "cc"]
    for _ in range(2):
        for i in rng.permutation(used).tolist():
            v = vector(rows[i][0]) | {"bias": 1.0}
            w = {(g, k): weight(g, k) for g in v for k in range(3)}
            p = soft([sum(x * w[g, k] for g, x in v.items()) for k in range(3)])
            for g, x in v.items():
                for k in range(3):
                    d = x * (p[k] - (names[k] == rows[i][1]))
                    z[g, k] += d - (math.sqrt(squares[g, k] + d * d) - math.sqrt(squares[g, k])) * w[g, k]
                    squares[g, k] += d * d
    for t in ("alpha", "omega chi", "xyz", "beta psi 1"):
        logits = [sum(x * weight(g, k) for g, x in vector(t).items()) + weight("bias", k) for k in range(3)]
        assert model.logits(t) == pytest.approx(logits, abs=1e-9)
        p = soft([x / model.temperature for x in logits])
        assert model.predict(t) == (names[p.index(max(p))], pytest.approx(max(p), abs=1e-9))


def test_ftrl_is_sparse():
    rng = np.random.default_rng(0)
    learner = language_id.Ftrl(50, 2, l1=0.5)
    for _ in range(400):
        y = int(rng.integers(2))
        learner.update(np.arange(50), np.where(np.arange(50) == y, 1.0, rng.normal(0, 0.05, 50)), y)
    w = learner.weights(slice(None))
    assert w[0, 0] > 0 > w[0, 1] and (w[2:] == 0).mean() > 0.5


def test_quality(spark):
    docs, labels = table(spark, "documents", "0.1").where("doc_id % 4 > 0 OR doc_id < 4000"), table(spark, "labels", "0.1")
    got = quality_model.classify(docs, labels, rows=300).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.93


def test_quality_edge(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(0, None, 1), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_model.classify(docs, labels).collect()
    assert len(got) == len(ODD) and all(r.score in (0.5, 1.0) for r in got)
    assert quality_model.classify(docs.where("false"), labels).count() == 0


def test_quality_by_plain_steps():
    """A trained network's score next to loops over chunks, places and filters."""
    rng = np.random.default_rng(4)
    data = [bytes(rng.choice(list(b"abc de\n" if i % 2 else b"#$%12 *"), int(rng.integers(0, 900))).tolist()) for i in range(40)]
    labels = np.array([i % 2 for i in range(40)])
    net = quality_model.train(data, labels, np.arange(40) % 5, 0.5, epochs=2)
    width = net.width * conv.BYTES.shape[1]
    for raw in (b"", b"ab", data[0], data[1] * 3):
        chunks = [raw[a:a + quality_model.CHUNK] for a in range(0, max(1, len(raw) - quality_model.OVERLAP), quality_model.CHUNK - quality_model.OVERLAP)]
        tops = []
        for chunk in chunks:
            x = conv.BYTES[list(chunk.ljust(quality_model.CHUNK, b"\0"))].astype(float)
            best = [0.0] * quality_model.FILTERS
            for at in range(0, quality_model.CHUNK - net.width + 1, net.stride):
                window = x[at:at + net.width].reshape(width)
                for f in range(quality_model.FILTERS):
                    best[f] = max(best[f], float(window @ net.filters[:, f].astype(float)) + float(net.bias[f]))
            tops.append(best)
        features = [max(t[f] for t in tops) for f in range(quality_model.FILTERS)] + [sum(t[f] for t in tops) / len(tops) for f in range(quality_model.FILTERS)]
        logit = sum(a * float(b) for a, b in zip(features, net.out)) + float(net.shift[0])
        want = 1 / (1 + math.exp(-(net.scale * logit + net.offset)))
        column = np.frombuffer(raw, np.uint8)
        assert quality_model.scores(net, column, np.array([0, len(raw)]))[0] == pytest.approx(want, abs=1e-4)


def test_chunks_cover_everything():
    for n in (0, 1, 511, 512, 513, 992, 993, 5000):
        data = np.arange(n) % 250 + 1
        rows = conv.overlapping(data.astype(np.uint8), 512, 32)
        back = np.concatenate([rows[0], *[r[32:] for r in rows[1:]]])
        assert (back[:n] == data).all() and not back[n:].any() and len(rows) == max(1, math.ceil((n - 32) / 480))


def test_gradients():
    rng = np.random.default_rng(2)
    net = conv.ConvNet(4, 2, 3, regions=2)
    segments = rng.integers(1, 255, (5, 24)).astype(np.uint8)
    first, counts, y, w = np.array([0, 2]), np.array([2, 3]), np.array([1.0, 0.0]), np.ones(2)

    def loss():
        z = net.logits(segments, first).astype(float)
        return (np.log1p(np.exp(-np.where(y == 1, z, -z))) * w).sum() / w.sum()

    grads = net._gradients(segments, first, counts, y, w)
    for p, g in zip((net.filters, net.bias, net.out), grads):
        flat, i = p.reshape(-1), int(np.abs(g).argmax())
        old = flat[i]
        flat[i] = old + 1e-2
        up = loss()
        flat[i] = old - 1e-2
        down = loss()
        flat[i] = old
        assert g.reshape(-1)[i] == pytest.approx((up - down) / 2e-2, rel=0.15, abs=1e-3)


def test_every_word_is_a_context(spark):
    """Predictions after words that are rare, all known words and the unknown one, sum to one; a seen follower gains."""
    docs = table(spark, "documents", "0.001").limit(40)
    model = pitman_yor.fit(docs, context_share=0.05)
    parents = {r.word: r.parents for r in model.seats.collect()}
    after = {}
    for r in model.pairs.collect():
        after.setdefault(r.before, {})[r.word] = r.p
    places = {r.before: r.backs for r in model.places.collect()}
    assert set(after) == set(places) and len(model.contexts) + len(places) == len(parents)
    for u in sorted(after)[::max(len(after) // 20, 1)]:
        mean = lambda x: sum(b * v for b, v in zip(places[u], x)) / model.samples
        assert mean(model.unknown) + sum(after[u].get(w, mean(x)) for w, x in parents.items()) == pytest.approx(1.0, abs=1e-6)
        assert all(p > mean(parents[w]) for w, p in after[u].items())


def test_how_pairs_lie_changes_no_score(spark, monkeypatch):
    """All contexts sent to the tasks, or none but those of a share, in few parts or many and small chunks: the same model and scores."""
    docs = table(spark, "documents", "0.001").select("doc_id", "text").limit(60)
    learned = docs.where("doc_id % 3 <> 0")
    want, contexts = None, []
    for most, parts, chunk in ((1 << 19, 24, 700_000), (0, 24, 700_000), (50, 3, 500)):
        monkeypatch.setattr(pitman_yor, "PARTS", parts)
        monkeypatch.setattr(pitman_yor, "CHUNK", chunk)
        model = pitman_yor.fit(learned, most_contexts=most)
        got = sorted((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in pitman_yor.score(docs, model).collect())
        contexts.append(len(model.contexts))
        want = want or got
        assert len(got) == len(want) and all(a == pytest.approx(b, rel=1e-9) for a, b in zip(got, want))
    assert contexts[1] < 50 <= contexts[2] < contexts[0]


def test_pitman_yor_writes_little(spark, monkeypatch):
    """All tables of a run together take less than ten times the bytes of the texts, stored the same way (they are short, with many copies)."""
    tables = []
    monkeypatch.setattr(pitman_yor, "written", lambda df, **options: tables.append(size(out := common.written(df, **options))) or out)

    def size(df):
        return sum(os.path.getsize(f.removeprefix("file:").replace("///", "/")) for f in df.inputFiles())

    docs = table(spark, "documents").select("doc_id", "text")
    assert pitman_yor.score_held_out(docs).count() == docs.count()
    assert sum(tables) < 10 * size(common.written(docs))


def test_pairs_of_a_part_are_joined_as_they_come(spark, monkeypatch):
    """Whatever the number of chunks, a task holds little more than the pairs that stay."""
    class Taken:
        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    for name, value in (("_dealt", None), ("_by_part", Taken()), ("written", None), ("_written", None)):
        monkeypatch.setattr(pitman_yor, name, lambda x, *_, value=value: value or x, raising=False)
    monkeypatch.setattr(pitman_yor, "JOINED", 100_000, raising=False)
    monkeypatch.setattr(pitman_yor, "RANGE", 10_000, raising=False)
    contexts = SimpleNamespace(value=np.arange(500, dtype=np.uint64))
    random = np.random.default_rng(1)
    names = np.sort(pitman_yor.mix(np.arange(1, 201, dtype=np.uint64)))
    frequent, rare = Counter(), Counter()

    def chunks():
        for _ in range(60):
            words = np.sort(random.choice(names, 150, replace=False))
            ahead = [np.sort(random.choice(500, k, replace=False)) for k in random.integers(0, 300, 150)]
            ahead_2 = [np.sort(random.choice(900, k, replace=False)).astype(np.uint64) + np.uint64(1000) for k in random.integers(0, 30, 150)]
            sizes, sizes_2 = (np.array([len(x) for x in a]) for a in (ahead, ahead_2))
            n, n_2 = random.integers(1, 9, sizes.sum()), random.integers(1, 9, sizes_2.sum())
            for c, a, times in ((frequent, ahead, n), (rare, ahead_2, n_2)):
                for (w, x), t in zip(((w, x) for w, xs in zip(words.tolist(), a) for x in xs.tolist()), times.tolist()):
                    c[w, x] += t
            small = pitman_yor._small
            yield pitman_yor._rows([(0, pitman_yor._TOKENS, 0, (words, small(sizes), pitman_yor._steps(np.concatenate(ahead), sizes), small(n), small(sizes_2), np.concatenate(ahead_2), small(n_2)))])

    held = list(chunks())
    tracemalloc.start()
    rows = list(pitman_yor._read(pitman_yor.pair_counts(None, contexts, 1)(iter(held))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    words, count, sizes, steps, n, sizes_2, before, n_2 = next(a for _, kind, _, a in rows if kind == pitman_yor._PAIRS)
    w, w_2 = np.repeat(words, sizes).tolist(), np.repeat(words, sizes_2).tolist()
    assert dict(zip(zip(w, pitman_yor._walked(steps, sizes).tolist()), n.tolist())) == frequent and len(w) == len(frequent)
    assert dict(zip(zip(w_2, before.tolist()), n_2.tolist())) == rare and len(w_2) == len(rare)
    assert count.sum() == frequent.total() + rare.total()
    assert peak < 30e6, peak
