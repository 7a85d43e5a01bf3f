"""Secret scan: rules by plain expressions, the network by held-back findings."""

import re

import numpy as np

from lexigaze.llm import secrets

KEYWORD = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_key", "apikey"))
ASSIGN = re.compile(f"({KEYWORD})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ODD = [None, "", "token = abc", "TOKEN: 'aB3.aB3.aB3.x' z", "secret=secret=abcdefghijkl", "password: token: abcdefghijkl", "AKIA" + "A" * 14, "xAKIAAKIA" + "9" * 12,
       "AKIA12", "0123456789abcdef", "0123456789abcdeF0", "é 0123456789abcdef0 ü", "api_key  =  \"" + "a" * 12, "apikey=" + "b" * 11, "ſecret=abcdefghijklmn",
       "toKen=abcdefghijklmn", "f" * 50_000, "a1" * 4000, "token=" + "deadbeef" * 5 + " " + "x1" * 10]


def by_hand(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))


def check(rows, got):
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert r.base == by_hand(t)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(r.base.count(k) for k in ("assign:", "access:", "hex:"))
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
        assert len(list(filter(None, r.spans.split(",")))) == len(list(filter(None, r.base.split(",")))) + r.n_added
        starts = [int(s.split(":")[1]) for s in r.spans.split(",") if s]
        assert starts == sorted(starts) and all(int(s.split(":")[2]) <= len(t or "") for s in r.spans.split(",") if s)


def test_edge(spark):
    rows = list(enumerate(ODD))
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, spans long")
    check(rows, {r.doc_id: r for r in secrets.scan_secrets(docs).collect()})
    assert secrets.scan_secrets(docs.where("false")).count() == 0


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(rows, {r.doc_id: r for r in secrets.scan_secrets(docs).collect()})


def test_network_learns_labels(spark):
    """Labels that no rule gives: keys in brackets are secret, the same strings after 'id' are not."""
    rng = np.random.default_rng(1)
    key = lambda: "".join(rng.choice(list("abcdefghijkXYZ0123456789"), 20)) + "q7"
    texts = [(f"some words [{key()}] more", 1) if i % 2 else (f"order id {key()} sent", 0) for i in range(600)]
    found = [(t, y, secrets.candidates(t, [])) for t, y in texts]
    windows = [secrets.window(t, *c[0][:2]) for t, _, c in found]
    labels = np.array([y for _, y, _ in found])
    model = secrets.train(windows[:400], labels[:400], epochs=10)
    scores = model.scores(windows[400:])
    assert (scores[labels[400:] == 1] >= model.threshold).mean() > 0.9
    assert (scores[labels[400:] == 0] >= model.threshold).mean() < 0.05
    table = spark.createDataFrame([(bytearray(w), int(y)) for w, y in zip(windows[:400], labels[:400])], "window binary, label int")
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts[400:])], "doc_id long, text string")
    added = {r.doc_id: r.n_added for r in secrets.scan_secrets(docs, table).collect()}
    assert np.mean([added[i] == y for i, (_, y) in enumerate(texts[400:])]) > 0.9
