"""Secret scan: rules for well-known forms, and a character convolutional network over every candidate.

Candidates are the rules' findings and all long tokens that mix letters and digits. The network
reads each candidate with its surrounding characters, is trained on findings labelled by the rules
(or on labels given), calibrated on held-back findings, and adds the candidates above the highest
threshold that keeps the wanted recall there. Findings of the rules always stay. Cases: a null or
empty text has none; equal spans are listed once per kind; repeated rows are scanned each; without
findings of both labels nothing is added; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexigaze.llm.common import pieces, texts, written
from lexigaze.llm.conv import ConvNet

# The forms of the rules and the least lengths.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex")

TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
LETTER, DIGIT = re.compile(r"[A-Za-z]"), re.compile(r"[0-9]")
AROUND, INSIDE = 32, 64
SEGMENT = AROUND + INSIDE + AROUND
FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base array<string>, starts array<bigint>, ends array<bigint>, windows array<binary>, ruled array<boolean>"


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end), sorted; code points."""
    low = text.lower()
    spans = []
    if "token" in low or "secret" in low or "passw" in low or "key" in low:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def candidates(text: str, ruled: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, found by a rule) of the rules' findings and of further tokens of letters and digits."""
    out = [(s, e, True) for s, _, e in ruled]
    ahead, reached = 0, 0  # findings that start before a token ends, and how far they reach
    for m in TOKEN.finditer(text):
        while ahead < len(ruled) and ruled[ahead][0] < m.end():
            reached = max(reached, ruled[ahead][2])
            ahead += 1
        if reached <= m.start() and DIGIT.search(m[0]) and LETTER.search(m[0]):
            out.append((m.start(), m.end(), False))
    return out


def window(text: str, start: int, end: int) -> bytes:
    """What the network reads: characters before, the candidate's first ones (all of them decide its span), characters after."""
    def fit(s: str, n: int, right: bool) -> bytes:
        raw = s.encode("latin-1", "replace").replace(b"\0", b" ")
        raw = raw[-n:] if right else raw[:n]
        return raw.rjust(n, b"\0") if right else raw.ljust(n, b"\0")

    middle = text[start:end]
    if len(middle) > INSIDE:  # both ends of a long candidate
        middle = middle[:INSIDE // 2] + middle[-INSIDE // 2:]
    return fit(text[max(0, start - AROUND):start], AROUND, True) + fit(middle, INSIDE, False) + fit(text[end:end + AROUND], AROUND, False)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        columns: list[list] = [[] for _ in range(9)]
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ruled = rule_spans(text)
            found = candidates(text, ruled)
            counts = [sum(k == kind for _, k, _ in ruled) for kind in range(3)]
            row = (doc_id, *counts, [f"{KINDS[k]}:{s}:{e}" for s, k, e in ruled], [s for s, _, _ in found], [e for _, e, _ in found],
                   [window(text, s, e) for s, e, _ in found], [r for _, _, r in found])
            for column, value in zip(columns, row):
                column.append(value)
        types = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.bool_())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                         ["doc_id", "n_assign", "n_access", "n_hex", "base", "starts", "ends", "windows", "ruled"])


@dataclass
class Model:
    net: ConvNet
    threshold: float

    def scores(self, windows: list[bytes]) -> np.ndarray:
        if not windows:
            return np.zeros(0)
        segments = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, SEGMENT)
        parts = [segments[i:i + 2048] for i in range(0, len(segments), 2048)]
        return np.concatenate([self.net.probability(self.net.logits(p, np.arange(len(p)))) for p in parts])


def train(windows: list[bytes], labels: np.ndarray, recall: float = 0.99, least: float = 0.9, epochs: int = 6, seed: int = 3) -> Model | None:
    """A calibrated network; its threshold is the highest one with the wanted recall on every fourth, held-back finding.

    Never below ``least``, so that a model that can't tell the classes apart adds nothing.
    """
    if len(set(labels.tolist())) < 2:
        return None
    segments = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, SEGMENT)
    order = np.random.default_rng(seed).permutation(len(labels))
    held, used = order[::4], np.delete(order, np.s_[::4])
    if len(set(labels[held].tolist())) < 2 or len(set(labels[used].tolist())) < 2:
        return None
    weights = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
    net = ConvNet(width=5, stride=1, filters=24, regions=3, seed=seed)
    net.train([segments[i:i + 1] for i in used], labels[used].astype(np.float32), weights[used].astype(np.float32), epochs)
    logits = net.logits(segments[held], np.arange(len(held)))
    net.calibrate(logits, labels[held], np.ones(len(held)))
    hits = np.sort(net.probability(logits)[labels[held] == 1])
    return Model(net, max(float(hits[int(np.floor((1 - recall) * len(hits)))]), least))


def findings(found: DataFrame) -> DataFrame:
    """The labelled findings that the rules give: doc_id, window, label."""
    return found.select("doc_id", F.explode(F.arrays_zip("windows", "ruled")).alias("f")).select(
        "doc_id", F.col("f.windows").alias("window"), F.col("f.ruled").cast("int").alias("label"))


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, sample: int = 3000, recall: float = 0.99) -> DataFrame:
    """doc_id, counts and spans of the rules (``base``), all spans in order (``spans``).

    The network is trained on at most ``sample`` findings of each label, taken in the order of a
    hash, from ``labelled`` (window, label) or the rules' own findings. The texts are read once:
    what was found in them is written, sampled and then scored.
    """
    found = written(texts(docs).mapInArrow(_scan, FOUND))
    labelled = findings(found) if labelled is None else labelled
    rows = []
    for label in (0, 1):
        rows += labelled.where(F.col("label") == label).select("window", "label").distinct().orderBy(
            F.xxhash64("window"), "window").limit(sample).collect()
    model = train([bytes(r.window) for r in rows], np.array([r.label for r in rows])) if rows else None
    return found.mapInArrow(_judge(model), "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string, n_added long")


def _judge(model: Model | None):
    rank = {k: i for i, k in enumerate((*KINDS, "model"))}

    def place(span: str) -> tuple[int, int, int]:
        kind, start, end = span.split(":")
        return int(start), rank[kind], int(end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = batch.column("windows").to_pylist()
            scores = model.scores([w for row in windows for w in row]) if model else np.zeros(sum(map(len, windows)))
            bases, spans, added, at = [], [], [], 0
            for base, starts, ends, ruled in zip(*(batch.column(c).to_pylist() for c in ("base", "starts", "ends", "ruled"))):
                own = [f"model:{s}:{e}" for i, (s, e, r) in enumerate(zip(starts, ends, ruled))
                       if not r and model and scores[at + i] >= model.threshold]
                at += len(starts)
                bases.append(",".join(base))
                spans.append(",".join(sorted(base + own, key=place)))
                added.append(len(own))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "n_assign", "n_access", "n_hex")), pa.array(bases, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans", "n_added"])
    return run
