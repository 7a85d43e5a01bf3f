"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are learned by follow-the-regularised-leader with elastic-net penalties and their
probabilities calibrated by a temperature. Cases: a null text or one without letters (characters of
a letter class; numbers of any kind are none) is `und` with score 0; documents of null language or
null id only are scored, not learned from, and a null id is not held out; with one learned language
every text with letters gets it; with none all are `und`; of equally likely languages the first by
name is given; texts are read whole; repeated rows are used each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexigaze.llm.common import bucket, pieces, texts, written

_MAYBE = re.compile(r"[^\W\d_]")  # also finds numbers that are no digits
ORDERS = (1, 2, 3)
BITS = 15
SIZE = 1 << BITS


def has_letter(text: str) -> bool:
    return any(found.group().isalpha() for found in _MAYBE.finditer(text))


def gram_counts(text: str) -> np.ndarray:
    """How often each hashed character n-gram stands in the lower-cased text."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    out = np.zeros(SIZE, np.int64)
    code = np.zeros(len(chars), np.uint64)
    for order in ORDERS:
        if len(chars) < order:
            break
        code = code[:len(chars) - order + 1] * np.uint64(0x100000001B3) + chars[order - 1:] + np.uint64(order)
        out += np.bincount(((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64), minlength=SIZE)
    return out


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each hashed n-gram stands: one small table per task, summed by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SIZE, np.int64), 0
        for batch in pieces(batches):
            for text in batch.column("text").to_pylist():
                total += gram_counts(text) > 0
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # at most SIZE + 1
    out, n = np.zeros(SIZE), 0
    for gram, count in rows:
        if gram < 0:
            n = count
        else:
            out[gram] = count
    return out, n


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # grams x languages
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        counts = gram_counts(text)
        at = np.flatnonzero(counts)
        v = np.log1p(counts[at]) * self.idf[at]
        return at, v / max(np.sqrt((v * v).sum()), 1e-12)

    def logits(self, text: str) -> np.ndarray:
        at, v = self.vector(text)
        return v @ self.weights[at] + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return "und", 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


class Ftrl:
    """Follow the regularised leader, per coordinate, with L1 and L2 penalties."""

    def __init__(self, size: int, classes: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.05, l2: float = 0.01):
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, v: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(v @ w)
        p[label] -= 1
        g = v[:, None] * p
        more = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = more


def train(rows: list[tuple[str, str]], df: np.ndarray, n: int, epochs: int = 4, seed: int = 5) -> Model:
    """``rows`` are (text, language); every fifth is held back for the temperature."""
    languages = sorted({lang for _, lang in rows})
    idf = np.log((1 + n) / (1 + df)) + 1
    model = Model(languages, idf, np.zeros((SIZE, len(languages))), np.zeros(len(languages)))
    if len(languages) < 2:
        return model
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, used = order[::5], np.delete(order, np.s_[::5])
    vectors = {i: model.vector(rows[i][0]) for i in used.tolist()}
    which = {lang: k for k, lang in enumerate(languages)}
    leader = Ftrl(SIZE + 1, len(languages))
    for _ in range(epochs):
        for i in rng.permutation(used).tolist():
            at, v = vectors[i]
            leader.update(np.append(at, SIZE), np.append(v, 1.0), which[rows[i][1]])
    full = leader.weights(slice(None))
    model.weights, model.bias = full[:SIZE], full[SIZE]
    logits = [(model.logits(rows[i][0]), which[rows[i][1]]) for i in held.tolist()]
    losses = {t: -sum(np.log(softmax(z / t)[k] + 1e-12) for z, k in logits) for t in np.geomspace(0.05, 5, 40)}
    model.temperature = float(min(losses, key=losses.get))
    return model


def identify(docs: DataFrame, per_language: int = 500, max_bytes: int = 20_000, most_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    Document frequencies come from all documents that may be learned from; the weights from about
    ``per_language`` of them for every language (chosen by a hash, none longer than ``max_bytes``), or an
    equal part of ``most_rows`` where there are too many languages for that.
    """
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket("doc_id", 5) != 0)).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    df, n = document_frequencies(learn)
    sizes = written(learn.groupBy(F.col("lang").alias("known")).agg(F.count(F.lit(1)).alias("n")))
    each = min(per_language, most_rows // max(sizes.count(), 1))
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = learn.join(sizes, F.col("lang") == F.col("known")).where((spread < F.lit(float(each)) / F.col("n")) & (F.octet_length("text") <= max_bytes))
    rows = chosen.orderBy("doc_id").limit(2 * most_rows).collect()
    model = train([(r.text, r.lang) for r in rows], df, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            got = [model.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                                             ["doc_id", "lang_pred", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double").select(
        "doc_id", F.coalesce(bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
