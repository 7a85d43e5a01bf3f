"""Quality classifier: a byte-level convolutional network over overlapping chunks of the whole document.

Cases: a null or empty text is one chunk of padding and gets that chunk's probability; texts of
any length are covered by chunks to their end; repeated rows and labels are used each; a null id has
no label and is not held out; without labels of both values every score is the share of the labels
(0.5 without any); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexigaze.llm.common import bucket, pieces, text_bytes, texts
from lexigaze.llm.conv import ConvNet, overlapping

WIDTH, STRIDE, FILTERS = 8, 4, 32
CHUNK, OVERLAP = 512, 32


def segments(data: np.ndarray) -> np.ndarray:
    return overlapping(data, CHUNK, OVERLAP)


def scores(net: ConvNet, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probabilities of the texts in a byte array."""
    chunks = [segments(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    counts = np.array([len(c) for c in chunks])
    every = np.concatenate(chunks)
    top = np.concatenate([net.highest(every[i:i + 256]) for i in range(0, len(every), 256)])
    features = net.combine(top, np.concatenate(([0], np.cumsum(counts)[:-1])))
    return net.probability(features @ net.out + net.shift[0])


def sample(docs: DataFrame, labels: DataFrame, rows: int, max_bytes: int) -> tuple[list[bytes], np.ndarray, np.ndarray, float]:
    """At most ``rows`` labelled texts of each label in the order of a hash, their fold, and the share of label 1."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    shares = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("label IN (0, 1)").collect()}
    if not shares:
        return [], np.zeros(0), np.zeros(0), 0.5
    ids = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    some = F.broadcast(ids[0].unionByName(ids[1]))  # at most twice ``rows`` numbers
    got = texts(docs).where(F.octet_length("text") <= max_bytes).join(some, "doc_id").orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(2 * rows).collect()
    fold = np.array([r.doc_id % 5 for r in got])
    return [r.text.encode() for r in got], np.array([r.label for r in got]), fold, shares.get(1, 0) / sum(shares.values())


def train(data: list[bytes], labels: np.ndarray, fold: np.ndarray, share: float, epochs: int = 6) -> ConvNet | None:
    """Trained on four folds with both labels weighing the same, calibrated on the fifth at the labels' own share."""
    if len(set(labels.tolist())) < 2:
        return None
    chunks = [segments(np.frombuffer(t, np.uint8)) for t in data]
    held = fold == 0 if len(set(labels[fold == 0].tolist())) == 2 and len(set(labels[fold != 0].tolist())) == 2 else np.ones(len(labels), bool)
    used = ~held if not held.all() else held
    mean = labels[used].mean()
    even = np.where(labels == 1, 0.5 / mean, 0.5 / (1 - mean)).astype(np.float32)
    net = ConvNet(WIDTH, STRIDE, FILTERS)
    at = np.flatnonzero(used)
    net.train([chunks[i] for i in at], labels[at].astype(np.float32), even[at], epochs, batch=16)
    at = np.flatnonzero(held)
    logits = np.array([float(net.logits(chunks[i], np.array([0]))[0]) for i in at])
    mean = labels[at].mean()
    net.calibrate(logits, labels[at], np.where(labels[at] == 1, share / mean, (1 - share) / (1 - mean)))
    return net


def classify(docs: DataFrame, labels: DataFrame, rows: int = 1500, max_bytes: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    The network learns from at most ``rows`` texts of each label, none longer than ``max_bytes``
    and none of the held-out fold; it scores whole texts. Only the trained filters are sent to the tasks.
    """
    train_ids = labels.where(bucket("doc_id", 4) != 2)
    data, known, fold, share = sample(docs, train_ids, rows, max_bytes)
    net = train(data, known, fold, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=512 << 10):
            got = scores(net, *text_bytes(batch.column("text"))) if net else np.full(batch.num_rows, share)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got.astype(np.float64))], ["doc_id", "score"])

    scored = texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
