"""Line dedup: lines found in many documents go, except in one of them.

Keys of lines are hashed inside the tasks, so only 16-byte hashes are dealt out; the distinct
documents of a hash are counted by partial sums, which keeps a line that stands in a third of all
documents as cheap as any other. Rows get numbers in the first written table and are known by them.
Cases: a null or empty text is one empty line; a line is counted once per document however often it
repeats there; rows that share an id are one document when documents are counted, rows without an id
together one more, which never keeps a line; each row loses its own lines; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lexigaze.functions.nulls import n_distinct
from lexigaze.llm.common import SPACES, numbered, pieces, with_number, written

MIN_CHARS = 20
MIN_DOCUMENTS = 3


def line_key(line: bytes) -> bytes:
    """The line without blanks at its ends, A-Z lower-cased."""
    return line.strip(SPACES).lower()


def _long(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def _hashed(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows, ids, keys, places = [], [], [], []
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                for place, line in enumerate((text or "").encode().split(b"\n")):
                    key = line_key(line)
                    if _long(key, min_chars):
                        keys.append(xxhash.xxh3_128_digest(key))
                        rows.append(row)
                        ids.append(doc_id)
                        places.append(place)
            both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2) if keys else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(places, pa.int32())],
                ["h1", "h2", "row", "doc_id", "place"])
    return run


def _kept(text: str | None, dropped: list[int] | None) -> tuple[str, int, int]:
    """The text without the lines at these places, its lines before, and how many went."""
    lines = (text or "").split("\n")
    out = set(dropped or ())
    return "\n".join([line for i, line in enumerate(lines) if i not in out] if out else lines), len(lines), len(out)


def _reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        rows = [_kept(t, d) for t, d in zip(batch.column("text").to_pylist(), batch.column("dropped").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
            ["doc_id", "kept_text", "n_lines", "n_dropped"])


def _replaced(names: list[str], drops: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            new = [t if t is None or not d else _kept(t, d)[0] for t, d in zip(batch.column("text").to_pylist(), batch.column(drops).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if n == "text" else batch.column(n) for n in names], names)
    return run


def dropped_lines(rows: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """row and the places of its lines that go, from row, doc_id and text.

    The hashes are written once: they are counted first and looked up afterwards, and are
    far smaller than the texts that would have to be read again.
    """
    lines = written(rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _hashed(min_chars), "h1 long, h2 long, row long, doc_id long, place int"))
    # Written, so that the join deals both sides anew and a hash of many lines can be split among tasks.
    common = written(lines.groupBy("h1", "h2").agg(n_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(
        F.col("n") >= min_documents).drop("n"))
    return lines.join(common, ["h1", "h2"]).where("NOT (doc_id <=> keeper)").groupBy("row").agg(
        F.collect_set("place").alias("dropped"))  # places of one row: never more than its lines


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """doc_id, kept_text, n_lines, n_dropped: one row per row of ``docs``."""
    rows = numbered(docs)
    return rows.join(dropped_lines(rows, min_chars, min_documents), "row", "left").select("doc_id", "text", "dropped").mapInArrow(
        _reassembled, "doc_id long, kept_text string, n_lines long, n_dropped long")


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``docs`` with all its columns, the lines gone from ``text``; a null text stays null."""
    rows, own = with_number(docs)
    names = next(n for n in ("dropped", *(f"dropped_{i}" for i in range(len(docs.columns) + 1))) if n not in rows.columns)
    drops = dropped_lines(rows.select(F.col(own).alias("row"), "doc_id", "text"), min_chars, min_documents).select(
        F.col("row").alias(own), F.col("dropped").alias(names))
    return rows.join(drops, own, "left").select(*docs.columns, names).mapInArrow(_replaced(docs.columns, names), docs.schema)
