"""Helpers shared by the operators: the shared folder, batches of bounded bytes, words by array arithmetic."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

SPACES = b" \t\n\x0b\x0c\r"
CHUNK_BYTES = 2 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


# ------------------------------------------------------------------- tables

def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Only id and text, a null text as an empty one; further columns of any name are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, from spark.checkpoint.dir; a local session may make its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="lexigaze-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: For tables of large rows: few of them in a row group, so that a reader never holds many at once.
LARGE_ROWS = {"parquet.block.size": 4 << 20, "parquet.page.size.row.check.min": 1}


def written(df: DataFrame, **options) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, read by many, kept when executors go.

    The files go when the application ends. ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    if _open := getattr(_scopes, "open", None):
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, most: str = "4m") -> Iterator[None]:
    """Arrow batches of few bytes for the steps that run inside: neither the executor nor its workers then hold many large rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


_scopes = threading.local()


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside go at the end, but for a result given to the function this yields, which is written, too."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    _scopes.open.append([])

    def keep(result: DataFrame) -> DataFrame:
        table = written(result)
        _scopes.open[-1].pop()
        return table

    try:
        yield keep
    finally:
        for path in _scopes.open.pop():
            place, files = _place(spark, path)
            files.delete(place, True)


def discard(table: DataFrame) -> None:
    """Delete a table that ``written`` made and nothing will read again."""
    for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if "/table-" in file:
            place, files = _place(table.sparkSession, file)
            files.delete(place, True)


MARKS = 1 << 20


def numbered(docs: DataFrame) -> DataFrame:
    """row, doc_id, text: written, so that every later step sees the same number for a row, whatever its id."""
    return written(texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))


def with_number(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written with a number for each row, and the name of that column."""
    own = next(n for n in ("row", *(f"row_{i}" for i in range(len(docs.columns) + 1))) if n not in docs.columns)
    return written(docs.withColumn(own, F.monotonically_increasing_id())), own


def marked(table: DataFrame, column: str, wanted: DataFrame, name: str) -> DataFrame:
    """Rows whose ``column`` may be among the numbers ``name`` of ``wanted``, found without a shuffle.

    What is sent to the tasks are marks of the numbers, ``MARKS`` of them at most; an exact join comes after.
    """
    mark = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS))
    marks = wanted.select(mark(name).alias("mark")).distinct()
    return table.join(F.broadcast(marks), mark(column) == F.col("mark"), "left_semi")


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def bucket(column: str, buckets: int):
    """crc32 of a number written as text, modulo ``buckets``: the fold of the held-out rules."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(buckets)


# ------------------------------------------------------------------ batches

def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``most`` bytes of text, or of a single longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column without gaps, and the len + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


# -------------------------------------------------------------------- words

def table_of(separators: bytes | None = None, keep=None) -> np.ndarray:
    """Which of the 256 bytes belong to words."""
    table = np.ones(256, bool) if separators is not None else np.array([keep(b) for b in range(256)])
    if separators is not None:
        table[list(separators)] = False
    return table


SPACED = table_of(SPACES)
#: Words of digits, letters and everything beyond ASCII.
ALNUM = table_of(keep=lambda b: not (b <= 0x2F or 0x3A <= b <= 0x60 and not 0x41 <= b <= 0x5A or 0x7B <= b <= 0x7F))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spread(x: int) -> np.uint64:
    """A number for every small one, far apart."""
    return np.uint64(x * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


class Rolling:
    """Hashes of any stretch of a byte array from one prefix sum, modulo 2**64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int = 1, lower: bool = False):
        values = mix((np.arange(256, dtype=np.uint64) + np.uint64(seed * 1000 + 1)) * _GOLDEN)
        if lower:
            values = values[_LOWER]
        self.powers, self.inverse = self._get(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * self.powers[:len(data)], out=self.sums[1:])

    @classmethod
    def _get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(0)
        if have is None or len(have[0]) < n:
            size = max(n, CHUNK_BYTES + 4096)
            base = 0xD1342543DE82EF95
            back = pow(base, -1, 1 << 64)
            made = []
            for b in (base, back):
                full = np.full(size, b, np.uint64)
                full[0] = 1
                made.append(np.cumprod(full, dtype=np.uint64))
            have = (made[0], made[1])
            if size <= 4 * CHUNK_BYTES:
                cls._powers[0] = have
        return have

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One hash per stretch; its length is part of it."""
        plain = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(plain + (end - start).astype(np.uint64) * _GOLDEN)


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and how many of them each text has; no word crosses a text's end."""
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(column: pa.Array, table: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, A-Z lower-cased, and the number of words of each text."""
    data, offsets = text_bytes(column)
    starts, ends, counts = split_words(data, offsets, table)
    return Rolling(data, seed, lower=True).of(starts, ends), counts


def gram_hashes(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within a text, and the number of runs of each text.

    A text with fewer words, but not none, is one run of all of them.
    """
    firsts = np.concatenate(([0], np.cumsum(counts)))
    runs = np.where(counts == 0, 0, np.maximum(counts - n + 1, 1))
    at = np.repeat(firsts[:-1] - np.concatenate(([0], np.cumsum(runs)[:-1])), runs) + np.arange(runs.sum())
    end = np.repeat(firsts[1:], runs)
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate((words, np.zeros(n, np.uint64)))
    for k in range(n):
        word = np.where(at + k < end, padded[at + k], np.uint64(0))
        out = mix(out * np.uint64(0x100000001B3) + word + _GOLDEN)
    return out, runs


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
