"""Repeated substrings: sparse suffix arrays, their common-prefix interval trees, maximal repeats.

Suffixes are sampled by content: of every stretch of ``length`` bytes the place of the least hash of
``ANCHOR`` bytes is an anchor, so equal stretches hold equal anchors at equal places, and every
repeat of ``length`` bytes or more shows itself at the anchors it contains. The context of an anchor
is what the stretches it stands for cover. Then, with nothing but counts and joins by key:

1. anchors that stand once in the corpus are dropped;
2. equal contexts are one leaf with a multiplicity, all of its stretches repeat;
3. where an anchor has several contexts, its contexts are fetched and put into an enhanced suffix
   array (suffixes from the anchor on, in order, with common-prefix lengths); a stack scan gives the
   prefix intervals, and within each interval the same is done to the left. Intervals with more than
   one byte before and more than one after are maximal repeats, given with all occurrences.

An anchor with more than ``GROUP`` contexts is cut into finer ones, which stand for 32 neighbouring
stretches and then for single ones: the part common to those stretches becomes the key. A single
stretch is its own context, so that nothing is left to compare and no array grows with the corpus.
Repeats are maximal within the contexts of an anchor; longer ones are chains of them.

Rows get numbers in the first written table and are known by them from then on. Cases: a null or
empty text has no repeats; matches never cross documents; overlapping repeats of one document count;
rows are documents each, also those with the same or a null id, and repeated rows repeat each other;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lexigaze.llm.common import Rolling, pieces, signed, text_bytes, texts, written

LENGTH = 400
ANCHOR = 160
GROUP = 4096
FINER = (32, 1)
MARKS = 1 << 20


# ------------------------------------------------------------------- anchors

def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of ``width``, from least values within blocks forwards and backwards."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, 1).reshape(-1)
    backward = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(backward[:n - width + 1], forward[width - 1:n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """Text, place, first and last start of the stretches (all as offsets into ``data``), and two hashes of each anchor.

    The first hash is of the anchor's bytes, the second of its context and its place in it.
    """
    n, width = len(data), length - anchor + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    rolling = Rolling(data)
    at = np.arange(n - anchor + 1)
    hashes = rolling.of(at, at + anchor)
    # the place breaks ties, the leftmost wins; batches are below 2**24 bytes unless they are a single text
    bits = np.uint64(max(int(n).bit_length(), 24))
    keyed = (hashes >> bits << bits) | at.astype(np.uint64)
    least = (_sliding_least(keyed, width) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # stretches that lie within one text
    inside = np.zeros(n + 1, np.int32)
    begin, end = offsets[:-1], np.maximum(offsets[1:] - length + 1, offsets[:-1])
    some = end > begin
    np.add.at(inside, begin[some], 1)
    np.add.at(inside, end[some], -1)
    starts = np.flatnonzero(np.cumsum(inside[:len(least)]) > 0)
    place = least[starts]
    text = np.searchsorted(offsets, starts, side="right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    first, last = starts[at], starts[np.append(at[1:], len(starts)) - 1] if len(at) else starts[:0]
    place, text = place[at], text[at]
    second = Rolling(data, seed=2)
    context = second.of(first, last + length) ^ (place - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return text, place, first, last, hashes[place], context


def _anchor_rows(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offsets = text_bytes(batch.column("text"))
            text, place, first, last, key, context = anchors(data, offsets, length, anchor)
            own = offsets[text] if len(text) else offsets[:0]
            ids = batch.column("doc_id").take(pa.array(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(key)), pa.array(signed(context)), ids, pa.array(place - own, pa.int32()),
                 pa.array(first - own, pa.int32()), pa.array(last - own, pa.int32())],
                ["key", "context", "doc_id", "place", "first", "last"])
    return run


# ------------------------------------------------- suffix array of one anchor

def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def suffix_array(suffixes: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of the suffixes, and the common-prefix length of each with the one before it in that order."""
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    return order, [0] + [common_prefix(suffixes[a], suffixes[b]) for a, b in zip(order, order[1:])]


def intervals(prefix: list[int], least: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """Prefix intervals (value, first, end, where its children begin) of value ``least`` or more, by one stack scan."""
    stack: list[tuple[int, int, list[int]]] = []
    for at in range(1, len(prefix) + 1):
        value = prefix[at] if at < len(prefix) else -1
        first = at - 1
        while stack and stack[-1][0] > value:
            top, first, cuts = stack.pop()
            if top >= least:
                yield top, first, at, [first, *cuts]
        if value < 0:
            break
        if stack and stack[-1][0] == value:
            stack[-1][2].append(at)
        else:
            stack.append((value, first, [at]))


def maximal_groups(contexts: list[bytes], places: list[int], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats (bytes before the anchor, bytes from it on, members) of ``length`` bytes or more.

    The outer intervals differ in the byte after the repeat, the inner ones in the byte before it;
    an inner interval whose members all go on alike is longer to the right and found there.
    """
    right = [c[p:] for c, p in zip(contexts, places)]
    left = [c[:p][::-1] for c, p in zip(contexts, places)]
    order, prefix = suffix_array(right)
    reach = max(map(len, left))
    for after, a, b, cuts in intervals(prefix, max(length - reach, 0)):
        members = order[a:b]
        child = {}
        for number, (start, end) in enumerate(zip(cuts, [*cuts[1:], b])):
            child.update((m, number) for m in order[start:end])
        back, common = suffix_array([left[m] for m in members])
        for before, c, d, _ in intervals(common, max(length - after, 0)):
            group = [members[i] for i in back[c:d]]
            if len({child[m] for m in group}) > 1:
                yield before, after, group


# ---------------------------------------------------------------- the corpus

_ROW = "key long, context long, doc_id long, place int, first int, last int"
_FOUND = "key long, context long, n long, doc_id long, start int, length int, repeat long"


def _mark(row: str = "doc_id"):
    return F.pmod(F.xxhash64(row), F.lit(MARKS))


def _near(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Texts whose id may be (``left_anti``: can't be) among ``ids``, without a shuffle of the others.

    What is sent to the tasks are marks of the ids, of which there are at most ``MARKS``.
    """
    marks = written(ids.select(_mark().alias("mark")).distinct())
    return texts(docs).join(F.broadcast(marks), _mark() == F.col("mark"), how)


def _fetch(rows: DataFrame, docs: DataFrame) -> DataFrame:
    rows = written(rows)
    return rows.join(_near(docs, rows), "doc_id")


def _cut(length: int):
    """Contexts in place of the whole texts they were cut from."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offsets = text_bytes(batch.column("text"))
            whole = data.tobytes()
            cut = [whole[o + f:o + t + length] for o, f, t in zip(offsets.tolist(), batch.column("first").to_pylist(), batch.column("last").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "context", "n", "doc_id", "place", "first")), pa.array(cut, pa.binary())],
                                             ["key", "context", "n", "doc_id", "place", "first", "bytes"])
    return run


def _grouped(length: int, merged: bool):
    """Maximal repeats of every anchor; the rows of an anchor stand together.

    ``merged``: only what they cover of each row, so that there are hardly more rows out than in.
    """
    names = ("key", "context", "n", "doc_id", "place", "first", "bytes")

    def repeats(rows: list[tuple]) -> Iterator[tuple]:
        contexts = [r[6] for r in rows]
        for before, after, group in maximal_groups(contexts, [r[4] - r[5] for r in rows], length):
            one = rows[group[0]]
            at = one[4] - one[5] - before
            name = xxhash.xxh3_64_intdigest(one[6][at:at + before + after]) - (1 << 63)
            for m in group:
                r = rows[m]
                yield r[0], r[1], r[2], r[3], r[4] - before, before + after, name

    def covers(rows: list[tuple]) -> Iterator[tuple]:
        spans: list[list[tuple[int, int]]] = [[] for _ in rows]
        for before, after, group in maximal_groups([r[6] for r in rows], [r[4] - r[5] for r in rows], length):
            for m in group:  # all of them hold the anchor
                spans[m].append((rows[m][4] - before, rows[m][4] + after))
        for r, own in zip(rows, spans):
            if own and r[2] < 2:  # equal contexts are removed as a whole anyway
                start = min(a for a, _ in own)
                yield r[0], r[1], r[2], r[3], start, max(b for _, b in own) - start, 0

    each = covers if merged else repeats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if held and row[0] != held[0][0]:
                    out.extend(each(held) if len(held) > 1 else ())
                    held = []
                held.append(row)
            yield _found(out)
        yield _found(list(each(held)) if len(held) > 1 else [])
    return run


def _found(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64()]
    columns = list(zip(*rows)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                      ["key", "context", "n", "doc_id", "start", "length", "repeat"])


def _finer(length: int, width: int):
    """Anchors that stand for at most ``width`` neighbouring stretches, keyed by what those have in common."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, doc_id, place, first, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "place", "first", "bytes"))):
                far = place - first
                near = far - (len(raw) - length)  # distances of the stretches' starts before the anchor
                for block in range(near // width, far // width + 1):
                    a, b = max(far - (block * width + width - 1), 0), min(far - block * width, len(raw) - length)
                    # what every stretch of the whole block holds, also where this context has only some of them
                    core = raw[max(far - block * width, 0):far - (block * width + width - 1) + length]
                    seed = f"{key}:{block}:{width}".encode()
                    rows.append((xxhash.xxh3_64_intdigest(seed + core) - (1 << 63), xxhash.xxh3_64_intdigest(raw[a:b + length], far - a) - (1 << 63),
                                 doc_id, place, first + a, first + b))
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int64()] * 3 + [pa.int32()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["key", "context", "doc_id", "place", "first", "last"])
    return run


def _resolve(rows: DataFrame, docs: DataFrame, length: int, group: int, merged: bool, finer: tuple[int, ...] = FINER) -> list[tuple[DataFrame, DataFrame]]:
    """For anchors (rows of ``_ROW``): the repeats found in arrays and the repeated rows they stand for."""
    again = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1))
    rows = written(rows.join(again.select("key"), "key"))
    contexts = written(rows.groupBy("key", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "place", "first", "last")).alias("one")).select("key", "context", "n", "one.*"))
    sizes = written(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("m")))
    alike = written(contexts.where("n > 1").select("key", "context"))
    whole = rows.join(alike, ["key", "context"]).select(
        "key", "context", F.lit(0).cast("long").alias("n"), "doc_id", F.col("first").alias("start"),
        (F.col("last") - F.col("first") + length).alias("length"), F.xxhash64("key", "context").alias("repeat"))
    mixed = contexts.join(sizes.where("m > 1"), "key")
    cut = "key long, context long, n long, doc_id long, place int, first int, bytes binary"
    arrays = _fetch(mixed.where(F.col("m") <= group), docs).select("key", "context", "n", "doc_id", "place", "first", "last", "text").mapInArrow(
        _cut(length), cut).repartition("key").sortWithinPartitions("key").mapInArrow(_grouped(length, merged), _FOUND)
    out = [(whole, rows), (arrays, rows)]
    if finer and sizes.where(F.col("m") > group).limit(1).count():
        large = _fetch(mixed.where(F.col("m") > group), docs).select("key", "context", "n", "doc_id", "place", "first", "last", "text").mapInArrow(
            _cut(length), cut).mapInArrow(_finer(length, finer[0]), _ROW)
        out += _resolve(written(large), docs, length, group, merged, finer[1:])
    return out


def _anchored(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    return written(texts(docs).where(F.octet_length("text") >= length).mapInArrow(_anchor_rows(length, anchor), _ROW))


def _numbered(docs: DataFrame) -> DataFrame:
    """row, doc_id, text: written, so that every step sees the same number for a row, whatever its id."""
    return written(texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))


def _by_row(numbered: DataFrame) -> DataFrame:
    """The table the steps work on: a row's number takes the place of its id."""
    return numbered.select(F.col("row").alias("doc_id"), "text")


def repeat_groups(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """repeat, length, doc_id, row, start: every occurrence of every maximal repeat, one row each.

    ``row`` tells rows of the same id apart.
    """
    numbered, parts = _numbered(docs), []
    own = _by_row(numbered)
    for found, rows in _resolve(_anchored(own, length, anchor), own, length, group, False):
        single = found.where("n < 2").select("repeat", "length", "doc_id", "start")
        several = found.where("n > 1").select("key", "context", "repeat", "length", "doc_id", "start")
        first = rows.groupBy("key", "context").agg(F.min(F.struct("doc_id", "place")).alias("one")).select("key", "context", "one.place")
        shift = several.join(first, ["key", "context"]).select("key", "context", "repeat", "length", (F.col("start") - F.col("place")).alias("shift"))
        parts += [single, rows.join(shift, ["key", "context"]).select("repeat", "length", "doc_id", (F.col("place") + F.col("shift")).alias("start"))]
    every = reduce(DataFrame.unionByName, parts).distinct().withColumnRenamed("doc_id", "row")
    return every.join(numbered.select("row", "doc_id"), "row").select("repeat", "length", "doc_id", "row", "start")


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """doc_id and its repeated stretches (start, end), in bytes; they may overlap. Ids must be unique and not null."""
    found = [f.where("n < 2").select("doc_id", "start", (F.col("start") + F.col("length")).alias("end"))
             for f, _ in _resolve(_anchored(docs, length, anchor), docs, length, group, True)]
    return reduce(DataFrame.unionByName, found)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        kept, sizes, removed, runs = [], [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            raw = text.encode()
            merged: list[list[int]] = []
            for s in sorted((s["start"], s["end"]) for s in spans or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            at, left = 0, []
            for start, end in merged:
                left.append(raw[at:start])
                at = end
            kept.append(b"".join([*left, raw[at:]]))
            sizes.append(len(raw))
            removed.append(len(raw) - len(kept[-1]))
            runs.append(len(merged))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                                         ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes): each text without its repeated stretches, in one row per row."""
    numbered = _numbered(docs)
    spans = written(repeated_spans(_by_row(numbered), length, anchor, group).groupBy("doc_id").agg(
        F.collect_set(F.struct("start", "end")).alias("spans")).withColumnRenamed("doc_id", "row"))  # of one row: bounded by its length
    marks = written(spans.select(_mark("row").alias("mark")).distinct())
    columns = ["doc_id", "text", "spans"]
    whole = numbered.join(F.broadcast(marks), _mark("row") == F.col("mark"), "left_anti").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    some = numbered.join(F.broadcast(marks), _mark("row") == F.col("mark"), "left_semi").join(spans, "row", "left")
    return whole.select(columns).unionByName(some.select(columns)).mapInArrow(
        _removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
