"""Ranked lexical search over an index whose posting lists are cut into blocks of alike documents.

The index is a table of segments, each some thousand documents. A segment keeps every document's
terms with their impact, and for each term the list of its documents. A list longer than a block
is clustered: a few of its documents stand for a block each, every other one joins the most alike
by a short random projection of the impacts. A block stores the greatest impact of every term
among its documents. The weighted sum of these numbers over an item's terms is never less than the
score of a document in the block, so a block is passed over exactly when this bound is below the
score of the item's k-th best document so far. A list that fits into one block needs no summary of
its own: the greatest impacts of the whole segment serve.

Terms of an item are opened by falling weight times greatest impact; once all terms still closed
can't together lift a document to the k-th best score, the segment is done. All scores are whole
numbers, so the bounds are exact and nothing is lost to rounding. Segments of one task hand on the
best documents found, and the results of all tasks are merged.

Only terms that occur in the items can add to a score. A bitmap of fixed size, hashed from the
items' terms, keeps most others out of the index; those that slip through do no harm.

Cases: a null text has no terms; an item without terms, or whose terms no document holds, has no
result; rows that share an id are documents (items) of their own; a null id comes last among equal
scores; empty tables give an empty result; further columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from lexigaze.llm.common import ALNUM, LARGE_ROWS, mix, pieces, signed, spread, word_hashes, written

TOP = 50
BITS = 1 << 20
SEGMENT_DOCS, SEGMENT_POSTINGS = 512, 1 << 17
BLOCK_DOCS = 128
SKETCH = 16
ITEMS_TOGETHER, STRIPES = 128, 32
GROUPS_HELD = 16  # groups of items whose best documents a task keeps in hand
LAST = np.iinfo(np.int64).max
_ARRAYS = ["ids", "nulls", "terms", "starts", "at", "impacts", "block_term", "block_starts", "block_docs", "sum_starts", "sum_block", "sum_most"]
_TYPES = dict(zip(_ARRAYS, [np.int64, np.bool_, np.uint64, np.int64, np.int32, np.int32, np.int32, np.int64, np.int32, np.int64, np.int32, np.int32]))
_SEGMENT = "segment long, " + ", ".join(f"{a} binary" for a in _ARRAYS)


# -------------------------------------------------------------------- terms

def _counted(column: pa.Array, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text: how many in all, how many different, and these with their counts."""
    hashes, counts = word_hashes(column, ALNUM)
    owner = np.repeat(np.arange(len(counts)), counts)
    if bits is not None:
        known = bits[hashes & np.uint64(BITS - 1)]
        hashes, owner = hashes[known], owner[known]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return counts, np.bincount(owner[first], minlength=len(counts)), hashes[first], np.diff(np.append(first, len(hashes)))


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(values))


def term_table(texts: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """row, id, n (terms with repeats), terms (hashes of the different ones), counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n, different, terms, counts = _counted(batch.column("text"), bits)
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), batch.column("id"), pa.array(n, pa.int64()), _lists(signed(terms), different), _lists(counts.astype(np.int32), different)],
                ["row", "id", "n", "terms", "counts"])
    return texts.mapInArrow(run, "row long, id long, n long, terms array<long>, counts array<int>")


def _numbered(table: DataFrame, id_column: str) -> DataFrame:
    return table.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))


def _bitmap(items: DataFrame) -> np.ndarray:
    """Which of ``BITS`` places the items' terms fall on; never more than that many numbers reach the driver."""
    places = items.select(F.explode("terms").alias("t")).select((F.col("t").bitwiseAND(BITS - 1)).cast("int").alias("place")).distinct()
    bits = np.zeros(BITS, bool)
    bits[[r.place for r in places.toLocalIterator()]] = True
    return bits


# ----------------------------------------------------------------- segments

def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the given stretches, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def _clustered(docs: np.ndarray, sketches: np.ndarray, block_docs: int) -> list[np.ndarray]:
    """The list's documents in blocks: each joins the most alike of some that stand for a block."""
    n_blocks = -(-len(docs) // block_docs)
    heads = docs[np.arange(n_blocks) * len(docs) // n_blocks]
    owner = np.argmax(sketches[docs] @ sketches[heads].T, axis=1)
    order = np.argsort(owner, kind="stable")
    parts = np.split(docs[order], np.cumsum(np.bincount(owner, minlength=n_blocks))[:-1])
    # a block much larger than wanted is cut; its parts are as much alike as before
    return [cut for part in parts if len(part) for cut in np.array_split(part, -(-len(part) // (2 * block_docs)))]


def build_segment(ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, terms: np.ndarray, impacts: np.ndarray, block_docs: int = BLOCK_DOCS) -> dict[str, np.ndarray]:
    """A segment's arrays from its documents: ``lengths`` postings each, ``terms`` and ``impacts`` in a row."""
    names, at = np.unique(terms, return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    owner = np.repeat(np.arange(len(lengths)), lengths)
    random = mix(names[:, None] + mix(np.arange(SKETCH, dtype=np.uint64) + spread(3))[None, :])
    signs = (random >> np.uint64(63)).astype(np.float32) * 2 - 1
    sketches = np.zeros((len(lengths), SKETCH), np.float32)
    filled = np.flatnonzero(lengths)
    if len(filled):
        sketches[filled] = np.add.reduceat(signs[at] * impacts[:, None].astype(np.float32), starts[filled], axis=0)
    sketches /= np.maximum(np.sqrt((sketches ** 2).sum(1, keepdims=True)), 1e-9)

    order = np.argsort(at, kind="stable")
    sizes = np.bincount(at, minlength=len(names))
    firsts = np.concatenate(([0], np.cumsum(sizes)))
    by_term = owner[order]
    block_term, blocks, keys, most = [], [], [], []
    scratch = np.zeros(len(names), np.int32)
    for term in range(len(names)):
        docs = by_term[firsts[term]:firsts[term + 1]]
        if len(docs) <= block_docs:
            block_term.append(term)
            blocks.append(docs)
            continue
        for docs in _clustered(docs, sketches, block_docs):
            places = _ranges(starts[docs], lengths[docs])
            np.maximum.at(scratch, at[places], impacts[places])
            seen = np.flatnonzero(scratch)
            keys.append(seen.astype(np.int64) * (1 << 31) + len(blocks))
            most.append(scratch[seen])
            scratch[seen] = 0
            block_term.append(term)
            blocks.append(docs)
    keys, most = (np.concatenate(keys), np.concatenate(most)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int32))
    by_key = np.argsort(keys, kind="stable")
    found = {
        "ids": ids, "nulls": nulls, "terms": names, "starts": starts, "at": at, "impacts": impacts, "block_term": np.array(block_term),
        "block_starts": np.concatenate(([0], np.cumsum([len(b) for b in blocks]))), "block_docs": np.concatenate(blocks) if blocks else np.zeros(0),
        "sum_starts": np.searchsorted(keys[by_key] >> 31, np.arange(len(names) + 1)), "sum_block": keys[by_key] & ((1 << 31) - 1), "sum_most": most[by_key]}
    return {name: np.ascontiguousarray(found[name], _TYPES[name]) for name in _ARRAYS}


def impacts_of(counts: np.ndarray, n: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 20 m) with m = 50 + (50 n N) div L, in whole numbers."""
    if not all_terms:
        return np.zeros(len(counts), np.int64)
    m = 50 + (50 * n.astype(object) * documents // all_terms).astype(np.int64) if n.max(initial=0) * 50 * documents >= 1 << 62 else 50 + 50 * n * documents // all_terms
    return 1_000_000_000 * counts // (1000 * counts + 20 * m)


def build_index(vectors: DataFrame, documents: int, all_terms: int, segment_docs: int = SEGMENT_DOCS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The table of segments; documents stay in the task that reads them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = TaskContext.get().partitionId() << 32, []
        waiting = [0, 0]

        def segment() -> pa.RecordBatch:
            nonlocal made
            ids, lengths, terms, impacts = (np.concatenate(x) for x in zip(*[h[:4] for h in held]))
            arrays = build_segment(ids, np.concatenate([h[4] for h in held]), lengths, terms, impacts, block_docs)
            made += 1
            held.clear()
            waiting[:] = [0, 0]
            return pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), *[pa.array([arrays[a].tobytes()], pa.binary()) for a in _ARRAYS]], ["segment", *_ARRAYS])

        for batch in batches:
            lists, counted = batch.column("terms"), batch.column("counts")
            ends = np.append(lists.offsets.to_numpy(), 0)[:len(lists) + 1].astype(np.int64)
            ends -= ends[0]
            lengths = np.diff(ends)
            terms, counts = lists.flatten().to_numpy().view(np.uint64), counted.flatten().to_numpy().astype(np.int64)
            ids, nulls = batch.column("id").fill_null(LAST).to_numpy(), np.asarray(batch.column("id").is_null())
            impacts = impacts_of(counts, np.repeat(batch.column("n").to_numpy(), lengths), documents, all_terms).astype(np.int32)
            at = 0
            while at < batch.num_rows:
                room = int(np.searchsorted(ends, ends[at] + SEGMENT_POSTINGS - waiting[1], side="right")) - 1
                end = min(batch.num_rows, at + segment_docs - waiting[0], max(room, at + (not held)))
                if end > at:
                    held.append((ids[at:end], lengths[at:end], terms[ends[at]:ends[end]], impacts[ends[at]:ends[end]], nulls[at:end]))
                    waiting[0] += end - at
                    waiting[1] += int(ends[end] - ends[at])
                if end < batch.num_rows or waiting[0] >= segment_docs:
                    yield segment()
                at = end
        if held:
            yield segment()
    return vectors.mapInArrow(run, _SEGMENT)


# ------------------------------------------------------------------- search

class Segment:
    """One segment opened for search."""

    def __init__(self, row: dict):
        for name in _ARRAYS:
            setattr(self, name, np.frombuffer(row[name], _TYPES[name]))
        self.lengths = np.diff(self.starts)
        self.most = np.zeros(len(self.terms), np.int64)
        np.maximum.at(self.most, self.at, self.impacts.astype(np.int64))
        self.weights = np.zeros(len(self.terms), np.int64)
        self.first_block = np.searchsorted(self.block_term, np.arange(len(self.terms) + 1))
        self.scored = self.skipped = 0

    def scores(self, docs: np.ndarray) -> np.ndarray:
        places = _ranges(self.starts[docs], self.lengths[docs])
        return np.add.reduceat(self.weights[self.at[places]] * self.impacts[places], np.cumsum(self.lengths[docs]) - self.lengths[docs])

    def search(self, terms: np.ndarray, weights: np.ndarray, best: tuple[np.ndarray, np.ndarray, np.ndarray], k: int):
        """``best`` (scores, ids, nulls), then the same with this segment's documents among them."""
        place = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        here = self.terms[place] == terms if len(self.terms) else np.zeros(len(terms), bool)
        place, weights = place[here], weights[here].astype(np.int64)
        order = np.argsort(-weights * self.most[place], kind="stable")
        place, weights = place[order], weights[order]
        closed = np.concatenate((np.cumsum((weights * self.most[place])[::-1])[::-1], [0]))  # what terms from here on can add
        self.weights[place] = weights
        bounds = np.zeros(len(self.block_term), np.int64)
        for t, w in zip(place, weights):
            part = slice(self.sum_starts[t], self.sum_starts[t + 1])
            bounds[self.sum_block[part]] += w * self.sum_most[part]
        seen = np.zeros(len(self.ids), bool)
        waiting: list[np.ndarray] = []

        def least() -> int:
            return int(best[0][-1]) if len(best[0]) == k else 1

        def score(docs: np.ndarray) -> None:
            nonlocal best
            docs = np.unique(docs[~seen[docs]])
            if not len(docs):
                return
            seen[docs] = True
            self.scored += len(docs)
            found = self.scores(docs)
            good = found >= least()
            every = [np.concatenate(x) for x in zip(best, (found[good], self.ids[docs[good]], self.nulls[docs[good]]))]
            order = np.lexsort((every[1], every[2], -every[0]))[:k]
            best = tuple(x[order] for x in every)

        for i, t in enumerate(place):
            if closed[i] < least():
                break
            blocks = np.arange(self.first_block[t], self.first_block[t + 1])
            if len(blocks) == 1:
                waiting.append(self.block_docs[self.block_starts[blocks[0]]:self.block_starts[blocks[0] + 1]])
                continue
            if waiting:
                score(np.concatenate(waiting))
                waiting.clear()
            if closed[i] < least():
                break
            for b in blocks[np.argsort(-bounds[blocks], kind="stable")]:
                if bounds[b] < least():
                    self.skipped += 1
                    continue
                score(self.block_docs[self.block_starts[b]:self.block_starts[b + 1]])
        if waiting:
            score(np.concatenate(waiting))
        self.weights[place] = 0
        return best


def _nothing() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}  # by group of items: its items' best documents

        def rows(groups: list[dict]) -> pa.RecordBatch:
            found = [(row, b) for g in groups for row, b in g.items() if len(b[0])]
            item = np.repeat(np.array([row for row, _ in found], np.int64), [len(b[0]) for _, b in found]) if found else np.zeros(0, np.int64)
            scores, ids, nulls = (np.concatenate([b[c] for _, b in found]) if found else x for c, x in enumerate(_nothing()))
            return pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=nulls), pa.array(scores)], ["item", "doc_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                segment, group = Segment(row), row["group"]
                if group not in held and len(held) == GROUPS_HELD:
                    yield rows([held.pop(next(iter(held)))])
                best = held.setdefault(group, {})
                for item in row["items"]:
                    best[item["row"]] = segment.search(
                        np.array(item["terms"], np.int64).view(np.uint64), np.array(item["weights"], np.int64), best.get(item["row"], _nothing()), k)
        yield rows(list(held.values()))
    return run


def weighted_items(items: DataFrame, vectors: DataFrame, documents: int) -> DataFrame:
    """row, terms, weights: the items' terms that documents hold, with floor(1000 ln((2N + 2) / (2 df + 1)))."""
    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * documents) + 2) / (2 * F.col("df") + 1))).cast("long")
    pairs = items.select("row", F.explode("terms").alias("term")).join(held, "term").select("row", "term", weight.alias("weight"))
    return pairs.where("weight > 0").groupBy("row").agg(F.collect_list(F.struct("term", "weight")).alias("pairs")).select(
        "row", F.col("pairs.term").alias("terms"), F.col("pairs.weight").alias("weights"))


def search(index: DataFrame, weighted: DataFrame, k: int = TOP) -> DataFrame:
    """item (row number), doc_id, score, rank: the ``k`` best documents of every item."""
    groups = max(1, -(-weighted.count() // ITEMS_TOGETHER))
    grouped = weighted.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).groupBy("group").agg(
        F.collect_list(F.struct("row", "terms", "weights")).alias("items"))  # about ITEMS_TOGETHER of them
    left = index.withColumn("stripe", F.pmod(F.xxhash64("segment"), F.lit(STRIPES)).cast("int"))
    right = grouped.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(STRIPES - 1))))
    found = left.join(right, "stripe").drop("stripe", "segment").mapInArrow(_searched(k), "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))  # tasks pass on k rows of an item each
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP, segment_docs: int = SEGMENT_DOCS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score: for every item the ``k`` documents of highest score above 0."""
    asked = written(term_table(_numbered(items, "item_id")))
    vectors = written(term_table(_numbered(docs, "doc_id"), _bitmap(asked)))
    size = vectors.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    index = written(build_index(vectors.where(F.size("terms") > 0), size.documents, size.terms, segment_docs, block_docs), **LARGE_ROWS)
    found = search(index, written(weighted_items(asked, vectors, size.documents)), k)
    return found.join(asked.select(F.col("row").alias("item"), F.col("id").alias("item_id")), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
