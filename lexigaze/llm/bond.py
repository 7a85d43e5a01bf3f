"""Hard negatives by a vertical scan that reads vectors dimension by dimension.

Rows lie in blocks of bounded size, each dimension a column of its own beside its least and
greatest value. For an anchor the columns are read from its largest component to its smallest.
What the columns still unread can add to a score lies between two numbers that follow from the
block's extremes, so every row has a lower and an upper bound at any time; rows whose bounds
settle the question leave the bitmap of candidates, and the rest get exact scores.

Two scans answer a query. The first keeps an anchor's best rows of its own label; a row goes
once its upper bound is below the k-th best lower bound. The second looks for rows of other
labels whose score lies in a window below each positive's; a row goes once its bounds miss all
windows, or its upper bound is below what k rows of the window are known to have.

Anchors are grouped, too, and meet the blocks in a grid of cells, one block beside one group.
Blocks are dealt to tasks once; the groups are sent to all of them, in rounds of bounded bytes, so
neither the driver nor a task holds more anchors than a round has, whatever the size of the table.
Cells of one group that fall into the same task hand on the best rows found so far, and the task
gives them out once at its end.

Cases: rows with a null label, a null vector, or a null or non-finite component take no part; a
null vec_id is no anchor and comes last among ties; rows that share a vec_id are rows of their
own, each an anchor or a candidate; a shorter vector counts as filled up with zeros; a positive
of negative score has an empty window; fewer rows than asked for give all there are; an empty
table gives an empty result; further columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lexigaze.llm.common import LARGE_ROWS, small_batches, written

SCALE = 256
BLOCK_ROWS, GROUP_ANCHORS = 2048, 512
STRIPE_BLOCKS, STRIPES = 16, 96  # blocks of a task, but rather fewer of them than fewer tasks than STRIPES
ROUND_BYTES = 8 << 20  # of anchors sent to all tasks at a time
READ = 8  # columns read between two looks at the bounds
LAST = np.iinfo(np.int64).max  # sorts a null id behind all others
_BLOCK = "block long, n int, dims int, ids binary, nulls binary, labels binary, columns binary"
_ANCHORS = "anchor long, anchor_id long, label long, vector binary"


def usable(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """id, label (long), vector (array of double): only rows that take part."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), x.alias("vector")).where(
        F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)


def _matrix(column: pa.Array) -> np.ndarray:
    """Dimensions x rows of whole numbers, a shorter vector filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.float64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.floor(SCALE * flat)
    return np.ascontiguousarray(out.T).astype(np.int64)


def _packed(key: tuple, table: pa.Table) -> pa.Table:
    columns = _matrix(table.column("vector"))
    narrow = columns.astype(np.int32) if np.abs(columns).max(initial=0) < 1 << 31 else columns
    ids = table.column("id").combine_chunks()
    return pa.table({
        "block": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([table.num_rows], pa.int32()), "dims": pa.array([len(columns)], pa.int32()),
        "ids": [ids.fill_null(LAST).to_numpy().tobytes()], "nulls": [np.asarray(ids.is_null()).tobytes()],
        "labels": [table.column("label").to_numpy().tobytes()], "columns": [narrow.tobytes()]})


class _Block:
    """One block's arrays; the extremes of its columns are taken once."""

    def __init__(self, row: dict):
        self.number, self.n, self.dims = row["block"], row["n"], row["dims"]
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.nulls = np.frombuffer(row["nulls"], np.bool_)
        wide = len(row["columns"]) == 8 * self.n * self.dims
        self.columns = np.frombuffer(row["columns"], np.int64 if wide else np.int32).reshape(self.dims, self.n)
        self.real = self.columns.astype(np.float64)
        self.low, self.high = (self.columns.min(1).astype(np.int64), self.columns.max(1).astype(np.int64)) if self.n and self.dims else (np.zeros(self.dims, np.int64),) * 2
        self.most = np.maximum(np.abs(self.low.astype(np.float64)), np.abs(self.high.astype(np.float64)))

    def fitted(self, vector: np.ndarray) -> np.ndarray:
        """The anchor's components for the dimensions of this block."""
        return np.concatenate((vector, np.zeros(max(0, self.dims - len(vector)), np.int64)))[:self.dims]

    def scan(self, vector: np.ndarray, alive: np.ndarray, keep):
        """Rows and exact scores of the candidates that ``keep(low, high)`` never lets go.

        ``alive`` is the bitmap to begin with; ``keep`` tells which rows may still matter, from
        the bounds of their scores.
        """
        vector = self.fitted(vector)
        order = np.argsort(-np.abs(vector), kind="stable")
        a = vector[order]
        exact = np.abs(a.astype(np.float64)) @ self.most[order] < 1 << 52  # every sum is a whole number that a float holds
        columns, factors = (self.real, a.astype(np.float64)) if exact else (self.columns, a)
        one, two = a * self.low[order], a * self.high[order]
        # what the columns from each place on can still add
        least = np.concatenate((np.cumsum(np.minimum(one, two)[::-1])[::-1], [0]))
        most = np.concatenate((np.cumsum(np.maximum(one, two)[::-1])[::-1], [0]))
        rows = np.flatnonzero(alive)
        whole = True  # while most rows are left, columns are summed as they lie
        score = np.zeros(self.n, factors.dtype)
        for at in range(0, self.dims, READ):
            if not len(rows):
                break
            if whole and 2 * len(rows) < self.n:
                whole, score = False, score[rows]
            dims = order[at:at + READ]
            end = min(at + READ, self.dims)
            score += factors[at:end] @ (columns[dims] if whole else columns[dims[:, None], rows])
            now = score[rows] if whole else score
            left = keep(now + least[end], now + most[end])
            if not left.all():
                rows, score = rows[left], score if whole else score[left]
        return rows, (score[rows] if whole else score).astype(np.int64)


def anchor_rows(blocks: DataFrame, every: int) -> DataFrame:
    """(anchor, anchor_id, label, vector) of the rows whose id ``every`` divides; ``anchor`` numbers rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row)
                found = np.flatnonzero((block.ids % every == 0) & ~block.nulls)
                yield pa.RecordBatch.from_arrays([
                    pa.array(block.number << 32 | found, pa.int64()), pa.array(block.ids[found]), pa.array(block.labels[found]),
                    pa.array([block.columns[:, i].astype(np.int64).tobytes() for i in found], pa.binary())], ["anchor", "anchor_id", "label", "vector"])
    return blocks.mapInArrow(run, _ANCHORS)


def _grid(blocks: DataFrame, anchors: DataFrame, n_blocks: int) -> DataFrame:
    """Every block beside every group of a round's anchors. The groups go to all tasks, a block to one of them."""
    stripes = max(min(n_blocks, STRIPES), -(-n_blocks // STRIPE_BLOCKS))
    grouped = anchors.groupBy("group").agg(F.collect_list(F.struct(*(c for c in anchors.columns if c != "group"))).alias("anchors"))
    return blocks.repartition(stripes, "block").crossJoin(F.broadcast(grouped))


def _kth(values: np.ndarray, k: int, floor: int) -> int:
    """The k-th largest value, but not below ``floor``."""
    return floor if len(values) < k else max(floor, int(np.partition(values, len(values) - k)[len(values) - k]))


_LEAST = np.iinfo(np.int64).min
_NONE = np.zeros((4, 0), np.int64)


def _first(best: np.ndarray, block: _Block, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The k best of ``best`` and some rows of a block: score, id, whether it is null, row; highest score first, then least id."""
    if not len(rows):
        return best
    all_ = np.concatenate((best, np.stack((scores, block.ids[rows], block.nulls[rows], block.number << 32 | rows))), axis=1)
    return all_[:, np.lexsort((all_[3], all_[1], all_[2], -all_[0]))[:k]]


def _floor(best: np.ndarray, k: int, floor: int) -> int:
    """What a row must reach to be among the k best, beside what has been found."""
    return floor if best.shape[1] < k else max(floor, int(best[0, -1]))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Block, list[dict]]]:
    block = None
    for batch in batches:
        for i in range(batch.num_rows):
            if block is None or batch.column("block")[i].as_py() != block.number:
                block = _Block({name: batch.column(name)[i].as_py() for name in batch.schema.names if name != "anchors"})
            yield block, batch.column("anchors")[i].as_py()


def _given(keys: list[tuple], best: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """A row for each one found: its key, then id, score and row. A null is a key's ``None``."""
    counts = [b.shape[1] for b in best]
    all_ = np.concatenate(best, axis=1) if best else _NONE
    repeated = [pa.array([k[c] for k in keys], pa.int64()).take(pa.array(np.repeat(np.arange(len(keys)), counts))) for c in range(len(names))]
    return pa.RecordBatch.from_arrays(
        [*repeated, pa.array(all_[1], pa.int64(), mask=all_[2].astype(bool)), pa.array(all_[0], pa.int64()), pa.array(all_[3], pa.int64())], [*names, "id", "score", "row"])


GIVEN = 1 << 14  # results in a batch


def _out(found: dict, key, names: list[str]) -> Iterator[pa.RecordBatch]:
    keys, best = [], []
    for at, b in found.items():
        keys.append(key(at))
        best.append(b)
        if len(keys) == GIVEN:
            yield _given(keys, best, names)
            keys, best = [], []
    yield _given(keys, best, names)


_POSITIVE = ["anchor"]
_NEGATIVE = ["anchor", "rank", "anchor_id", "positive_id", "positive_score"]
_schema = lambda names: ", ".join(f"{n} long" for n in [*names, "id", "score", "row"])


def _positives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for block, anchors in _cells(batches):
            for anchor in anchors:
                number = anchor["anchor"]
                alive = block.labels == anchor["label"]
                if number >> 32 == block.number:
                    alive[number & 0xFFFFFFFF] = False
                seen = best.get(number, _NONE)
                floor = _floor(seen, k, _LEAST)
                rows, scores = block.scan(np.frombuffer(anchor["vector"], np.int64), alive, lambda low, high: high >= _kth(low, k, floor))
                if len(rows):
                    best[number] = _first(seen, block, rows, scores, k)
        yield from _out(best, lambda number: (number,), _POSITIVE)
    return run


def _negatives(k: int, lowest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, np.ndarray] = {}
        for block, anchors in _cells(batches):
            for anchor in anchors:
                windows = [((anchor["anchor"], p["rank"], anchor["anchor_id"], p["id"], p["score"]), -(-lowest * p["score"] // 100), p["score"])
                           for p in anchor["positives"]]
                windows = [(key, bottom, top, best.get(key, _NONE)) for key, bottom, top in windows if bottom <= top]
                if not windows:
                    continue
                floors = [_floor(seen, k, bottom) for _, bottom, _, seen in windows]
                lowest_bottom, lowest_floor = min(w[1] for w in windows), min(floors)

                def keep(low, high):
                    if low.max() < lowest_bottom:  # no row is sure to lie in a window, and none above one
                        return high >= lowest_floor
                    left = np.zeros(len(low), bool)
                    for (_, bottom, top, _), floor in zip(windows, floors):
                        within = low[(low >= bottom) & (high <= top)]  # sure to lie in the window
                        left |= (high >= _kth(within, k, floor)) & (low <= top)
                    return left

                rows, scores = block.scan(np.frombuffer(anchor["vector"], np.int64), block.labels != anchor["label"], keep)
                for key, bottom, top, seen in windows if len(rows) else ():
                    there = np.flatnonzero((scores >= bottom) & (scores <= top))
                    if len(there):
                        best[key] = _first(seen, block, rows[there], scores[there], k)
        yield from _out(best, lambda key: key, _NEGATIVE)
    return run


def _best(found: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")  # tasks pass on k rows of a key each
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, lowest: int = 80,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has id, label and vector (see ``usable``). Anchors are the rows whose id ``every``
    divides; a negative's score lies between ``lowest`` percent of the positive's and all of it.
    """
    numbered = vectors.withColumn("number", F.monotonically_increasing_id())
    n_blocks = max(1, -(-vectors.count() // block_rows))
    blocks = written(numbered.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(n_blocks))).groupBy("block").applyInArrow(_packed, _BLOCK), **LARGE_ROWS)
    anchors = written(anchor_rows(blocks, every))
    n_anchors, bytes_ = anchors.agg(F.count("anchor"), F.coalesce(F.max(F.length("vector")), F.lit(0))).first()
    groups = max(1, -(-n_anchors // GROUP_ANCHORS))  # about GROUP_ANCHORS of them in each
    at_once = max(1, ROUND_BYTES // (GROUP_ANCHORS * (bytes_ + 256)))  # groups of a round
    grouped = anchors.withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int"))
    found = []
    with small_batches(vectors.sparkSession):
        for first in range(0, groups, at_once):
            asked = grouped.where(F.col("group").between(first, first + at_once - 1))
            near = _grid(blocks, asked, n_blocks).mapInArrow(_positives(positives), _schema(_POSITIVE))
            near = written(_best(near, ["anchor"], positives, "rank").groupBy("anchor").agg(F.collect_list(F.struct("rank", "id", "score")).alias("positives")))
            far = _grid(blocks, asked.join(near, "anchor"), n_blocks).mapInArrow(_negatives(negatives, lowest), _schema(_NEGATIVE))
            far = _best(far, ["anchor", "rank"], negatives, "place")
            found.append(written(far.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                                            "positive_score", F.col("score").alias("negative_score"))))
    return reduce(DataFrame.union, found)


def relabelled(rows: DataFrame) -> DataFrame:
    """The labels of a trial in which every seventh row has moved to the next class."""
    return rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
