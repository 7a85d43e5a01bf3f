"""Near-duplicates by ProbMinHash: weighted shingles, bands, exact verification, classes.

Shingles are runs of five words (a shorter text that has words is one run), weighted by how often
they stand in the text. Each shingle sends exponential arrivals to random registers until none of
them can lower a register any more; the shingle that arrives first signs the register, so that two
texts agree on a register with the probability Jaccard similarity of their shingles. Texts of equal
shingles are folded into one before anything else, texts that agree on a band of registers are
candidates, and candidates are links once their exact similarity, computed from the whole texts,
reaches the limit.

A first pass verifies a spanning forest and the nearest texts of every bucket by sketch, and what links
it finds make classes. After that only buckets that still hold several classes are looked at: in them
every pair of different classes is compared, by sketch and then by all shingles of both texts, which
lie beside each other in the task. What leaves a task is a forest of the links found, never more rows
than texts came in, however many pairs of a crowd look near without being so.

Rows get numbers in the first written table and are known by them. Cases: a text without words (null,
empty) is a class of its own; a class is named by its least id, a null id counting only where there
is no other; rows with the same id are texts each; repeated rows are in one class; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexigaze.llm.common import ALNUM, discard, gram_hashes, marked, mix, numbered, pieces, signed, spread, temporary, word_hashes, written
from lexigaze.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 3
REGISTERS = BANDS * ROWS
GROUP = 512
FLOOR = 0.55
NEAREST = 3
CELL_SHINGLES = 1 << 21  # shingles of one side of a cell, about
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- signatures

def weighted_shingles(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of every distinct shingle, ordered by text and hash."""
    words, counts = word_hashes(column, ALNUM)
    grams, runs = gram_hashes(words, counts, shingle)
    text = np.repeat(np.arange(len(runs), dtype=np.uint64), runs)
    order = np.argsort((text << np.uint64(44)) | (grams >> np.uint64(20)))
    text, grams = text[order], grams[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at].astype(np.int64), grams[at], np.diff(np.append(at, len(grams)))


def prob_min_hash(text: np.ndarray, shingles: np.ndarray, weights: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """(n, registers) signatures; rows of texts without shingles are zero."""
    first = np.full(n * registers, np.inf)
    sign = np.zeros(n * registers, np.uint64)
    base = text * registers
    shingle, rate, time = shingles, 1.0 / weights, np.zeros(len(shingles))
    turn = 0
    while len(shingle):
        turn += 1
        u = mix(shingle + spread(turn))
        time = time - np.log1p(-(u >> np.uint64(11)).astype(np.float64) * 2.0 ** -53) * rate
        at = base + (mix(u) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        sign[at[won]] = shingle[won]
        # a shingle whose clock has passed the latest register of its text can't win any more
        latest = first.reshape(n, registers).max(1)
        left = np.flatnonzero(time < latest[base // registers])
        base, shingle, rate, time = base[left], shingle[left], rate[left], time[left]
    return sign.reshape(n, registers)


def _bands(signs: np.ndarray) -> np.ndarray:
    parts = signs.reshape(len(signs), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        out = mix(out * np.uint64(0x100000001B3) + parts[:, :, r])
    return out


def _signatures(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n = batch.num_rows
            text, grams, counts = weighted_shingles(batch.column("text"), shingle)
            signs = prob_min_hash(text, grams, counts, n)
            some = np.bincount(text, minlength=n) > 0
            content = []
            for salt in (1, 2):  # of all shingles and counts, whatever their order
                total = np.zeros(n, np.uint64)
                np.add.at(total, text, mix(grams * np.uint64(2 * salt + 1) + counts.astype(np.uint64) * _GOLDEN))
                content.append(pa.array(signed(mix(total)), mask=~some))
            bands = _bands(signs).tobytes()
            size = BANDS * 8
            sketch = (signs & np.uint64(255)).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), *content, pa.array([bands[i * size:i * size + size] for i in range(n)], pa.binary()),
                 pa.array([sketch[i * REGISTERS:(i + 1) * REGISTERS] for i in range(n)], pa.binary())],
                ["row", "doc_id", "c1", "c2", "bands", "sketch"])
    return run


# ---------------------------------------------------------------- candidates

def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
        ids = np.repeat(batch.column("rep").to_numpy(), BANDS)
        # the band after this one: members of a crowded bucket are dealt by it
        after = np.roll(keys.reshape(-1, BANDS), -1, 1).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(after), pa.array(ids)], ["key", "after", "rep"])


def forest(sketches: np.ndarray, floor: float = FLOOR, nearest: int = NEAREST) -> list[tuple[int, int]]:
    """Pairs worth verifying among a few hundred texts: a maximum spanning forest and each one's nearest others."""
    n = len(sketches)
    if n == 2:
        return [(0, 1)] if (sketches[0] == sketches[1]).mean() >= floor else []
    same = np.zeros((n, n), np.uint8)
    for r in range(sketches.shape[1]):
        same += sketches[:, r][:, None] == sketches[:, r][None, :]
    i, j = np.nonzero(np.triu(same >= floor * sketches.shape[1], 1))
    order = np.argsort(-same[i, j].astype(np.int16), kind="stable")
    parent, taken, out = list(range(n)), [0] * n, []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i[order].tolist(), j[order].tolist()):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
        elif taken[a] >= nearest and taken[b] >= nearest:
            continue
        taken[a] += 1
        taken[b] += 1
        out.append((a, b))
    return out


def hub(sketches: np.ndarray) -> tuple[int, int]:
    """The text closest to the most common value of every register, and in how many registers it has that."""
    common = np.array([np.bincount(sketches[:, r]).argmax() for r in range(sketches.shape[1])])
    same = (sketches == common).sum(1)
    return int(same.argmax()), int(same.max())


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of every group; of a crowded bucket's groups also the hub, as (a, null) with its bucket and score.

    Rows come sorted by group and a group may go on in the next batch; blocks of ``GROUP`` bound what is held.
    """
    held, ids, sketches = None, [], []

    def flush(out: list[tuple]) -> None:
        if len(ids) > 1:
            some = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, REGISTERS)
            out.extend((min(ids[a], ids[b]), max(ids[a], ids[b]), None, None) for a, b in forest(some))
        if ids and held[3]:
            at, score = hub(np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, REGISTERS))
            out.append((ids[at], None, held[0], score))

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32()))], ["a", "b", "key", "score"])

    for batch in batches:
        out: list[tuple] = []
        for key, rep, sketch in zip(zip(*(batch.column(c).to_pylist() for c in ("key", "part", "salt", "crowded"))),
                                    batch.column("rep").to_pylist(), batch.column("sketch").to_pylist()):
            if key != held or len(ids) >= 2 * GROUP:
                flush(out)
                held, ids, sketches = key, [], []
            ids.append(rep)
            sketches.append(sketch)
        yield rows(out)
    out = []
    flush(out)
    yield rows(out)


def bucket_members(unique: DataFrame) -> DataFrame:
    """(key, after, rep, n, least): every text in its bucket of each band, buckets of one text left out."""
    keys = written(unique.select("rep", "bands").mapInArrow(_exploded, "key long, after long, rep long"))
    sizes = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("least")).where("n > 1"))
    members = written(keys.join(sizes, "key"))
    discard(keys)
    return members


def candidate_pairs(unique: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct (a, b) worth verifying first, from texts (rep, bands, sketch) of different shingles and their buckets.

    A bucket of more than ``GROUP`` texts is dealt by the next
    band as well, what is still larger is salted, and each of its texts is paired with the bucket's least
    text and with its hub, the text that has most of the bucket's common registers. Pairs grow with the
    texts, never with the square of a bucket.
    """
    crowded = written(members.where(F.col("n") > GROUP).select("key", F.col("after").alias("part"), "rep", "least"))
    parts = crowded.groupBy("key", "part").agg(F.count(F.lit(1)).alias("m"))
    salted = crowded.join(parts, ["key", "part"]).select(
        "key", "part", F.pmod(F.xxhash64("rep"), F.ceil(F.col("m") / GROUP)).alias("salt"), F.lit(True).alias("crowded"), "rep")
    zero = F.lit(0).cast("long")
    groups = members.where(F.col("n") <= GROUP).select("key", zero.alias("part"), zero.alias("salt"), F.lit(False).alias("crowded"), "rep").unionByName(salted)
    found = written(groups.join(unique.select("rep", "sketch"), "rep").repartition("key", "part", "salt").sortWithinPartitions(
        "key", "part", "salt", "rep").mapInArrow(_pairs, "a long, b long, key long, score int"))
    hubs = found.where("b IS NULL").groupBy("key").agg(F.max(F.struct("score", "a")).alias("best")).select("key", F.col("best.a").alias("hub"))
    near = found.where("b IS NOT NULL").select("a", "b")
    for table, center in ((crowded, "least"), (crowded.join(hubs, "key"), "hub")):
        near = near.unionByName(table.select(F.least("rep", center).alias("a"), F.greatest("rep", center).alias("b")))
    return near.where("a <> b").distinct()


# -------------------------------------------------------------- verification

def probability_jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two aligned vectors of weights, zero where a shingle is missing."""
    common = (x > 0) & (y > 0)
    if not common.any():
        return 0.0
    with np.errstate(divide="ignore"):
        ratio = np.where(x > 0, y / np.where(x > 0, x, 1), np.inf)
    total = 0.0
    for r in np.unique(ratio[common]):
        below = x[ratio <= r].sum() + y[ratio > r].sum() / r
        total += x[common & (ratio == r)].sum() / below
    return float(total)


def _verified(shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(pieces(batches, "text_a"), "text_b"):
            sides = [weighted_shingles(batch.column(c), shingle) for c in ("text_a", "text_b")]
            cuts = [np.searchsorted(t, np.arange(batch.num_rows + 1)) for t, _, _ in sides]
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                (ga, wa), (gb, wb) = [(g[c[i]:c[i + 1]], w[c[i]:c[i + 1]]) for (_, g, w), c in zip(sides, cuts)]
                if min(len(ga), len(gb)) == 0:
                    continue
                every, place = np.unique(np.concatenate((ga, gb)), return_inverse=True)
                x, y = np.zeros(len(every)), np.zeros(len(every))
                x[place[:len(ga)]] = wa
                y[place[len(ga):]] = wb
                keep[i] = probability_jaccard(x, y) >= similarity - 1e-12
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["u", "v"])
    return run


def links(docs: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of row numbers whose whole texts are similar enough; ``docs`` has row and text."""
    pairs = written(pairs)
    either = pairs.select(F.explode(F.array("a", "b")).alias("row"))
    text = written(marked(docs, "row", either, "row").select("row", "text"))
    both = pairs.join(text.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a").join(
        text.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verified(shingle, similarity), "u long, v long")


# ------------------------------------------------------------ crowded buckets

def _vectors(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n = batch.num_rows
            text, grams, counts = weighted_shingles(batch.column("text"), shingle)
            cuts = np.searchsorted(text, np.arange(n + 1))
            # weighted_shingles orders by the upper bits only
            order = np.lexsort((grams, text))
            grams, counts = grams[order], counts[order].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(np.diff(cuts), pa.int64()), pa.array([grams[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                 pa.array([b"" if (counts[a:b] == 1).all() else counts[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
                ["rep", "m", "grams", "weights"])
    return run


def _similar(a: tuple[np.ndarray, np.ndarray | None], b: tuple[np.ndarray, np.ndarray | None], similarity: float) -> bool:
    """Whether two texts, given by sorted shingles and their counts (None: all 1), are similar enough."""
    (ga, wa), (gb, wb) = a, b
    at = np.searchsorted(ga, gb)
    common = ga[np.minimum(at, len(ga) - 1)] == gb
    if wa is None and wb is None:  # the similarity of sets
        n = int(common.sum())
        return n >= (similarity - 1e-12) * (len(ga) + len(gb) - n)
    x, y = np.ones(len(ga)) if wa is None else wa.astype(float), np.ones(len(gb)) if wb is None else wb.astype(float)
    of_a = np.zeros(len(ga))
    of_a[at[common]] = y[common]
    return probability_jaccard(np.concatenate((x, np.zeros(int((~common).sum())))), np.concatenate((of_a, y[~common]))) >= similarity - 1e-12


def _crossing(similarity: float):
    """Links between texts of different classes of a cell, as a forest; rows of a cell stand together.

    A text beside its bucket's largest class stands on both sides; two such texts are a pair once. A pair
    that shares an earlier band is looked at there.
    """
    low = int(np.ceil(FLOOR * REGISTERS))
    names = ("rest", "free", "rep", "root", "sketch", "bands", "grams", "weights")

    def found(key: int, rows: list[tuple]) -> pa.RecordBatch:
        rest, free = (np.array([r[k] for r in rows], bool) for k in (0, 1))
        rep, root = (np.array([r[k] for r in rows], np.int64) for k in (2, 3))
        sketches = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(-1, REGISTERS)
        bands = np.frombuffer(b"".join(r[5] for r in rows), np.int64).reshape(-1, BANDS)
        band = int(np.flatnonzero(bands[0] == key)[0])
        x, y = np.flatnonzero(~rest), np.flatnonzero(rest)
        same = np.zeros((len(x), len(y)), np.uint8)
        for r in range(REGISTERS):
            same += sketches[x, r][:, None] == sketches[y, r][None, :]
        fit = (same >= low) & (root[x][:, None] != root[y][None, :]) & (~free[x][:, None] | (rep[x][:, None] < rep[y][None, :]))
        for b in range(band):
            fit &= bands[x, b][:, None] != bands[y, b][None, :]
        i, j = np.nonzero(fit)
        order = np.argsort(-same[i, j].astype(np.int16), kind="stable")
        parent: dict[int, int] = {}

        def top(c: int) -> int:
            while c in parent:
                if parent[c] in parent:
                    parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        whole: dict[int, tuple[np.ndarray, np.ndarray | None]] = {}

        def vector(at: int) -> tuple[np.ndarray, np.ndarray | None]:
            if at not in whole:
                whole[at] = np.frombuffer(rows[at][6], np.uint64), np.frombuffer(rows[at][7], np.int32) if rows[at][7] else None
            return whole[at]

        out = []
        for a, b in zip(x[i[order]].tolist(), y[j[order]].tolist()):
            one, two = top(int(root[a])), top(int(root[b]))
            if one != two and _similar(vector(a), vector(b), similarity):
                parent[max(one, two)] = min(one, two)
                out.append((min(rep[a], rep[b]), max(rep[a], rep[b])))
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        for batch in batches:
            for key, row in zip(zip(*(batch.column(c).to_pylist() for c in ("key", "block", "other"))), zip(*(batch.column(c).to_pylist() for c in names))):
                if key != held:
                    if rows:
                        yield found(held[0], rows)
                    held, rows = key, []
                rows.append(row)
        if rows:
            yield found(held[0], rows)
    return run


def crossing_links(docs: DataFrame, unique: DataFrame, members: DataFrame, roots: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (u, v) that join the classes of a bucket: every pair of different classes above the floor is looked at.

    Every such pair has a text beside the bucket's largest class, so these texts, in blocks of about ``GROUP``
    texts or ``CELL_SHINGLES`` shingles, meet the whole bucket, in such blocks too, each block with each in a
    cell of its own.
    """
    placed = written(members.join(roots, members["rep"] == roots["u"], "left").select("key", "rep", F.coalesce("root", "rep").alias("root")))
    counts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    open_ = counts.groupBy("key").agg(F.sum("m").alias("n"), F.max(F.struct("m", "root")).alias("top")).where("n > top.m").select(
        "key", F.col("top.root").alias("top"))
    cells = written(placed.join(open_, "key").withColumn("free", F.expr("root <> top")))
    vectors = written(marked(docs, "row", cells, "rep").select("row", "text").mapInArrow(_vectors(shingle), "rep long, m long, grams binary, weights binary"))
    sized = cells.join(vectors.select("rep", "m"), "rep")
    sizes = sized.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("m").alias("m"), F.count_if("free").alias("fn"), F.sum(F.when(F.col("free"), F.col("m"))).alias("fm")).select(
        "key", *[F.greatest(F.ceil(F.col(n) / GROUP), F.ceil(F.col(m) / CELL_SHINGLES)).alias(name) for n, m, name in (("n", "m", "blocks"), ("fn", "fm", "others"))])
    dealt = written(cells.drop("top").join(sizes, "key"))
    block, other = (F.pmod(F.xxhash64("rep"), F.col(c)) for c in ("blocks", "others"))
    every = dealt.select("key", block.alias("block"), F.explode(F.expr("sequence(0L, others - 1)")).alias("other"), F.lit(False).alias("rest"), "free", "rep", "root")
    rest = dealt.where("free").select("key", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), other.alias("other"), F.lit(True).alias("rest"), "free", "rep", "root")
    full = every.unionByName(rest).join(vectors.join(unique.select("rep", "sketch", "bands"), "rep"), "rep")
    return full.repartition("key", "block", "other").sortWithinPartitions("key", "block", "other").mapInArrow(_crossing(similarity), "u long, v long")


def classes_of(docs: DataFrame, unique: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(u, root) of all texts that are linked to a lesser one, both as row numbers."""
    members = bucket_members(unique)
    roots = components(links(docs, candidate_pairs(unique, members), shingle, similarity))
    # a bucket of so few texts has no pair above the floor that wasn't verified
    members = members.where(F.col("n") > NEAREST + 1).select("key", "rep")
    more = written(crossing_links(docs, unique, members, roots, shingle, similarity))
    if more.isEmpty():
        return roots
    return components(more.unionByName(roots.select("u", F.col("root").alias("v"))))


def near_classes(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), one row per row of ``docs``; a written table."""
    with temporary(docs.sparkSession) as keep:
        rows = numbered(docs)
        signs = written(rows.mapInArrow(_signatures(shingle), "row long, doc_id long, c1 long, c2 long, bands binary, sketch binary"))
        unique = written(signs.where("c1 IS NOT NULL").groupBy("c1", "c2").agg(
            F.min("row").alias("rep"), F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
        roots = classes_of(rows, unique, shingle, similarity)
        placed = written(unique.select("c1", "c2", "rep", "least").join(roots, F.col("rep") == F.col("u"), "left").select(
            "c1", "c2", "least", F.coalesce("root", "rep").alias("root")))
        named = placed.drop("least").join(placed.groupBy("root").agg(F.min("least").alias("class_id")), "root").drop("root")
        return keep(signs.select("doc_id", "c1", "c2").join(named, ["c1", "c2"], "left").select(
            "doc_id", F.when(F.col("c1").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")))
