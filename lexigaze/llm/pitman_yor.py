"""Language-model scoring with a hierarchical Pitman-Yor model whose seating is sampled by Gibbs sweeps.

Words are dishes. Every word that something follows is a context with a restaurant of its own; the
tables of all these restaurants are customers of one parent restaurant, whose base is even over the known
words and one unknown. A sweep seats the customers of every dish anew (each opens a table or joins one, by
the Chinese-restaurant rule) given the tables of all the others as of the sweep before; predictive
probabilities are averaged over the sweeps after the first. Pairs of word and context are dealt by word into
parts, whose rows hold packed arrays. What holds for a frequent context, a bounded number, is sent to the
tasks; what holds for any other is joined by context. A pair seen once has one table in every sweep, so only
the others are seated. To be scored, tokens are dealt by word, too, and meet the pairs of their part.

Cases: a null or empty text is its end token; a null id is never learned from and not held out;
repeated rows are counted and scored each; without documents to learn from every token is unknown
(one even class); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexigaze.llm.common import SPACED, bucket, discard, mix, pieces, signed, small_batches, spread, texts, word_hashes, written

END = np.uint64(0x656E64)  # the end token; words have well mixed hashes
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
FOLDS = 10
ADDED = 0.1
CHUNK = 700_000  # tokens that a task packs at once
PARTS, PART_TOKENS = 24, 8_000_000  # at least so many parts, and one for so many tokens
JOINED, RANGE = 1_000_000, 300_000  # counts of a part that wait to be joined, and those joined at once


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and its end token, and the number of tokens of each text."""
    words, counts = word_hashes(column, SPACED)
    sizes = counts + 1
    out = np.empty(len(words) + len(counts), np.uint64)
    ends = np.cumsum(sizes) - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = words, END
    return out, sizes


def words_before(w: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """The number of the word before each token, that of the end token before a first word."""
    before = np.empty_like(w)
    before[1:] = w[:-1]
    before[np.concatenate(([0], np.cumsum(sizes)[:-1]))[:len(sizes)]] = end
    return before


def contexts_of(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Number of the frequent context that a word is, -1 for a rare one."""
    at = np.minimum(np.searchsorted(contexts, words), max(len(contexts) - 1, 0))
    return np.where(contexts[at] == words, at, -1) if len(contexts) else np.full(len(words), -1)


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


# -------------------------------------------------------------------- counts

def frequent_words(docs: DataFrame, share: float, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Up to ``most`` frequent words, and words that make up ``share`` of all tokens (counted in the tasks where they
    make up a quarter of that) in ascending order; which of them make up ``share``; how many tokens there are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        every, times = have, n
        later: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in pieces(batches):
            stream, _ = tokens(batch.column("text"))
            total += len(stream)
            words, counts = np.unique(stream, return_counts=True)
            some = counts * 8 >= share * len(stream)
            have, n = _counted(np.concatenate((have, words[some])), np.concatenate((n, counts[some])))
            later.append((words, counts))
            if sum(len(x) for x, _ in later) > CHUNK:
                every, times = _counted(*(np.concatenate(x) for x in zip((every, times), *later)))
                later = []
                if len(every) > 8 * most:  # the list is a choice of speed alone
                    every, times = every[times > 1], times[times > 1]
        every, times = _counted(*(np.concatenate(x) for x in zip((every, times), *later)))
        some = n * 4 >= share * total
        more = times > 1
        zeros = lambda k: pa.array(np.zeros(k, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(signed(have[some])), pa.array(n[some]), zeros(some.sum()), zeros(some.sum())], ["word", "n", "times", "all"])
        yield pa.RecordBatch.from_arrays([pa.array(signed(every[more])), zeros(more.sum()), pa.array(times[more]), zeros(more.sum())], ["word", "n", "times", "all"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), zeros(1), zeros(1), pa.array([total], pa.int64())], ["word", "n", "times", "all"])

    rows = written(docs.select("text").mapInArrow(run, "word long, n long, times long, all long").groupBy("word").agg(
        F.sum("n").alias("n"), F.sum("times").alias("times"), F.sum("all").alias("all")))
    total = rows.agg(F.sum("all")).first()[0] or 0
    rows = rows.where("word IS NOT NULL")
    large = np.array([r.word for r in rows.where((F.col("n") > 0) & (F.col("n") >= share * total)).collect()], np.int64).view(np.uint64)
    large = np.unique(np.append(large, END))
    found = rows.orderBy(F.desc("times"), "word").limit(most).select("word").toArrow().column(0).to_numpy().view(np.uint64)
    discard(rows)
    found = np.union1d(found, large)
    return found, np.isin(found, large), total


def _pair(words: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mix(words + mix(before + np.uint64(2)) * _GOLDEN)


# --------------------------------------------------------------------- parts

#: Rows of a part: packed arrays of one ``kind``; ``place`` is the row number of a chunk's first text.
_ROWS = "part int, kind int, place long, data array<binary>"
_PAIRS, _SEATS, _TOKENS, _TEXTS, _SUMS, _RARE = range(6)


def packed(values: np.ndarray) -> bytes:
    """An array by planes of bytes, compressed."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return values.dtype.char.encode() + len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    kind, n = np.dtype(chr(data[0])), int.from_bytes(data[1:9], "little")
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[9:], n * kind.itemsize, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).reshape(n)


def _small(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int32 if not len(values) or values.max() < 1 << 31 else np.int64)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """(part, kind, place, arrays) as rows."""
    part, kind, place, data = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(place, pa.int64()), pa.array([[packed(x) for x in d] for d in data], pa.list_(pa.binary()))],
        ["part", "kind", "place", "data"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, list[np.ndarray]]]:
    for batch in batches:
        data = batch.column("data")
        for at, (part, kind, place) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "place")))):
            yield part, kind, place, [unpacked(x) for x in data[at].as_py()]


def _written(rows: DataFrame) -> DataFrame:
    with small_batches(rows.sparkSession):
        return written(rows)


def _firsts(sizes: np.ndarray) -> np.ndarray:
    return (np.cumsum(sizes) - sizes)[sizes > 0]


def _steps(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ascending numbers of each group as steps from one to the next, the first as it is."""
    out = np.diff(values, prepend=0)
    first = _firsts(sizes)
    out[first] = values[first]
    return out.astype(np.int32)


def _walked(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total, first = np.cumsum(steps, dtype=np.int64), _firsts(sizes)
    return total - np.repeat(total[first] - steps[first], sizes[sizes > 0])


def _owners(sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(sizes)), sizes)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0))))


def _summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else values[:0]


def _dealt(docs: DataFrame, contexts, parts: int, count: bool) -> DataFrame:
    """Tokens by parts of the words: how often each pair stands there, or else the text of each token.

    Arrays of a row: words; how many entries each has after frequent contexts, these contexts' numbers, counts or
    texts; how many after others, those contexts, counts or texts.
    """
    def chunk(held: list[tuple]) -> list[tuple]:
        stream, sizes, rows, ids, nulls = (np.concatenate(x) for x in zip(*held))
        held.clear()
        places = len(contexts.value)
        words, w = np.unique(stream, return_inverse=True)
        before = words_before(w, sizes, int(np.searchsorted(words, END)))
        at = contexts_of(words, contexts.value)[before]
        inner = at >= 0
        if count:
            key = np.sort(w[inner] * places + at[inner])
            first = _runs(key)
            own, context, value = key[first] // places, key[first] % places, np.diff(first, append=len(key))
            key = np.sort(w[~inner] * len(words) + before[~inner])
            first = _runs(key)
            other, ahead, value_2 = key[first] // len(words), words[key[first] % len(words)], np.diff(first, append=len(key))
        else:
            text = _owners(sizes)
            key, value = np.divmod(np.sort((w[inner] * places + at[inner]) * len(sizes) + text[inner]), len(sizes))
            own, context = np.divmod(key, places)
            some = np.flatnonzero(~inner)
            some = some[np.argsort(w[some], kind="stable")]
            other, ahead, value_2 = w[some], words[before[some]], text[some]
        n, n_2 = np.bincount(own, minlength=len(words)), np.bincount(other, minlength=len(words))
        edges = np.searchsorted((words >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
        cut, cut_2 = (np.concatenate(([0], np.cumsum(x)))[edges] for x in (n, n_2))
        place = int(rows[0]) if len(rows) else 0
        out = [(p, _TOKENS, place, (words[a:b], _small(n[a:b]), _steps(context[cut[p]:cut[p + 1]], n[a:b]), _small(value[cut[p]:cut[p + 1]]),
                                    _small(n_2[a:b]), ahead[cut_2[p]:cut_2[p + 1]], _small(value_2[cut_2[p]:cut_2[p + 1]])))
               for p, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if a < b]
        return out if count else out + [(place % parts, _TEXTS, place, (ids, nulls, _small(sizes)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in pieces(batches):
            stream, sizes = tokens(batch.column("text"))
            none = np.zeros(0, np.int64)
            ids = batch.column("doc_id") if not count else None
            held.append((stream, sizes, none if count else batch.column("row").to_numpy(),
                         none if count else ids.fill_null(0).to_numpy(), none.astype(bool) if count else ids.is_null().to_numpy(zero_copy_only=False)))
            size += len(stream)
            if size > CHUNK:
                yield _rows(chunk(held))
                size = 0
        if held:
            yield _rows(chunk(held))

    # the texts of a chunk stand together, so its first row number gives those of all
    rows = docs.select("text") if count else docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(run, _ROWS)


def _by_part(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(3 * parts, "part").sortWithinPartitions("part", "kind")  # so that few parts meet in a task


def _entries(chunk: tuple) -> int:
    return len(chunk[2]) + len(chunk[5])


def _joined(held: list[tuple]) -> tuple:
    """The counts of several chunks of a part as one, joined over a range of words at a time. ``held`` is emptied."""
    words, weights = np.concatenate([x[0] for x in held]), np.concatenate([x[1].astype(np.int64) + x[4] for x in held])
    order = np.argsort(words)
    words, weights = words[order], np.cumsum(weights[order])
    ranges = max(sum(map(_entries, held)) // RANGE, 1)
    cuts = np.unique(words[np.searchsorted(weights, weights[-1] * np.arange(1, ranges) // ranges)])
    del words, weights, order

    def range_of(chunk: tuple, low: int, high: int) -> tuple:
        words, sizes, context, n, sizes_2, before, n_2 = chunk
        a, b = (0 if low < 0 else int(np.searchsorted(words, cuts[low])), len(words) if high == len(cuts) else int(np.searchsorted(words, cuts[high])))
        (i, j), (i_2, j_2) = ((int(x[:a].sum()), int(x[:b].sum())) for x in (sizes, sizes_2))
        return words[a:b], sizes[a:b], context[i:j], n[i:j], sizes_2[a:b], before[i_2:j_2], n_2[i_2:j_2]

    def joined(at: int) -> tuple:
        words, sizes, context, n, sizes_2, before, n_2 = (np.concatenate(x) for x in zip(*(range_of(x, at - 1, at) for x in held)))
        words, w = np.unique(words, return_inverse=True)
        out = [words]
        for ahead, times, size in ((context, n, sizes), (before, n_2, sizes_2)):
            own = np.repeat(w, size)
            order = np.lexsort((ahead, own)) if ahead is before else np.argsort(own * (int(ahead.max(initial=0)) + 1) + ahead)
            own, ahead = own[order], ahead[order]
            first = _runs(own, ahead)
            out += [_small(np.bincount(own[first], minlength=len(words))), ahead[first], _small(_summed(times[order].astype(np.int64), first))]
        return tuple(out)

    out = [joined(at) for at in range(len(cuts) + 1)]
    held.clear()
    return tuple(np.concatenate(x) for x in zip(*out))


def pair_counts(docs: DataFrame, contexts, parts: int) -> DataFrame:
    """The pairs of each part, the seats before the first sweep, and what frequent contexts, other contexts and all words add up to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = len(contexts.value)

        def merged(part: int, held: list) -> pa.RecordBatch:
            words, sizes, context, n, sizes_2, before, n_2 = _joined(held)
            own, other = _owners(sizes), _owners(sizes_2)
            k = len(words)
            sums = lambda x, y=None: np.bincount(x, y, k).astype(np.int64)
            count = sums(own, n) + sums(other, n_2)
            # pairs seen once are only counted, the others are seated; a word seen once has one guest and one table
            more, more_2, often = n > 1, n_2 > 1, count > 1
            alone, sizes, sizes_2 = (x[often] for x in (sums(own[~more]) + sums(other[~more_2]), sums(own[more]), sums(other[more_2])))
            nils = lambda x: np.zeros(x.sum(), np.int32)
            rare = np.argsort(before)
            start = _runs(before[rare])
            return _rows([
                (part, _PAIRS, 0, (words, _small(count), _small(sums(own)), _steps(context, sums(own)), _small(n), _small(sums(other)), before, _small(n_2))),
                (part, _SEATS, 0, (words[often], _small(alone), _small(sizes), _steps(context[more], sizes), _small(n[more]),
                                   _small(sizes_2), before[more_2], _small(n_2[more_2]), nils(more) + 1, nils(more), nils(more_2) + 1, nils(more_2), nils(often) + 1)),
                (part, _SUMS, 0, (_small(np.bincount(context, n, places)), _small(np.bincount(context, minlength=places)), np.array(
                    [k, count.sum(), (count == 1).sum(), (count == 2).sum(), (n == 1).sum() + (n_2 == 1).sum(), (n == 2).sum() + (n_2 == 2).sum(), len(n) + len(n_2)]))),
                (part, _RARE, 0, (before[rare][start], _summed(n_2[rare].astype(np.int64), start), np.diff(start, append=len(rare))))])

        held, size, most, last = [], 0, JOINED, None
        for part, _, _, (words, sizes, steps, *rest) in _read(batches):
            if held and part != last:
                yield merged(last, held)
                held, size, most = [], 0, JOINED
            last = part
            held.append((words, sizes, _walked(steps, sizes).astype(np.int32), *rest))
            size += _entries(held[-1])
            if size > most:  # at least as many came as stay
                held = [_joined(held)]
                size = _entries(held[0])
                most = 2 * size + JOINED
        if held:
            yield merged(last, held)

    return _written(_by_part(_dealt(docs, contexts, parts, True), parts).mapInArrow(run, _ROWS))


def _unrolled(rows: DataFrame, kind: int, schema: str) -> DataFrame:
    """A row for each place of the arrays of one kind."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _, arrays in _read(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(arrays[0]), part, np.int32))] + [pa.array(signed(x) if x.dtype == np.uint64 else x.astype(np.int64)) for x in arrays[:len(names)]],
                                             ["part", *names])
    return rows.where(F.col("kind") == kind).mapInArrow(run, f"part int, {schema}")


def _sums(rows: DataFrame, places: tuple[int, ...]) -> list[np.ndarray]:
    """Sums over all parts: numbers for each frequent context, and a few for all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for *_, arrays in _read(batches):
            total = [x.astype(np.int64) + (0 if total is None else y) for x, y in zip(arrays, total or arrays)]
        if total:
            yield _rows([(0, _SUMS, 0, total)])

    found = rows.where(F.col("kind") == _SUMS).mapInArrow(run, _ROWS).select("data")
    out = [np.zeros(n) for n in places]
    with small_batches(rows.sparkSession):
        for row in found.toLocalIterator():
            out = [x + unpacked(y) for x, y in zip(out, row.data)]
    return out


# ------------------------------------------------------------------- seating

@dataclass
class State:
    """What all restaurants share as of one sweep."""

    words: int  # known words
    discount: tuple[float, float]  # parent, contexts
    strength: tuple[float, float]
    contexts: np.ndarray  # the frequent ones
    numbers: np.ndarray  # of those whose draws go by number, -1 for the others
    customers: np.ndarray  # of each context
    tables: np.ndarray  # of each context
    parent_customers: float = 0.0
    parent_tables: float = 0.0

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probability of a word in the parent restaurant, given its own customers and tables there."""
        rest = self.strength[0] + self.parent_customers
        return (customers - self.discount[0] * tables + (self.strength[0] + self.discount[0] * self.parent_tables) / (self.words + 1)) / rest

    def back_off(self) -> np.ndarray:
        """Weight of the parent in each context."""
        return (self.strength[1] + self.discount[1] * self.tables) / (self.strength[1] + self.customers)


def uniform(keys: np.ndarray, turn: int) -> np.ndarray:
    return (mix(keys + spread(turn + 1)) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def seat(customers: np.ndarray, new: np.ndarray, discount: float, base: np.ndarray, keys: np.ndarray, turn: int) -> np.ndarray:
    """Tables that ``customers`` of one dish open when seated one after another.

    ``new``: weight of a new table before the first one; each table adds ``discount * base`` to it. Beyond 64
    customers they come in groups of a tenth of those seated, whose new tables are drawn together.
    """
    tables = np.ones(len(customers), np.float64)
    seated = np.ones(len(customers), np.float64)
    at = np.flatnonzero(customers > 1)
    step = turn * 1000
    while len(at):
        step += 1
        n, t = seated[at], tables[at]
        group = np.minimum(np.where(n < 64, 1.0, np.floor(n / 10)), customers[at] - n)
        fresh = new[at] + discount * base[at] * t
        p = fresh / (fresh + n - discount * t)
        u = uniform(keys[at], step)
        spread = np.sqrt(group * p * (1 - p))
        z = np.sqrt(-2 * np.log(1 - u)) * np.cos(2 * np.pi * uniform(keys[at], step + 500_000))
        tables[at] += np.where(group == 1, u < p, np.clip(np.rint(group * p + spread * z), 0, group))
        seated[at] += group
        at = at[seated[at] < customers[at]]
    return tables


def _sliced(run, n: int) -> np.ndarray:
    """Whole numbers that ``run`` makes for ``n`` places, made for some of them at a time."""
    return np.concatenate([_small(run(slice(a, min(a + RANGE, n)))) for a in range(0, max(n, 1), RANGE)])


def _sweep(shared, turn: int, predict: bool):
    """One pass over the seats: keep the present seating as a sample, then seat anew.

    Arrays of a row: words seen more than once, their pairs seen once, their pairs (frequent contexts, counts; others, counts), tables of
    each pair and their sum over the samples, tables at the parent, and of each sample the guests and tables there.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: State = shared.value
        for batch in batches:
            for at, (part, _, _, arrays) in enumerate(_read([batch.select(["part", "kind", "place", "data"])])):
                words, alone, sizes, steps, n, sizes_2, before, n_2, tables, total, tables_2, total_2, own, *past = arrays
                context = _walked(steps, sizes)
                w, w_2 = _owners(sizes), _owners(sizes_2)
                guests = alone + np.bincount(w, tables, len(words)) + np.bincount(w_2, tables_2, len(words))
                parent = state.parent(guests, own.astype(np.float64))
                if predict:
                    total, total_2 = total + tables, total_2 + tables_2
                    past += [_small(guests), own]
                discount, strength = state.discount[1], state.strength[1]

                def frequent(at: slice) -> np.ndarray:
                    number, word, base = state.numbers[context[at]], words[w[at]], parent[w[at]]
                    keys = np.where(number >= 0, mix(word + (number + 2).astype(np.uint64) * _GOLDEN), _pair(word, state.contexts[context[at]]))
                    others = np.maximum(state.tables[context[at]] - held[at], 0)
                    return seat(n[at].astype(np.float64), (strength + discount * others) * base, discount, base, keys, turn)

                held = tables
                tables = _sliced(frequent, len(n))
                if len(before):
                    known, there = batch.column("befores")[at].values.to_numpy().view(np.uint64), batch.column("theres")[at].values.to_numpy()
                    order = np.argsort(known)
                    known, there = known[order], there[order]

                    def other(at: slice) -> np.ndarray:
                        others = np.maximum(there[np.searchsorted(known, before[at])] - held_2[at], 0)
                        base = parent[w_2[at]]
                        return seat(n_2[at].astype(np.float64), (strength + discount * others) * base, discount, base, _pair(words[w_2[at]], before[at]), turn)

                    held_2 = tables_2
                    tables_2 = _sliced(other, len(n_2))
                guests = alone + np.bincount(w, tables, len(words)) + np.bincount(w_2, tables_2, len(words))
                even = np.full(len(words), 1.0 / (state.words + 1))
                others = np.maximum(state.parent_tables - own, 0)
                own = _small(seat(guests, (state.strength[0] + state.discount[0] * others) * even, state.discount[0], even, mix(words), turn))
                order = np.argsort(before)
                first = _runs(before[order])
                yield _rows([
                    (part, _SEATS, 0, (words, alone, sizes, steps, n, sizes_2, before, n_2, _small(tables), total, _small(tables_2), total_2, own, *past)),
                    (part, _SUMS, 0, (_small(np.bincount(context, tables - 1, len(state.contexts))), np.array([guests.sum(), own.sum()]).astype(np.int64))),
                    (part, _RARE, 0, (before[order][first], _small(_summed(tables_2[order] - 1, first))))])
    return run


# --------------------------------------------------------------------- model

@dataclass
class Model:
    """Sampled seating by parts (two written tables), its sizes and, for every sample, what holds for unseen words."""

    state: State
    counted: DataFrame
    seated: DataFrame
    parts: int
    train_tokens: int
    words: int
    samples: int
    back_offs: np.ndarray  # samples x (contexts and, last, none)
    unknown: np.ndarray  # samples
    levels: list[State]  # of each sample; only sizes of the parent are read
    places: DataFrame  # before, customers, backs (a back-off weight for every sample): the contexts that are no numbers

    @property
    def contexts(self) -> np.ndarray:
        return self.state.contexts

    def rows(self) -> DataFrame:
        return self.counted.where(F.col("kind") == _PAIRS).unionByName(self.seated.where(F.col("kind") == _SEATS))

    @property
    def seats(self) -> DataFrame:
        """word, count, contexts, sums (of the samples' predictions after each of them), parents."""
        return self._unrolled(_Part.seats, "word long, count long, contexts array<long>, sums array<double>, parents array<double>")

    @property
    def pairs(self) -> DataFrame:
        """word, before, count, p: all pairs of the contexts that are no numbers."""
        rows = self._unrolled(_Part.rare_pairs, "word long, before long, count long, own double, parents array<double>")
        return rows.join(self.places, "before").select("word", "before", "count", _after_rare(F.col("own"), "parents", self).alias("p"))

    def _unrolled(self, what, schema: str) -> DataFrame:
        shared = self.counted.sparkSession.sparkContext.broadcast(self.known())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, pairs = shared.value, None
            for _, kind, _, arrays in _read(batches):
                if kind == _SEATS:
                    yield what(_Part(known, pairs, arrays))
                pairs = arrays
        return _by_part(self.rows(), self.parts).mapInArrow(run, schema)

    def known(self) -> Known:
        return Known(self.state, self.levels, self.back_offs, self.unknown, self.train_tokens, self.words, self.samples)


@dataclass
class Known:
    """What every task of the scoring reads."""

    state: State
    levels: list[State]
    back_offs: np.ndarray
    unknown: np.ndarray
    train_tokens: int
    words: int
    samples: int


class _Part:
    """The learned words and pairs of a part."""

    def __init__(self, known: Known, pairs: list[np.ndarray] | None, seats: list[np.ndarray] | None):
        self.known, places, samples = known, len(known.state.contexts), known.samples
        if pairs is None:
            none = np.zeros(0, np.int64)
            pairs, seats = [none.view(np.uint64), none, none, none, none, none, none.view(np.uint64), none], [none] * (13 + 2 * (samples - 1))
        self.words, self.count, self.sizes, steps, n, self.sizes_2, self.before, n_2 = pairs
        words, alone, sizes, _, _, sizes_2, _, _, tables, total, tables_2, total_2, own, *past = seats
        past += [alone + np.bincount(_owners(sizes), tables, len(words)) + np.bincount(_owners(sizes_2), tables_2, len(words)), own]
        self.keys = _walked(steps, self.sizes)
        self.own = self._own(n, total + tables)
        self.own /= known.state.strength[1] + known.state.customers[self.keys]
        self.keys += _owners(self.sizes) * places
        self.own_2 = self._own(n_2, total_2 + tables_2)
        # past the last word stands the unknown one
        at_parent = np.ones((2 * samples, len(self.words)))
        for x, values in zip(at_parent, past):
            x[self.count > 1] = values
        self.parents = np.stack([np.append(level.parent(at_parent[2 * s], at_parent[2 * s + 1]), known.unknown[s]) for s, level in enumerate(known.levels)])

    def _own(self, n: np.ndarray, total: np.ndarray) -> np.ndarray:
        tables = np.full(len(n), self.known.samples, np.float64)
        tables[n > 1] = total
        return n - self.known.state.discount[1] * tables / self.known.samples

    def seats(self) -> pa.RecordBatch:
        w, known = _owners(self.sizes), self.known
        context = self.keys - w * len(known.state.contexts)
        sums = self.own * known.samples + (known.back_offs[:, context] * self.parents[:, w]).sum(0)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(self.sizes))), pa.int32()), pa.array(x))
        return pa.RecordBatch.from_arrays([pa.array(signed(self.words)), pa.array(self.count.astype(np.int64)), lists(context), lists(sums), _doubles(self.parents[:, :-1])],
                                          ["word", "count", "contexts", "sums", "parents"])

    def rare_pairs(self) -> pa.RecordBatch:
        w = _owners(self.sizes_2)
        return pa.RecordBatch.from_arrays([pa.array(signed(self.words[w])), pa.array(signed(self.before)), pa.array(self.count[w].astype(np.int64)), pa.array(self.own_2), _doubles(self.parents[:, w])],
                                          ["word", "before", "count", "own", "parents"])

    def found(self, words: np.ndarray) -> np.ndarray:
        """Number of each word, that past the last for an unknown one."""
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, len(self.words))

    def after_frequent(self, w: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Probability of each word after its context."""
        p = (self.known.back_offs[:, context] * self.parents[:, w]).sum(0) / self.known.samples
        if len(self.keys):
            key = w * len(self.known.state.contexts) + context
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            p += np.where(self.keys[at] == key, self.own[at], 0.0)
        return p

    def own_after_rare(self, w: np.ndarray, before: np.ndarray) -> np.ndarray:
        """What a pair's own customers add to its probability, before it is divided by those of the context."""
        if not len(self.before):
            return np.zeros(len(w))
        if not hasattr(self, "rare"):
            of = _owners(self.sizes_2)
            keys = _pair(self.words[of], self.before)
            self.order = np.argsort(keys)
            self.rare = keys[self.order]
            self.rare_word = of[self.order]
        words = np.append(self.words, END)[w]
        at = np.minimum(np.searchsorted(self.rare, _pair(words, before)), len(self.rare) - 1)
        return np.where((self.rare_word[at] == w) & (self.before[self.order[at]] == before), self.own_2[self.order[at]], 0.0)


def _doubles(parents: np.ndarray) -> pa.Array:
    samples, n = parents.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * samples, pa.int32()), pa.array(np.ascontiguousarray(parents.T).reshape(-1)))


def fit(docs: DataFrame, context_share: float = 0.005, samples: int = 2, strength: tuple[float, float] = (1.0, 1.0), most_contexts: int = 1 << 19) -> Model:
    """The model of all ``docs``. The contexts sent to the tasks are the ``most_contexts`` most frequent words and those of at least ``context_share`` of all tokens; all others are joined rows."""
    context = docs.sparkSession.sparkContext
    contexts, large, total = frequent_words(docs, context_share, most_contexts)
    places = len(contexts)
    parts = max(PARTS, total // PART_TOKENS)
    counted = pair_counts(docs, context.broadcast(contexts), parts)
    customers, kinds, found = _sums(counted, (places, places, 7))
    words, n, once, twice, pairs_once, pairs_twice, pairs = (int(x) for x in found)
    discount = tuple(min(max(a / (a + 2 * b), 0.05), 0.95) if a else 0.5 for a, b in ((once, twice), (pairs_once, pairs_twice)))
    numbers = np.where(large, np.cumsum(large) - 1, -1)
    state = State(words, discount, strength, contexts, numbers, customers, kinds, float(pairs), float(words))
    rare = _written(_unrolled(counted, _RARE, "before long, customers long, kinds long").groupBy("before").agg(
        F.sum("customers").cast("double").alias("customers"), F.sum("kinds").cast("double").alias("kinds")))
    seats = counted
    # contexts beyond the frequent ones whose tables change, and the parts that ask for them
    asking = _written(_asking(counted))
    moving = _written(rare.join(asking.select("before").distinct(), "before").select("*", F.col("kinds").alias("there"), F.array().cast("array<double>").alias("backs")))
    levels, back_offs, unknown = [], [], []
    back = lambda there: (strength[1] + discount[1] * F.col(there)) / (strength[1] + F.col("customers"))

    def sample() -> None:
        levels.append(replace(state, contexts=contexts[:0], numbers=numbers[:0], customers=customers[:0], tables=customers[:0]))
        back_offs.append(np.append(state.back_off(), 1.0))
        unknown.append(float(state.parent(np.zeros(1), np.zeros(1))[0]))

    for turn in range(samples + 1):
        predict = turn >= 2
        if predict:
            sample()
        told = asking.join(moving.select("before", "there"), "before").groupBy("part").agg(F.collect_list(F.struct("before", "there")).alias("x")).select(
            "part", F.col("x.before").alias("befores"), F.col("x.there").alias("theres"))
        older = [seats, moving] if turn else [moving]
        seats = _written(seats.where(F.col("kind") == _SEATS).join(told, "part", "left").mapInArrow(_sweep(context.broadcast(state), turn, predict), _ROWS))
        more = _unrolled(seats, _RARE, "before long, more long").groupBy("before").agg(F.sum("more").alias("more"))
        moving = _written(moving.join(more, "before", "left").select(
            "before", "customers", "kinds", (F.col("kinds") + F.coalesce("more", F.lit(0))).alias("there"), (F.array_append("backs", back("there")) if predict else F.col("backs")).alias("backs")))
        for table in older:
            discard(table)
        added, at_parent = _sums(seats, (places, 2))
        state = replace(state, tables=kinds + added, parent_customers=at_parent[0] + once, parent_tables=at_parent[1] + once)
    sample()
    last = moving.select("before", F.array_append("backs", back("there")).alias("backs"))
    still = F.array(*[back("kinds")] * samples)
    beyond = _written(rare.join(last, "before", "left").select("before", "customers", F.coalesce("backs", still).alias("backs")))
    discard(rare), discard(asking), discard(moving)
    return Model(state, counted, seats, parts, n, words, samples, np.array(back_offs), np.array(unknown), levels, beyond)


def _asking(counted: DataFrame) -> DataFrame:
    """part, before: whose pairs with other than frequent contexts are seated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _, arrays in _read(batches):
            before = np.unique(arrays[6])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(before), part, np.int32)), pa.array(signed(before))], ["part", "before"])
    return counted.where(F.col("kind") == _SEATS).mapInArrow(run, "part int, before long")


def _after_rare(own, parents: str, model: Model):
    parts = [F.get("backs", F.lit(s)) * F.get(parents, F.lit(s)) for s in range(model.samples)]
    return own / (model.state.strength[1] + F.col("customers")) + sum(parts[1:], parts[0]) / model.samples


# ------------------------------------------------------------------- scoring

_FOUND = "row long, doc_id long, tokens long, known long, base double, score double, before long, own double, parents array<double>"


def _scored(shared):
    """A row per text, a row per text and chunk of a part with the sums over its tokens after frequent contexts, and one for each other token."""
    def table(row: np.ndarray, doc_id=None, tokens=None, known=None, base=None, score=None, before=None, own=None, parents=None) -> pa.RecordBatch:
        n = len(row)
        whole = lambda x: pa.array(np.zeros(n, np.int64) if x is None else x.astype(np.int64))
        real = lambda x: pa.array(np.zeros(n) if x is None else x.astype(np.float64))
        return pa.RecordBatch.from_arrays(
            [pa.array(row), pa.nulls(n, pa.int64()) if doc_id is None else doc_id, whole(tokens), whole(known), real(base), real(score),
             pa.nulls(n, pa.int64()) if before is None else pa.array(signed(before)), real(own), pa.nulls(n, pa.list_(pa.float64())) if parents is None else _doubles(parents)],
            [x.split()[0] for x in _FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Known = shared.value
        last, pairs, learned = None, None, None
        total = known.train_tokens + ADDED * (known.words + 1)
        for part, kind, place, arrays in _read(batches):
            if part != last:
                last, pairs, learned = part, None, None
            if kind == _PAIRS:
                pairs = arrays
            elif kind == _SEATS:
                learned = _Part(known, pairs, arrays)
                pairs = arrays = None
            elif kind == _TEXTS:
                ids, nulls, sizes = arrays
                yield table(place + np.arange(len(sizes)), pa.array(ids, mask=nulls), sizes)
            else:
                words, sizes, steps, text, sizes_2, before, text_2 = arrays
                learned = learned or _Part(known, None, None)
                w = learned.found(words)
                count = np.append(learned.count, 0)[w]
                base = np.log10((count + ADDED) / total)
                own, other = _owners(sizes), _owners(sizes_2)
                score = np.log10(learned.after_frequent(w[own], _walked(steps, sizes)))
                k = max(text.max(initial=-1), text_2.max(initial=-1)) + 1
                some = np.flatnonzero(np.bincount(text, minlength=k) + np.bincount(text_2, minlength=k))
                sums = lambda x: np.bincount(text, x[own], k)[some] + np.bincount(text_2, x[other], k)[some]
                yield table(place + some, known=sums((count > 0).astype(np.float64)), base=sums(base), score=np.bincount(text, score, k)[some])
                if len(other):
                    yield table(place + text_2.astype(np.int64), before=before, own=learned.own_after_rare(w[other], before), parents=learned.parents[:, w[other]])
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10 of the text's probability), one row per row of ``docs``."""
    context = docs.sparkSession.sparkContext
    dealt = _dealt(texts(docs), context.broadcast(model.contexts), model.parts, False)
    found = _written(_by_part(model.rows().unionByName(dealt), model.parts).mapInArrow(_scored(context.broadcast(model.known())), _FOUND))
    ones = F.array(*[F.lit(1.0)] * model.samples)
    rare = found.where("before IS NOT NULL").join(model.places, "before", "left").withColumns({"customers": F.coalesce("customers", F.lit(0.0)), "backs": F.coalesce("backs", ones)}).select(
        "row", F.lit(None).cast("long").alias("doc_id"), *[F.lit(0).cast("long").alias(c) for c in ("tokens", "known")], F.lit(0.0).alias("base"), F.log10(_after_rare(F.col("own"), "parents", model)).alias("score"))
    return found.where("before IS NULL").select(*rare.columns).unionByName(rare).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("tokens").alias("n_tokens"), F.sum("known").alias("n_known"),
        F.sum("base").alias("base_score"), F.sum("score").alias("score")).drop("row")


def score_held_out(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Scores of all documents by the model of those outside fold 0."""
    model = fit(texts(docs).where(bucket("doc_id", folds) != 0))
    scores = score(docs, model)
    discard(model.counted), discard(model.seated)
    return scores.select(
        "doc_id", F.coalesce(bucket("doc_id", folds) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
