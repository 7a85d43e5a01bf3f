"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds the normalised words of the benchmark items; documents stream through it and
the longest match that ends at each word is tracked. Words inside a match of ``window`` words,
or inside a whole shorter item, are hit. The items are dealt to automata of bounded size: each
block of items is one pass over the documents, so the benchmark may be of any size and only one
bounded block is sent to the tasks at a time. Cases: a null text or item has no words and is
never hit or never hits; repeated items are found each under its own id; texts of any length
stream; an empty benchmark or table gives counts of zero or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexigaze.llm.common import ALNUM, Rolling, numbered, pieces, signed, split_words, text_bytes, texts, word_hashes

WINDOW = 13
BLOCK_BYTES = 4 << 20


class Automaton:
    """A generalised suffix automaton of word sequences, with the items that hold each match."""

    def __init__(self, window: int):
        self.window = window
        self.length, self.link, self.next = [0], [-1], [{}]
        self.ends: list[tuple[int, int, int]] = []  # state after each word of an item, item, its number of words
        self.words: set[int] = set()
        self.pairs: set[int] = set()

    def add(self, item: int, words: list[int]) -> None:
        last = 0
        states = []
        for word in words:
            last = self._extend(last, word)
            states.append(last)
        # each prefix of the item marks its state; what ends there ends in all its suffix links
        self.ends.extend((state, item, place + 1) for place, state in enumerate(states) if place + 1 >= self.window)
        if 0 < len(words) < self.window:
            self.ends.append((states[-1], item, len(words)))

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._copy(last, word, q)
        cur = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][word]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._copy(p, word, q)
        return cur

    def _copy(self, p: int, word: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.next.append(following)
        self.link.append(link)
        return len(self.length) - 1

    def finish(self) -> Automaton:
        """Items per state of window length, and whole short items per state."""
        self.items: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, set[int]]]] = {}
        whole: dict[int, dict[int, set[int]]] = {}
        for state, item, words in self.ends:
            if words < self.window:
                # a whole short item is the longest string of its state or lies on the state's way to the root
                whole.setdefault(state, {}).setdefault(words, set()).add(item)
                continue
            at = self.clip(state)
            self.items.setdefault(at, set()).add(item)
        self.whole = whole
        return self

    def clip(self, state: int) -> int:
        """The state of the last ``window`` words of a match that ends in ``state``."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def shorts(self, state: int) -> list[tuple[int, set[int]]]:
        """Whole short items that end in ``state``: (words, items)."""
        if state not in self.short:
            up = self.shorts(self.link[state]) if self.link[state] > 0 else []
            self.short[state] = up + [x for x in self.whole.get(state, {}).items()]
        return self.short[state]

    def scan(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Stretches of words that are hit and the items that hit them."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        state = length = 0
        for place, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            if length >= self.window:
                spans.append((place + 1 - self.window, place + 1))
                items |= self.items.get(self.clip(state), set())
            if self.whole:
                for n, which in self.shorts(state):
                    if n <= length:
                        spans.append((place + 1 - n, place + 1))
                        items |= which
        return spans, items


def _hit_lengths(words: np.ndarray, counts: np.ndarray, pairs: np.ndarray, least: int) -> np.ndarray:
    """Words inside runs of at least ``least`` words whose neighbours all stand side by side in some item.

    Elsewhere no match of that length can end, so the automaton need not stream there.
    """
    n = len(words)
    if least <= 1:
        return np.ones(n, bool)
    joined = np.isin(_pair(words[:-1], words[1:]), pairs)
    ends = np.cumsum(counts)[:-1]
    ends = ends[(ends > 0) & (ends < n)]
    joined[ends - 1] = False
    edge = np.diff(np.concatenate(([0], joined.view(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = last - first + 1 >= least
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, first[long], 1)
    np.add.at(mark, last[long] + 1, -1)
    return np.cumsum(mark[:-1]) > 0


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * np.uint64(0x9E3779B97F4A7C15) ^ b


def _scanner(automaton: Automaton, pairs: np.ndarray, least: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words, counts = word_hashes(batch.column("text"), ALNUM)
            firsts = np.concatenate(([0], np.cumsum(counts)))
            near = _hit_lengths(words, counts, pairs, least) if len(words) > 1 else np.ones(len(words), bool)
            edge = np.diff(np.concatenate(([0], near.view(np.int8), [0])))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            spans: list[list[tuple[int, int]]] = [[] for _ in counts]
            items: list[set[int]] = [set() for _ in counts]
            doc = np.searchsorted(firsts, begin, side="right") - 1
            for d, b, e in zip(doc.tolist(), begin.tolist(), end.tolist()):
                while b < e:  # a run may go on into the next text only where single words count
                    stop = min(e, int(firsts[d + 1]))
                    if stop > b:
                        found, which = automaton.scan(signed(words[b:stop]).tolist())
                        shift = b - int(firsts[d])
                        spans[d].extend((x + shift, y + shift) for x, y in found)
                        items[d] |= which
                    b, d = stop, d + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts.tolist(), pa.int64()), pa.array([_merged(s) for s in spans], pa.list_(pa.list_(pa.int64()))),
                 pa.array([sorted(i) for i in items], pa.list_(pa.int64()))], ["doc_id", "n_words", "spans", "items"])
    return run


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of bounded size, fetched one partition at a time."""
    block, size = [], 0
    for row in benchmark.where("text IS NOT NULL").select("item_id", "text").toLocalIterator():
        block.append((row.item_id, row.text))
        size += len(row.text)
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (stretches of hit words), items (ids as strings): one row per document."""
    passes, source, rows = [], texts(docs), None
    blocks = _blocks(benchmark, block_bytes)
    ahead = list(islice(blocks, 2))
    if len(ahead) > 1:  # passes are put together by row, whatever the ids
        rows = numbered(docs)
        source = rows.select(F.col("row").alias("doc_id"), "text")
    for number, block in enumerate(chain(ahead, blocks)):
        hashes, counts = word_hashes(pa.array([text for _, text in block]), ALNUM)
        automaton = Automaton(window)
        at, least, pairs = 0, window, []
        for index, n in enumerate(counts.tolist()):
            words = hashes[at:at + n]
            at += n
            if n:
                automaton.add(index, signed(words).tolist())
                least = min(least, n)
                pairs.append(_pair(words[:-1], words[1:]))
        pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
        schema = "doc_id long, n_words long, spans array<array<bigint>>, items array<bigint>"
        names = F.array(*[F.lit(str(i)) for i, _ in block]) if len(block) <= 1 else F.lit([str(i) for i, _ in block])
        found = source.mapInArrow(_scanner(automaton.finish(), pairs, least, number), schema)
        passes.append(found.withColumn("items", F.transform("items", lambda i: F.get(names, i.cast("int")))))
    if not passes:
        empty = F.expr("CAST(array() AS array<string>)")
        count = lambda batches: (pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(word_hashes(b.column("text"), ALNUM)[1])], ["doc_id", "n_words"]) for b in pieces(batches))
        return texts(docs).mapInArrow(count, "doc_id long, n_words long").select(
            "doc_id", "n_words", F.expr("CAST(array() AS array<array<bigint>>)").alias("spans"), empty.alias("items"))
    if len(passes) == 1:
        return passes[0]
    # as many rows per document as there are blocks of items, whatever the text
    merged = reduce(DataFrame.unionByName, passes).groupBy(F.col("doc_id").alias("row")).agg(
        F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return merged.join(rows.select("row", "doc_id"), "row").select("doc_id", "n_words", "spans", "items")


def covered(spans):
    """Number of words inside the stretches, overlaps once."""
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
                       lambda a, s: F.struct((a["n"] + F.greatest(s[1] - F.greatest(s[0], a["to"]), F.lit(0).cast("long"))).alias("n"),
                                             F.greatest(a["to"], s[1]).alias("to")), lambda a: a["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids), contaminated: hit words are one in ``one_in`` or more."""
    hits = find_hits(docs, benchmark, window).withColumn("n_hit", covered(F.col("spans")))
    return hits.select("doc_id", "n_words", "n_hit", F.array_sort(F.array_distinct("items")).alias("items"), "spans",
                       ((F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
