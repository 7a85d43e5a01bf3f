"""Hierarchical multi-length packing of tokenized documents into sequences of at most 1024 tokens.

Whole windows are cut from long documents; what remains of each goes to the tier of its length
(1024, 512, 256, 128, 64). A window of a tier is opened for each remainder and its gap filled from
the shorter tiers, whole remainders first, then a cut one, so that windows end full. Sequences
are dealt to step groups of equal token counts. All of it happens inside the task that reads the
documents, in blocks of bounded tokens: nothing is shuffled, and a retried task gives the same
sequences. What is left of a block's last window is cut into powers of two, so nothing is padded.
Cases: a null or empty text is its end token alone; a text longer than a block is a block of its
own; a null doc_id is passed on; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lexigaze.llm.common import Rolling, pieces, text_bytes, texts

LONGEST = 1024
TIERS = (1024, 512, 256, 128, 64)
STEP_TOKENS = 32 * 1024
BLOCK_TOKENS = 1 << 20
MEMO_ENTRIES = 2_000_000
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_tokens long, step_group long")
# Fixed value: how byte-level vocabularies of this kind split a text.
SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Bytes that surely don't begin a blank: those above the space, but for the first bytes of blanks beyond ASCII.
_SOLID = np.arange(256) > 0x20
_SOLID[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False
_PLAIN = _SOLID & (np.arange(256) < 0x80)


def _byte_pairs(model: dict):
    """The tokenizer file's vocabulary in the library that is fastest on single words; the ids are the same."""
    import tiktoken

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte for c in token) and not token.startswith("<|")}
    return tiktoken.Encoding("words", pat_str=SPLITS, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of whole texts, each distinct word encoded once.

    A blank that stands before something else, and a lone line end, never share a piece of the
    vocabulary's splitting pattern with what comes before them, so texts are cut there and every part
    is looked up by its hash. Names of the file's added tokens are those tokens.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str | None = None):
        with open(path or self._default(), encoding="utf-8") as f:
            file = json.load(f)
        self.words = _byte_pairs(file["model"])
        self.added = {t["content"]: t["id"] for t in file.get("added_tokens") or ()}
        self.names = re.compile("|".join(f"({re.escape(c)})" for c in sorted(self.added, key=len, reverse=True))) if self.added else None
        self._forget()

    @staticmethod
    def _default() -> str:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")

    @classmethod
    def shared(cls, path: str | None) -> Encoder:
        """The one of this process: what it has learned serves the next task, too."""
        key = path or cls._default()
        if key not in cls._made:
            cls._made[key] = cls(key)
        return cls._made[key]

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes, sorted
        self.place = np.zeros(0, np.int64)  # where the ids of each begin in ``ids``
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, parts: list[str]) -> None:
        if len(self.known) > MEMO_ENTRIES:
            self._forget()
        encode = self.words.encode_ordinary
        ids = [encode(part) for part in parts]
        size = np.array([len(i) for i in ids], np.int64)
        new = np.fromiter((x for i in ids for x in i), np.uint32, int(size.sum()))
        place = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate((self.ids, new))
        known = np.concatenate((self.known, hashes))
        order = np.argsort(known, kind="stable")
        self.known, self.place, self.size = known[order], np.concatenate((self.place, place))[order], np.concatenate((self.size, size))[order]

    def _whole(self, text: str) -> bytes:
        """A text that holds names of added tokens: what lies between them is encoded by itself."""
        out = []
        for part in self.names.split(text):
            if part:
                out += [self.added[part]] if part in self.added else self.words.encode_ordinary(part)
        return np.array(out, "<u4").tobytes()

    def encode(self, column: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text of a column; null is empty."""
        data, offsets = text_bytes(column)
        starts, counts = _parts(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes = Rolling(data).of(starts, ends)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        missing = np.append(self.known, np.uint64(0))[at] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if missing.any():
            raw = data.tobytes()
            before = len(self.known)
            self._learn(distinct[missing], [raw[starts[i]:ends[i]].decode() for i in first[missing]])
            if len(self.known) < before + missing.sum():  # it had to forget: also what this batch knew
                rest = ~missing
                self._learn(distinct[rest], [raw[starts[i]:ends[i]].decode() for i in first[rest]])
            at = np.searchsorted(self.known, distinct)
        size, place = self.size[at][which], self.place[at][which]
        done = np.cumsum(size)
        ids = self.ids[np.repeat(place - (done - size), size) + np.arange(done[-1] if len(done) else 0)]
        cut = np.concatenate(([0], done))[np.concatenate(([0], np.cumsum(counts)))] * 4
        flat = ids.astype("<u4").tobytes()
        out = [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        if self.names:
            for i in np.flatnonzero(pc.match_substring_regex(column, self.names.pattern).fill_null(False).to_numpy(zero_copy_only=False)):
                out[i] = self._whole(column[int(i)].as_py())
        return out


def _parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts of the texts begin, and how many each text has."""
    begin = np.zeros(len(data) + 1, bool)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    if len(data):
        follows = np.append(_SOLID[data[1:]], False) & ~edge[1:]
        begin[:-1] = (data == 0x20) & follows
        ends = np.flatnonzero(data[1:-1] == 0x0A) + 1
        lone = ends[_PLAIN[data[ends - 1]] & _PLAIN[data[ends + 1]] & ~edge[ends] & ~edge[ends + 1]]
        begin[lone] = begin[lone + 1] = True
    begin[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    starts = np.flatnonzero(begin[:-1])
    return starts, np.diff(np.searchsorted(starts, offsets))


def pack(lengths: list[int]) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) for documents of the given lengths."""
    sequences, tails = [], []
    for doc, n in enumerate(lengths):
        whole = n - n % LONGEST
        sequences += [[(doc, at, LONGEST)] for at in range(0, whole, LONGEST)]
        if n > whole:
            insort(tails, (n - whole, doc, whole))
    while tails:
        length, doc, start = tails.pop()
        size = next(t for t in reversed(TIERS) if t >= length)
        window, gap = [(doc, start, length)], size - length
        while gap and tails:
            at = bisect_right(tails, (gap, float("inf"), 0)) - 1
            if at >= 0:  # the longest whole remainder that fits
                n, d, s = tails.pop(at)
            else:  # none fits: the shortest is cut
                n, d, s = tails.pop(0)
                insort(tails, (n - gap, d, s + gap))
                n = gap
            window.append((d, s, n))
            gap -= n
        sequences += [window] if not gap else _powers(window)
    return sequences


def _powers(window: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The last, unfilled window of a block as windows of falling powers of two, so that nothing is padded."""
    out, left = [], sum(n for _, _, n in window)
    window = window[::-1]
    while left:
        size = 1 << left.bit_length() - 1 if left < LONGEST else LONGEST
        taken = []
        left -= size
        while size:
            d, s, n = window.pop()
            if n > size:
                window.append((d, s + size, n - size))
                n = size
            taken.append((d, s, n))
            size -= n
        out.append(taken)
    return out


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """A group for each sequence: the longest first, always to the group with the fewest tokens."""
    heap = [(0, g) for g in range(max(1, -(-sum(sizes) // step_tokens)))]
    out = [0] * len(sizes)
    for at in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, group = heap[0]
        out[at] = group
        heapq.heapreplace(heap, (load + sizes[at], group))
    return out


def _blocks(batches: Iterator[pa.RecordBatch], encoder: Encoder, block_tokens: int) -> Iterator[tuple[list[int], list[bytes]]]:
    ids, codes, size = [], [], 0
    for batch in pieces(batches):
        for doc_id, code in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text"))):
            ids.append(doc_id)
            codes.append(code + b"\0\0\0\0")
            size += len(code) // 4 + 1
        if size >= block_tokens:
            yield ids, codes
            ids, codes, size = [], [], 0
    if ids:
        yield ids, codes


def _packer(path: str | None, block_tokens: int, step_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        sequence = group = (context.partitionId() if context else 0) << 40
        for ids, codes in _blocks(batches, Encoder.shared(path), block_tokens):
            sequences = pack([len(c) // 4 for c in codes])
            sizes = [sum(n for _, _, n in s) for s in sequences]
            groups = step_groups(sizes, step_tokens)
            rows = []
            for members, size, g in zip(sequences, sizes, groups):
                offset = 0
                for doc, start, n in members:
                    rows.append((ids[doc], start, n, zlib.crc32(codes[doc][4 * start:4 * (start + n)]), len(codes[doc]) // 4,
                                 sequence, offset, size, group + g))
                    offset += n
                sequence += 1
            group += max(groups) + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_group"])
    return run


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, block_tokens: int = BLOCK_TOKENS,
                   step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece of a document in a sequence; ``step_group`` numbers groups of about ``step_tokens`` tokens."""
    return texts(docs).mapInArrow(_packer(tokenizer_path, block_tokens, step_tokens), SCHEMA)
