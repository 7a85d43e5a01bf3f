"""Packing: ids against the tokenizer, and an exact round trip."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from lexigaze.llm import packing

ODD = ["a  b", "a\n\nb", " a", "a ", "", "a\tb c", "a \nb", "x \xa0y", "x  y", "it's 'll\nI'll", "a\nb c\n d", "..\n..", "1\n2 3", "\n", "a\n b",
       "<|endoftext|> b", "é\nü ß", "a\r\nb c", "x\n's y", "a \n", "  a b", "a\x85b c", "x's\ny't 're", "\x1c a", "a\x1fb", "日本 語", "😀 x"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda texts: [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


def round_trip(rows, ids):
    """Pieces cover every document once, sequences are gapless and of a power of two; padded ones are counted."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(docs) == set(ids)
    for doc_id, pieces in docs.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[doc_id]) // 4
            assert r.ids_crc32 == zlib.crc32(ids[doc_id][4 * at:4 * (at + r.length)])
            at += r.length
        assert at == len(ids[doc_id]) // 4
    padded = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == pieces[0].sequence_tokens <= 1024
        padded += at & (at - 1) != 0
    return padded, len(sequences)


def test_ids(plain):
    assert packing.Encoder().encode(pa.array(ODD)) == plain(ODD)


def test_ids_of_random_texts(plain):
    rng = np.random.default_rng(3)
    pieces = ["a", "bc", "'s", " ", " ", "  ", "\n", "\n", "\t", "\r", "\xa0", "\u2003", "\u3000", "\x85", "\x1c", "7", "é", "中", "😀", "!", "<|endoftext|>", ".", "word"]
    texts = ["".join(rng.choice(pieces, rng.integers(0, 30))) for _ in range(3000)]
    encoder = packing.Encoder()
    assert encoder.encode(pa.array(texts)) == plain(texts) == encoder.encode(pa.array(texts))


def test_words_are_learned_anew_after_forgetting(plain, monkeypatch):
    monkeypatch.setattr(packing, "MEMO_ENTRIES", 30)
    encoder = packing.Encoder()
    for i in range(6):
        texts = [f"alpha beta {i}{j} gamma{j}" for j in range(20)]
        assert encoder.encode(pa.array(texts)) == plain(texts)
    assert len(encoder.known) < 100


def test_table(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known = [(r.doc_id, r.text) for r in docs.collect()]
    ids = dict(zip((i for i, _ in known), (c + b"\0\0\0\0" for c in plain([t or "" for _, t in known]))))
    rows = packing.pack_documents(docs, block_tokens=20_000).collect()
    padded, n = round_trip(rows, ids)
    assert padded == 0 and n > 20
    rows = packing.pack_documents(docs.repartition(50)).collect()
    assert round_trip(rows, ids)[0] == 0
    load = defaultdict(dict)
    for r in rows:
        load[r.step_group][r.sequence_id] = r.sequence_tokens
    assert max(sum(x.values()) for x in load.values()) <= packing.STEP_TOKENS + 1024


def test_edge(spark, plain):
    rows = [(i, t) for i, t in enumerate([None, *ODD, "w " * 30000])]
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, length long")
    ids = dict(zip((i for i, _ in rows), (c + b"\0\0\0\0" for c in plain([t or "" for _, t in rows]))))
    assert round_trip(packing.pack_documents(docs).collect(), ids)[0] == 0
    assert packing.pack_documents(docs.where("false")).count() == 0
