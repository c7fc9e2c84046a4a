"""Packing against the tokenizer itself and the rules of a sequence."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lectern.llm.packing import CAPACITY, WordEncoder, cut, pack

TEXTS = [
    "The quick&&& brown, fox's it'll 123 Straße!! ÉTÉ", "", None, "  \n\t ", "a\x1cb <|endoftext|> c", "été 日本語 😀 ΣΑΣ",
    "word " * 9000, "x" * 5000, "same text", "same text",
]


def test_encoder_equals_the_tokenizer():
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [t or "" for t in TEXTS]
    got = [np.frombuffer(b, dtype="<u4").tolist() for b in WordEncoder("word_bpe_49k.json").encode(texts)]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_cut_is_whole_and_close_to_classes():
    for n in range(1, 3 * CAPACITY):
        pieces = cut(n)
        assert sum(pieces) == n and all(p > 0 for p in pieces)
        assert all(CAPACITY - CAPACITY // p * p <= 64 for p in pieces)


def test_pack(spark):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(i, t, "x") for i, t in enumerate(TEXTS * 3)] + [(None, "no id", "x")]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)).toPandas()
    for i, t, _ in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        own = got[got.doc_id.isna() if i is None else got.doc_id == i].sort_values("start")
        assert (own.doc_tokens == len(ids)).all() and own.start.tolist() == [0, *own.length.cumsum()[:-1]]
        for start, n, crc in zip(own.start, own.length, own.ids_crc32):
            assert crc == zlib.crc32(np.array(ids[start : start + n], dtype="<u4").tobytes())
        assert own.length.sum() == len(ids)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= CAPACITY
    assert got.sequence_id.nunique() <= got.length.sum() / CAPACITY + 2


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
