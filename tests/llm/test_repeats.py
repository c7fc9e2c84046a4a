"""Removal of repeated strings against counting all of them."""

import hashlib
import random
from collections import Counter

import pytest

from lectern.llm import repeats as R
from lectern.llm.repeats import remove_repeats


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def corpus(rng, alphabet):
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    base, passage, short = text(900), text(130), text(70)
    texts = [text(rng.randrange(600)) for _ in range(20)] + [base] * 3 + ["", None, "é" * 500, "ab" * 300, text(5000)]
    for _ in range(30):
        t = list(base)
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(t))
            t[i : i + rng.randrange(3)] = text(rng.randrange(4))
        texts.append("".join(t))
    for _ in range(60):  # one passage in many surroundings, and two halves that meet in some
        texts.append(text(rng.randrange(80)) + passage + text(rng.randrange(80)) + (short if rng.random() < 0.5 else "") + text(50))
    return texts


@pytest.mark.parametrize(("alphabet", "hot"), [("ab", 1000), ("abcdefgh é", 1000), ("abcdefgh é", 3)])
def test_equals_counting(spark, alphabet, hot, monkeypatch):
    monkeypatch.setattr(R, "HOT", hot)
    rng = random.Random(5)
    texts = corpus(rng, alphabet)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in remove_repeats(df, length=60, name=25).collect()}
    want = brute(texts, 60)
    assert [got[i] for i in range(len(texts))] == want


def test_pieces(monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 300)
    rng = random.Random(6)
    raw = bytes(rng.choice(b"abc") for _ in range(2000))
    starts = [(f, la) for h, c, first, last, spot in R.samples(raw, 60, 25) for f, la in zip(first.tolist(), last.tolist())]
    assert sorted(i for f, la in starts for i in range(f, la + 1)) == list(range(2000 - 59))


def test_ids_that_repeat_and_empty(spark):
    df = spark.createDataFrame([(1, "x" * 500), (1, "x" * 500), (None, "y" * 300), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(df).collect()), key=str)
    assert got == sorted([(1, 500, 500, 1), (1, 500, 500, 1), (None, 300, 0, 0), (2, 0, 0, 0)], key=str)
    assert remove_repeats(df.limit(0)).count() == 0
