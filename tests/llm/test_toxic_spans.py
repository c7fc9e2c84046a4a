"""The token tagger: exact inference, gradients by documents only, spans and held-out accuracy."""

import itertools
import math
import pickle
import zlib

import numpy as np
import pytest

from lectern.llm import toxic_spans
from lectern.llm.toxic_spans import Tagger, fit_tagger, marginals, tag, train


@pytest.mark.parametrize("piece", [1, 2, 64])
def test_marginals_equal_enumeration(piece, monkeypatch):
    monkeypatch.setattr(toxic_spans, "PIECE", piece)
    rng = np.random.default_rng(1)
    count = np.array([3, 0, 1, 5, 2, 0])
    odds, moves = np.exp(rng.normal(size=11)), np.exp(rng.normal(size=3))
    toxic, clean, pairs = marginals(odds, count, *moves)
    at = 0
    for k, n in enumerate(count):
        total, own, pair = 0.0, np.zeros(n), np.zeros((3, n))
        for s in itertools.product((0, 1), repeat=int(n)):
            w = math.prod(odds[at + i] for i, x in enumerate(s) if x)
            kinds = [{(0, 1): 0, (1, 0): 1, (1, 1): 2}.get(p) for p in zip((0, *s), s)]
            w *= math.prod(moves[i] for i in kinds if i is not None)
            total, own = total + w, own + w * np.array(s)
            for i, kind in enumerate(kinds):
                if kind is not None:
                    pair[kind, i] += w
        assert np.allclose(toxic[at : at + n], own / total) and np.isclose(clean[k], -math.log(total))
        assert np.allclose(pairs[:, at : at + n], pair / total)
        at += n


def _texts():
    """Sentences of twenty words; the second half holds two words that the first never has, at random places."""
    rng = np.random.default_rng(2)
    words = "a the quiet day river rain came late stayed nine boats went out home said that was long sat at".split()
    clean = [[str(w) for w in rng.choice(words, 12)] for _ in range(200)]
    for text in clean[100:]:
        for bad in ("zorg", "blarg"):
            text.insert(int(rng.integers(len(text))), bad)
    return [" ".join(t).capitalize() + "." for t in clean[:100]], [" ".join(t).capitalize() + "." for t in clean[100:]]


CLEAN, TOXIC = _texts()
LABELS = [0] * 100 + [1] * 100


def test_spans_and_offsets():
    model = fit_tagger(CLEAN + TOXIC, LABELS)
    text = "Ünder the bridge.\nA quiet Zorg sat at the river, the blarg went home."
    score, expected, toxic = model.documents([text, "A quiet day.", ""])
    assert score[0] > 0.5 > score[1] and expected[0] > 1
    assert [text[a:b] for a, b, _ in model.spans(text, toxic[0])] == ["Zorg", "blarg"]
    again = pickle.loads(pickle.dumps(model)).documents([text])[0]
    assert np.allclose(again, score[:1])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = tag(docs, train(docs, labels)).join(labels.select("doc_id", "toxic"), "doc_id").select("doc_id", "held_out", "predicted", "toxic").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    out = got[got.held_out]
    assert (out.predicted == out.toxic).mean() > 0.97 and out.predicted[out.toxic == 1].mean() > 0.85 and out.predicted[out.toxic == 0].mean() < 0.02


def test_odd_input(spark):
    model = fit_tagger(CLEAN + TOXIC, LABELS)
    rows = [(1, "", 1), (2, None, 1), (3, "--- !", 1), (None, "a zorg " * 150_000, 1), (4, "zorg", 1), (4, "zorg", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = tag(df, model).collect()
    assert got[0].score == got[1].score and got[0].spans == got[1].spans == [] and got[4] == got[5] and got[3].held_out is False
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got) and len(got[3].spans) == 150_000
    assert tag(df.limit(0), model).count() == 0


def test_labels(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(CLEAN + TOXIC)] + [(0, "zz"), (None, "zorg")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i in range(200)] + [(None, 1), (3, None), (125, 0)], "doc_id long, toxic int")
    assert isinstance(train(docs, labels), Tagger)
    one = train(docs, labels.where("toxic = 0 and doc_id <> 125"))
    assert (one.documents(["zorg", ""])[0] < 0.2).all()
    assert np.allclose(train(docs, labels.limit(0)).documents(["x"])[0], 0.5)
