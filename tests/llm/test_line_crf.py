"""The line classifier: exact inference, features, held-out accuracy."""

import itertools
import math
import zlib

import numpy as np

from lectern.llm.line_crf import LineCrf, OWN, chains, fit, line_features, score, train


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    count = np.array([3, 0, 1, 5, 2])
    evidence, transitions = rng.normal(size=(11, 2)), rng.normal(size=(2, 2))
    got, pairs = chains(evidence, transitions, count)
    want_pairs, at = np.zeros((2, 2)), 0
    for n in count:
        total, good, own = 0.0, np.zeros(n), np.zeros((2, 2))
        for s in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(evidence[at + i, x] for i, x in enumerate(s)) + sum(transitions[a, b] for a, b in zip(s, s[1:])))
            total, good = total + w, good + w * np.array(s)
            for a, b in zip(s, s[1:]):
                own[a, b] += w
        assert np.allclose(got[at : at + n, 1], good / total)
        want_pairs += own / total
        at += n
    assert np.allclose(pairs, want_pairs)


def test_features_use_neighbours():
    x, length, count = line_features(["One line.\nTWO!!\n", "", "one"])
    assert x.shape == (4, 3 * len(OWN) + 3) and count.tolist() == [3, 0, 1] and length.tolist() == [9, 5, 0, 3]
    k = len(OWN)
    assert (x[0, k : 2 * k] == 0).all() and (x[1, k : 2 * k] == x[0, :k]).all() and (x[0, 2 * k : 3 * k] == x[1, :k]).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = score(docs, train(docs, labels)).join(labels.select("doc_id", "quality"), "doc_id").select("doc_id", "held_out", "predicted", "quality").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    out = got[got.held_out]
    assert (out.predicted == out.quality).mean() > 0.97 and (out.predicted == 0)[out.quality == 0].mean() > 0.9


def test_odd_input(spark):
    model = fit(["Good text, here.\nAnd more.", "### ### ###\n@@@"], [1, 0])
    assert isinstance(model, LineCrf)
    rows = [(1, "", 1), (2, None, 1), (3, "\n\n", 1), (None, "x" * 50_000, 1), (4, "a", 1), (4, "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = score(df, model).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert got[0].score == got[1].score == got[2].score == model.prior and got[4] == got[5] and got[3].held_out is False
    assert score(df.limit(0), model).count() == 0
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert train(df, empty).prior == 0.5
