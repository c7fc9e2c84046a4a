"""Whitening against dense linear algebra and exact whole numbers."""

import math

import numpy as np
import pandas as pd
import pytest

from lectern.llm.whitening import above, leading, tridiagonal, whiten


@pytest.mark.parametrize("size", [1, 2, 5, 64, 100])
def test_leading_equals_dense_solution(size):
    v = np.cov(np.random.default_rng(size).normal(size=(size, 300))).reshape(size, size)
    values, vectors = leading(v, 32)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:32], rtol=1e-12, atol=1e-13)
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12 and np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def test_equal_and_zero_eigenvalues():
    assert len(leading(np.eye(20), 8)[0]) == 8 and len(leading(np.zeros((4, 4)), 2)[0]) == 0
    b = np.random.default_rng(1).normal(size=(50, 10))
    values, vectors = leading(b @ b.T, 32)
    assert len(values) == 10 and np.abs(vectors.T @ vectors - np.eye(10)).max() < 1e-12
    v = np.diag([3.0, 3.0, 3.0, 1.0, 1.0 + 1e-13, 0.0])
    assert np.allclose(leading(v, 4)[0], [3, 3, 3, 1])


def test_inertia():
    v = np.cov(np.random.default_rng(3).normal(size=(12, 40)))
    parts, values = tridiagonal(v), np.linalg.eigvalsh(v)
    assert [above(*parts, s) for s in np.linspace(0, 3, 50)] == [(values > s).sum() for s in np.linspace(0, 3, 50)]


def plain(rows, components=32):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(0)
    centred = np.array([[float(n * a - b) / n for a, b in zip(r, s)] for r in x])
    v = centred.T @ centred / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:components], w[:, ::-1][:, :components]
    return [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x], centred @ w / np.sqrt(e), e / np.trace(v)


def check(got, rows, components=32):
    deviation, whitened, explained = plain(rows, components)
    k = len(explained)
    got = got.sort_values(["vec_id", "component"])
    assert got.component.tolist() == list(range(1, k + 1)) * len(rows) and (got.n == len(rows)).all()
    assert got.deviation.tolist() == [d for d in deviation for _ in range(k)]
    mine = got.whitened.to_numpy().reshape(-1, k)
    assert np.abs(mine * np.sign((mine * whitened).sum(0)) - whitened).max() < 1e-8
    assert np.allclose(got.explained.to_numpy().reshape(-1, k), explained, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-8
    assert np.abs(np.cov(mine.T, bias=True) - np.eye(k)).max() < 1e-8


def test_real_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    check(whiten(table).toPandas(), sorted((r.vec_id, r.embedding) for r in table.collect()))


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    sound = [(i, rng.normal(size=3).tolist()) for i in range(40)] + [(40, [0.0, 0.0, 0.0])]
    odd = [(50, None), (51, [1.0, None, 2.0]), (52, [1.0, float("nan"), 0.0]), (53, [float("inf"), 0.0, 0.0]), (54, []), (55, [1.0, 2.0])]
    schema = "vec_id long, embedding array<float>, n string, whitened int"
    df = spark.createDataFrame([(*r, "a", 1) for r in sound + odd], schema).repartition(4)
    got = whiten(df)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(got.toPandas(), [(i, [float(np.float32(c)) for c in v]) for i, v in sound])
    check(whiten(df, 2).toPandas(), [(i, [float(np.float32(c)) for c in v]) for i, v in sound], 2)
    twice = df.where("vec_id = 1").unionByName(df.where("vec_id <= 3")).withColumn("vec_id", df.vec_id)
    again = whiten(twice.unionByName(df.where("vec_id = 2").selectExpr("cast(null as long) vec_id", "embedding", "n", "whitened"))).toPandas()
    assert (again.n == 6).all() and again.vec_id.isna().sum() == again.component.max() and len(again[again.vec_id == 1]) == 2 * again.component.max()
    assert whiten(df.limit(0)).count() == 0 and whiten(df.where("vec_id = 1")).count() == 0 and whiten(df.where("vec_id > 49 and vec_id < 55")).count() == 0


def test_large_entries(spark):
    rows = [(i, [1e6 * i, -1e9 * (i % 3), 1e12 * (i % 2)]) for i in range(6)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    x = [[64 * int(c) + 1_000_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    want = [sum((6 * a - b) ** 2 for a, b in zip(r, s)) for r in x]
    for i, d in enumerate(want):
        mine = got[got.vec_id == i].deviation
        assert mine.isna().all() if d >= 2**63 else (mine == d).all()
    assert pd.notna(got.whitened).all()
