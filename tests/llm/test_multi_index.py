"""The inverted multi-index against brute force."""

import math

import numpy as np

from lectern.llm.multi_index import neighbours, traverse

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, step, k):
    fine = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max({len(v) for _, v in fine}, key=lambda d: (sum(len(v) == d for _, v in fine), d))
    fine = [(i, v) for i, v in fine if len(v) == width]
    return {i: sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in fine if j != i)[:k] for i, v in fine if i % step == 0}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_exact_when_all_cells_are_visited(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)]  # a group of equal vectors, larger than a result
    rows += [(None, [1.0] * 8), (2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0, None] * 4), (2010, [1.0] * 5), (2020, [])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    want = brute(rows, 10, 10)
    got = found(neighbours(df, step=10, share=1.0))
    assert {q: [j for _, j in v] for q, v in got.items()} == {q: [j for _, j in v] for q, v in want.items()}
    assert all(abs(a - b) < 1e-12 for q in want for (a, _), (b, _) in zip(got[q], want[q]))


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0, ""), (1, [1.0, 3.0], 0, "")], SCHEMA)
    assert found(neighbours(df)) == {0: [(1.0, 1)]}
    assert neighbours(df.limit(0)).count() == 0


def test_traversal_is_by_summed_distance():
    rng = np.random.default_rng(2)
    a, b, counts = rng.random(6), rng.random(7), rng.integers(0, 3, (6, 7))
    order = traverse(a, b, counts, 10**9)
    sums = [a[c // 7] + b[c % 7] for c in order]
    assert sums == sorted(sums) and set(order) == {i * 7 + j for i, j in zip(*np.nonzero(counts))}


def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want, got = brute(rows, 100, 10), found(neighbours(table))
    assert np.mean([len({j for _, j in got[q]} & {j for _, j in want[q]}) / 10 for q in want]) >= 0.9
