"""Statistics against brute force and tabulated values."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.functions.pvalues import f_upper, t_two_sided
from lectern.operators import statistics

RNG = np.random.default_rng(3)


@pytest.fixture(scope="module")
def frame(spark):
    n = 400
    x = np.where(RNG.random(n) < 0.3, 5.0, RNG.normal(0, 10, n).round(1))
    y = (x * 0.5 + RNG.normal(0, 5, n)).round(0)
    z = np.where(RNG.random(n) < 0.2, np.nan, RNG.integers(0, 4, n))
    pdf = pd.DataFrame({"x": x, "y": y, "z": z, "g": RNG.choice(["a", "b", "c"], n)})
    return pdf, spark.createDataFrame(pdf).repartition(4)


def tau_b(a, b):
    s = tx = ty = n = 0
    for (x1, y1), (x2, y2) in itertools.combinations(zip(a, b), 2):
        n += 1
        tx += x1 == x2
        ty += y1 == y2
        s += np.sign(x1 - x2) * np.sign(y1 - y2)
    return s / math.sqrt((n - tx) * (n - ty))


@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
def test_correlations(frame, method):
    pdf, df = frame
    got = statistics.correlations(df, ["x", "y", "z"], method).toPandas().set_index("feature")
    for a, b in itertools.combinations("xyz", 2):
        both = pdf[[a, b]].dropna()
        if method == "kendall":
            want = tau_b(both[a], both[b])
        else:
            ranked = both.rank() if method == "spearman" else both
            want = ranked[a].corr(ranked[b])
        assert got.loc[a, b] == pytest.approx(want, abs=1e-9) and got.loc[b, a] == got.loc[a, b]
    assert got.loc["x", "x"] == 1.0


def test_kendall_tables_are_bounded(spark, monkeypatch):
    """With a tiny base there are many places and tables, and none has more cells than the base squared."""
    monkeypatch.setattr(statistics, "RANK_BASE", 3)
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"x": rng.permutation(300).astype(float), "y": rng.integers(0, 100, 300) / 7, "z": np.where(rng.random(300) < 0.4, 1.0, rng.normal(size=300))})
    pdf.loc[rng.random(300) < 0.1, "z"] = np.nan
    sizes = []
    plain = statistics._signed_pairs
    monkeypatch.setattr(statistics, "_signed_pairs", lambda group, *rest: sizes.append(np.bincount(group).max(initial=0)) or plain(group, *rest))
    got = statistics.correlations(spark.createDataFrame(pdf).repartition(5), ["x", "y", "z"], "kendall").toPandas().set_index("feature")
    for a, b in itertools.combinations("xyz", 2):
        both = pdf[[a, b]].dropna()
        assert got.loc[a, b] == pytest.approx(tau_b(both[a], both[b]), abs=1e-12)
    cells = pd.DataFrame(
        [(0, 1, 0, 0, p, 0, x, y, 1 + x * y % 3) for p in range(50) for x in range(3) for y in range(3)], columns=[*statistics._TABLE, "x", "y", "w"]
    )
    whole = pd.concat(statistics._table_signs(iter([cells]))).s.sum()
    cut = pd.concat(statistics._table_signs(iter([cells.iloc[i : i + 4] for i in range(0, len(cells), 4)]))).s.sum()
    assert whole == cut == 50 * sum(
        (1 + x * y % 3) * (1 + u * v % 3) * np.sign(v - y) for x in range(3) for y in range(3) for u in range(x + 1, 3) for v in range(3)
    )
    assert max(sizes) <= 9


def test_rank_correlations_of_odd_columns(spark):
    rows = [(1.0, None, 5.0, float("nan")), (2.0, None, 5.0, 1.0), (3.0, None, 5.0, 2.0), (None, 1.0, 5.0, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    for method in ("spearman", "kendall"):
        got = {r["feature"]: r for r in statistics.correlations(df, ["a", "b", "c", "d"], method).collect()}
        assert got["a"]["d"] == pytest.approx(1.0) and got["a"]["b"] is None and got["a"]["c"] is None and got["b"]["b"] == 1.0
        assert {r["feature"]: r["a"] for r in statistics.correlations(df.limit(0), ["a", "b"], method).collect()} == {"a": 1.0, "b": None}


def test_distributions(frame):
    pdf, df = frame
    got = statistics.distributions(df).toPandas().set_index("feature")
    assert set(got.index) == {"x", "y", "z"}
    for c in "xyz":
        v = pdf[c].dropna()
        want = [len(v), v.mean(), v.median(), v.std(), v.skew(), v.kurt(), v.quantile(0.25), v.quantile(0.75)]
        cols = ["count", "mean", "median", "std", "skew", "kurtosis", "q25", "q75"]
        assert np.allclose(got.loc[c, cols].astype(float), want)


def test_constant_and_short_columns(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, None), (1.0, None)], "a double, b double")
    rows = {r["feature"]: r for r in statistics.distributions(df).collect()}
    assert (rows["a"]["skew"], rows["a"]["kurtosis"]) == (0.0, 0.0)
    assert rows["b"]["skew"] is None and rows["b"]["kurtosis"] is None


@pytest.mark.parametrize("t,df,p", [(2.228, 10, 0.05), (2.042, 30, 0.05), (63.657, 1, 0.01), (3.169, 10, 0.01)])
def test_t_table(t, df, p):
    assert t_two_sided(t, df) == pytest.approx(p, rel=2e-3)


@pytest.mark.parametrize("f,d1,d2,p", [(4.96, 1, 10, 0.05), (3.49, 3, 12, 0.05), (2.71, 5, 20, 0.05), (5.39, 3, 30, 0.00437)])
def test_f_table(f, d1, d2, p):
    assert f_upper(f, d1, d2) == pytest.approx(p, rel=1e-2)


def test_large_samples_follow_the_normal_distribution():
    for d in (1e7, 1e9, 1e12):
        assert t_two_sided(1.96, d) == pytest.approx(math.erfc(1.96 / math.sqrt(2)), rel=1e-5)


def test_t_test_and_anova(frame, spark):
    pdf, df = frame
    row = statistics.t_test(df, "x", "g", "b", "c").first()
    a, b = pdf[pdf.g == "b"].x, pdf[pdf.g == "c"].x
    assert row["t_statistic"] == pytest.approx((a.mean() - b.mean()) / math.sqrt(a.var() / len(a) + b.var() / len(b)))
    assert row["significant"] == (row["p_value"] < 0.05)
    first = statistics.t_test_first_two(df, "x", "g").first()
    assert (first["group_a"], first["group_b"]) == ("a", "b")
    # three groups of two: between 16 / 2, within 1.5 / 3
    small = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0), ("c", 5.0), ("c", 6.0)], "g string, v double")
    one = statistics.anova(small, "v", "g").first()
    assert one["f_statistic"] == pytest.approx(16.0) and one["p_value"] == pytest.approx(0.0251, abs=1e-4)
    alone = statistics.anova(small.where("g = 'a'"), "v", "g").first()
    assert alone["p_value"] == 1.0 and not alone["significant"] and alone["error"]


def test_kendall_builds_the_tables_of_a_pairs_own_places(spark, monkeypatch):
    """A column of few values has one place, however many places the other one needs."""
    monkeypatch.setattr(statistics, "RANK_BASE", 3)
    points = spark.range(60).select(F.lit(0).alias("a"), F.lit(1).alias("b"), (F.col("id") % 3).alias("x"), F.col("id").alias("y"), F.lit(1).cast("long").alias("w"))
    more = points.select("a", F.lit(2).alias("b"), "y", F.col("x").alias("y"), "w").toDF("a", "b", "x", "y", "w")
    found = statistics._table_cells(points.unionByName(more)).select("a", "b", "lx", "ly").distinct().collect()
    assert sorted(tuple(r) for r in found) == [*[(0, 1, 0, j) for j in range(4)], *[(0, 2, i, 0) for i in range(4)]]
    assert statistics._table_cells(points.limit(0)).count() == 0
