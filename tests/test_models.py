"""Models on planted signals, and density clusters against a plain search."""

import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.operators import clusters, models

RNG = np.random.default_rng(11)
N = 300


@pytest.fixture(scope="module")
def planted(spark):
    a, b = RNG.normal(0, 1, N), RNG.normal(0, 1, N)
    ring = (a * a + b * b < 1.2).astype(int)
    pdf = pd.DataFrame({"id": np.arange(N), "a": a, "b": b, "y": 3 * a - 2 * b + 1, "side": (a + b > 0).astype(int), "ring": ring})
    return spark.createDataFrame(pdf)


def test_split_is_a_share_and_does_not_depend_on_partitions(planted):
    data, _ = models.prepare(planted, "side", ["a"], "id")
    one = models.split(data, stratify=True)
    other = models.split(data.repartition(7), stratify=True)
    key = lambda df: sorted((r["_key"], r["_test"]) for r in df.collect())
    assert key(one) == key(other)
    for r in one.groupBy("label").agg(F.avg(F.col("_test").cast("int")).alias("p"), F.count("*").alias("n")).collect():
        assert abs(r["p"] - 0.2) <= 1 / r["n"] + 1e-9


def test_linear_models_find_the_plane(planted):
    out = models.regression(planted, "y", "id", ["a", "b"], "linear", cv_folds=2)
    m = out["metrics"].first()
    assert m["r2"] > 0.999 and m["cv_mean"] > 0.999 and m["train_size"] + m["test_size"] == N
    weights = {r["feature"]: r["importance"] for r in out["importances"].collect()}
    assert weights["a"] == pytest.approx(3, abs=1e-3) and weights["b"] == pytest.approx(2, abs=1e-3)


def test_ridge_shrinks_by_the_sum_of_squares(spark):
    x = np.linspace(-1, 1, 21)
    df = spark.createDataFrame(pd.DataFrame({"_key": range(21), "x": x, "label": 2 * x}))
    fitted = models.regressor("ridge", 21, float(np.std(2 * x))).fit(models.assembled(df, ["x"]))
    assert fitted.coefficients[0] == pytest.approx(2 * (x @ x) / (x @ x + 1.0), rel=1e-4)


def test_classifiers(planted):
    flat = models.classification(planted, "side", "id", ["a", "b"], "logistic", cv_folds=2)
    m = flat["metrics"].first()
    assert m["accuracy"] > 0.9 and m["f1"] > 0.9
    assert flat["confusion"].agg(F.sum("n")).first()[0] == m["test_size"]
    curved = models.classification(planted, "ring", "id", ["a", "b"], "svm", cv_folds=2)["metrics"].first()
    assert curved["accuracy"] > 0.85


def test_quality_of_several_classes():
    counts = [(0.0, 0.0, 2), (1.0, 1.0, 1), (1.0, 2.0, 1), (2.0, 2.0, 4)]
    q = models.quality(counts)
    assert q["accuracy"] == pytest.approx(7 / 8)
    assert q["precision"] == pytest.approx((1.0 * 2 + 1.0 * 2 + 0.8 * 4) / 8)
    assert models.quality([(1.0, 0.0, 3)])["precision"] == 0.0


def test_task_with_one_class(spark):
    m = spark.createDataFrame([("a", 1.0, 50.0, 0), ("b", 2.0, 60.0, 0)], "email string, total_hours double, avg_progress double, courses_completed int")
    out = models.train_and_score(models.completion_label(m), "completion", "logistic_regression")
    assert "Only one class" in out["metrics"].first()["error"] and set(out) == {"metrics"}


@pytest.mark.parametrize("method", ["kmeans", "hierarchical", "bisecting"])
def test_planted_clusters_are_recovered(spark, method):
    spots = np.array([[0, 0], [10, 0], [0, 10]])
    truth = np.arange(150) % 3
    xy = spots[truth] + RNG.normal(0, 0.3, (150, 2))
    df = spark.createDataFrame(pd.DataFrame({"id": range(150), "x": xy[:, 0], "y": xy[:, 1]}))
    out = clusters.clustering(df, ["x", "y"], "id", method, 3, starts=2)
    assert sorted(r["n"] for r in out["sizes"].collect()) == [50, 50, 50]
    assert out["metrics"].first()["silhouette_score"] > 0.9
    with pytest.raises(ValueError):
        clusters.clustering(df, ["x", "y"], "id", "other")


def plain_dbscan(points, eps, least):
    """Labels in the order of the rows, by searching all pairs."""
    near = ((points[:, None] - points[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= least
    labels, current = np.full(len(points), -1), 0
    for i in range(len(points)):
        if labels[i] != -1 or not core[i]:
            continue
        stack = [i]
        labels[i] = current
        while stack:
            for j in np.flatnonzero(near[stack.pop()]):
                if labels[j] == -1:
                    labels[j] = current
                    if core[j]:
                        stack.append(j)
        current += 1
    return labels


def test_dbscan_equals_a_plain_search(spark):
    blob, line = RNG.normal(0, 0.25, (90, 2)), np.stack([np.linspace(1, 3, 25), np.full(25, 2.0)], 1)
    noise, copies = RNG.uniform(-3, 4, (25, 2)), np.repeat([[3.5, -2.5]], 60, 0)
    points = np.concatenate([blob, line, noise, copies])[RNG.permutation(200)]
    df = spark.createDataFrame(pd.DataFrame({"id": range(200), "x": points[:, 0], "y": points[:, 1]}))
    got = clusters.dbscan(df.repartition(3), ["x", "y"], "id", 0.3, 5).toPandas().sort_values("id")["cluster"]
    assert got.tolist() == plain_dbscan(points, 0.3, 5).tolist()


def test_dbscan_in_five_columns(spark):
    centres = RNG.normal(0, 2, (4, 5))
    points = np.concatenate([c + RNG.normal(0, 0.25, (30, 5)) for c in centres] + [RNG.uniform(-4, 4, (20, 5)), np.repeat(centres[:1] + 3, 10, 0)])
    columns = list("abcde")
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(points)), **{c: points[:, i] for i, c in enumerate(columns)}}))
    got = clusters.dbscan(df.repartition(3), columns, "id", 0.8, 5).toPandas().sort_values("id")["cluster"]
    assert got.tolist() == plain_dbscan(points, 0.8, 5).tolist()


def test_dbscan_beyond_constant_and_binary_columns(spark):
    """The first columns do not tell cells apart, so the others must: few cells meet, and the result is the plain one."""
    rng = np.random.default_rng(21)
    n = 300
    points = np.column_stack([
        np.zeros((n, 3)), rng.integers(0, 2, (n, 3)) * 7.0, rng.integers(0, 5, n) * 0.4, rng.uniform(0, 60, n), np.full(n, -0.0), rng.uniform(0, 60, n),
    ])
    points[:120, 7:] = np.repeat(rng.uniform(0, 60, (12, 3)), 10, 0) + rng.normal(0, 0.2, (120, 3))
    points[:120, 3:7] = np.repeat(points[:12, 3:7], 10, 0)
    columns = [f"x{i}" for i in range(points.shape[1])]
    df = spark.createDataFrame(pd.DataFrame({"id": range(n), **{c: points[:, i] for i, c in enumerate(columns)}})).repartition(3)
    got = clusters.dbscan(df, columns, "id", 1.5, 4).toPandas().sort_values("id")["cluster"]
    assert got.tolist() == plain_dbscan(points, 1.5, 4).tolist() and got.max() > 3
    side = 1.5 / np.sqrt(len(columns))
    places = np.unique(np.floor(points / side).astype(int), axis=0)
    cells = [f"_c{i}" for i in range(len(columns))]
    nodes = spark.createDataFrame(pd.DataFrame({c: places[:, i] for i, c in enumerate(cells)}).assign(_node=range(len(places))))
    axes = clusters._axes(nodes, cells)
    assert not {"_c0", "_c1", "_c2"} & set(axes) and {"_c3", "_c4", "_c5"} <= set(axes)
    moved = clusters._with_neighbours(nodes, axes, clusters._reach(len(cells)))
    met = moved.select(*[F.col(f"n_{c}").alias(c) for c in axes]).join(nodes, list(axes)).count()
    near = (np.abs(places[:, None] - places[None]).max(-1) <= clusters._reach(len(cells))).sum()
    assert near <= met <= 3 * near < len(places) ** 2 / 20
    assert clusters._cell_pairs(nodes, nodes.withColumnRenamed("_node", "b"), cells, axes, [F.col("_node").alias("a")]).count() == near


def test_labels_of_any_kind(planted):
    grades = planted.withColumn("grade", F.when(F.col("a") > 0.5, "A").when(F.col("a") > -0.5, "B").otherwise("C"))
    out = models.classification(grades, "grade", "id", ["a", "b"], "logistic", cv_folds=2)
    assert out["metrics"].first()["accuracy"] > 0.8
    assert {r["label"] for r in out["confusion"].collect()} == {"A", "B", "C"} and {r["prediction"] for r in out["predictions"].collect()} <= {"A", "B", "C"}
    numbers = planted.withColumn("two", F.col("side") + 1)
    boosted = models.classification(numbers, "two", "id", ["a", "b"], "gradient_boosting", cv_folds=2, trees=3)
    assert {r["label"] for r in boosted["confusion"].collect()} == {"1", "2"}
    with pytest.raises(ValueError, match="more than"):
        models.classification(planted, "a", "id", ["b"], "logistic")


def test_boosting_sees_a_row_for_each_combination_of_places(spark, monkeypatch):
    """The same model as the engine's from all rows, from as many weighted rows as combinations occur."""
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.integers(0, 4, (600, 2)).astype(float), columns=["a", "b"]).assign(_key=range(600))
    pdf["y"] = pdf["a"] - pdf["b"] ** 2 + rng.normal(0, 0.3, 600)
    fitted_rows = []
    for target, kinds in (("y", 0), ("three", 3), ("two", 2)):
        pdf["three"], pdf["two"] = pdf["y"].rank().floordiv(201), (pdf["y"] > pdf["y"].median()).astype(float)
        data = models.assembled(spark.createDataFrame(pdf.assign(label=pdf[target].astype(float))), ["a", "b"])
        made = lambda: models.classifier("gradient_boosting", 600, kinds, 4) if kinds else models.regressor("gradient_boosting", 600, trees=4)  # noqa: B023, E731
        kept = models.cut_lineage
        monkeypatch.setattr(models, "cut_lineage", lambda df: fitted_rows.append(kept(df)) or fitted_rows[-1])
        got = models.boosted(data, ["a", "b"], made(), kinds)
        monkeypatch.setattr(models, "cut_lineage", kept)
        both = [m.transform(data).select("_key", "prediction").orderBy("_key").toPandas()["prediction"] for m in (got, made().fit(data))]
        assert np.allclose(*both) and fitted_rows[-1].count() <= 16 * max(1, kinds)


def test_fits_of_the_kernel_machine_follow_one_another(spark, monkeypatch):
    """Each keeps its wide rows in memory, so no two large ones are in it at once; a task projects few rows at a time."""
    lock, now, most, made = threading.Lock(), [0], [0], models.classifier

    class Watched:
        def __init__(self, inner):
            self.inner = inner

        def fit(self, part):
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            try:
                return self.inner.fit(part)
            finally:
                with lock:
                    now[0] -= 1

    monkeypatch.setattr(models, "classifier", lambda *a: Watched(made(*a).setMaxIter(3)))
    monkeypatch.setattr(models, "WIDE_ROWS", 200)
    x = np.random.default_rng(5).normal(0, 1, (150, 2))
    pdf = pd.DataFrame({"k": range(150), "a": x[:, 0], "b": x[:, 1], "y": ((x**2).sum(1) < 1.2).astype(int)})
    df = spark.createDataFrame(pdf)
    out = models.classification(df, "y", "k", ["a", "b"], "svm", cv_folds=2)
    assert most[0] == 1 and out["metrics"].first()["train_size"] > 0
    whole = [r["features"].toArray() for r in models.rbf_features(df, ["a", "b"], 9).orderBy("k").collect()]
    monkeypatch.setattr(models, "PIECE", 7)
    cut = [r["features"].toArray() for r in models.rbf_features(df.coalesce(1), ["a", "b"], 9).orderBy("k").collect()]
    assert np.allclose(whole, cut) and len(cut) == 150
