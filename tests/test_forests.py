"""Forests: one tree against a plain recursion, independence of partitions and of the size of a task's nodes, planted signals."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.operators import forests, models

RNG = np.random.default_rng(3)


def plain(bins, y, w, asked, depth):
    """Answers of a regression tree by recursion over all cuts."""
    mean = np.average(y, weights=w)
    if depth == 0 or len(set(y)) == 1:
        return np.full(len(asked), mean)
    best = (1e-9, None)
    for c in range(bins.shape[1]):
        for cut in range(forests.BINS - 1):
            left = bins[:, c] <= cut
            if left.any() and not left.all():
                loss = sum((w[s] * (y[s] - np.average(y[s], weights=w[s])) ** 2).sum() for s in (left, ~left))
                gain = (w * (y - mean) ** 2).sum() - loss
                if gain > best[0] + 1e-9:
                    best = (gain, (c, cut))
    if best[1] is None:
        return np.full(len(asked), mean)
    c, cut = best[1]
    out, left, go = np.empty(len(asked)), bins[:, c] <= cut, asked[:, c] <= cut
    out[go] = plain(bins[left], y[left], w[left], asked[go], depth - 1)
    out[~go] = plain(bins[~left], y[~left], w[~left], asked[~go], depth - 1)
    return out


@pytest.mark.parametrize("depth", [2, 30])
def test_a_tree_equals_a_plain_recursion(depth):
    bins = RNG.integers(0, forests.BINS, (120, 3)).astype(np.uint8)
    y, w = RNG.normal(0, 1, 120), RNG.integers(1, 4, 120)
    got, gains = forests.grow(bins, y, w, bins, 1, 0, 0, 3, depth)
    assert np.allclose(got[:, 0], plain(bins, y, w, bins, depth)) and (gains > 0).all()


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_cells_of_small_nodes_are_not_built_when_empty(classes):
    """The same cut and gain as from all cells, whatever bins hold rows; the work grows with the rows."""
    n, rows = 60, 200
    at = np.sort(np.append(np.arange(n), RNG.integers(0, n, rows - n)))
    bins, w = RNG.integers(0, forests.BINS, rows).astype(np.uint8), RNG.integers(1, 4, rows)
    y = RNG.integers(0, classes, rows).astype(float) if classes else RNG.integers(-9, 9, rows).astype(float)
    slack = np.full(n, 1e-9)
    cells = forests._cells(at * forests.BINS + bins, y, w, n * forests.BINS, classes).reshape(n, forests.BINS, -1)
    cut, gain = forests._best(cells, classes, slack)
    stats = (np.eye(classes)[y.astype(int)] if classes else np.stack([np.ones(rows), y], 1)).astype(np.int64) * w[:, None]
    found, gained = forests._best_occupied(at, bins, stats, n, classes, slack)
    many = np.isfinite(gain)
    assert (many == np.isfinite(gained)).all() and np.allclose(gain[many], gained[many])
    assert (cut[many] == found[many]).all()


def test_class_shares_of_a_leaf():
    bins, y = np.array([[0], [0], [0], [5]], np.uint8), np.array([0.0, 1.0, 1.0, 2.0])
    got, _ = forests.grow(bins, y, np.array([1, 1, 2, 1], np.int32), bins, 1, 0, 3, 1, 30)
    assert np.allclose(got, [[0.25, 0.75, 0]] * 3 + [[0, 0, 1]])


def test_bootstrap_weights_have_mean_and_variance_one():
    hashes = RNG.integers(0, 2**63, 50_000).astype(np.uint64)
    one, other = forests._weights(hashes, 0), forests._weights(hashes, 1)
    assert abs(one.mean() - 1) < 0.02 and abs(one.var() - 1) < 0.03 and abs(np.corrcoef(one, other)[0, 1]) < 0.02


@pytest.mark.parametrize("classes", [0, 2])
def test_nodes_of_any_size_give_the_same_forest(spark, classes):
    n = 400
    a, b = RNG.normal(0, 1, n), RNG.normal(0, 1, n)
    label = (a * b > 0).astype(float) if classes else 3 * a - b
    pdf = pd.DataFrame({"_id": range(n), "_key": range(n), "a": a, "b": b, "same": 1.0, "label": label, "_test": np.arange(n) % 5 == 0, "_fold": np.arange(n) % 2})
    data = spark.createDataFrame(pdf)

    def run(df, rows):
        out, weights = forests.forest(df, ["a", "b", "same"], 2, classes, trees=5, node_rows=rows)
        found = out.select("_fit", "_id", "prediction").toPandas().sort_values(["_fit", "_id"], ignore_index=True)
        return found, weights

    (one, w1), (other, w2) = run(data, 10_000), run(data.repartition(5), 40)
    assert len(one) == (pdf["_test"].sum() + n) and (one[["_fit", "_id"]] == other[["_fit", "_id"]]).all(axis=None)
    assert np.allclose(one["prediction"], other["prediction"]) and np.allclose(w1, w2)
    assert w1.sum() == pytest.approx(1) and w1[2] == 0
    held = one.merge(pdf, on="_id")
    assert (held["prediction"] == held["label"]).mean() > 0.85 if classes else np.corrcoef(held["prediction"], held["label"])[0, 1] > 0.97


def test_forests_do_not_fit_with_the_engines_histograms(spark, monkeypatch):
    """Many deep trees on continuous labels: as many leaves as rows, none of which reaches the driver."""
    n = 3000
    x = RNG.uniform(-3, 3, (n, 3))
    df = spark.createDataFrame(pd.DataFrame({"id": range(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": np.sin(x[:, 0]) + x[:, 1] ** 2}))
    out = models.regression(df, "y", "id", ["a", "b", "c"], "random_forest", cv_folds=2, trees=30)
    m = out["metrics"].first()
    assert m["r2"] > 0.97 and m["cv_mean"] > 0.97 and m["train_size"] + m["test_size"] == n
    assert out["predictions"].count() == m["test_size"]
    weights = {r["feature"]: r["importance"] for r in out["importances"].collect()}
    assert weights["b"] > weights["a"] > weights["c"] and sum(weights.values()) == pytest.approx(1)


def test_scores_of_a_task_cover_every_learner(spark):
    n = 200
    hours = RNG.uniform(0, 10, n)
    df = spark.createDataFrame(pd.DataFrame({"email": [f"e{i}" for i in range(n)], "total_hours": hours, "other": RNG.normal(0, 1, n), "_label": (hours > 6).astype(int)}))
    out = models.train_and_score(df, "completion", cv_folds=2, trees=10)
    found = out["probabilities"].join(df, "email").toPandas()
    assert len(found) == n and found["completion_probability"].between(0, 1).all()
    assert found.groupby("_label")["completion_probability"].mean().diff().iloc[1] > 0.8
    assert out["metrics"].first()["auc_roc"] > 0.95 and out["top_flagged"].count() == 20


def test_rows_of_equal_bins_are_grown_as_one(monkeypatch):
    """The work of a tree follows the combinations of bins, not the rows; answers are those of the plain recursion."""
    cells = np.unique(RNG.integers(0, forests.BINS, (40, 3)).astype(np.uint8), axis=0)
    bins = cells[RNG.integers(0, len(cells), 3000)]
    y, w = RNG.normal(0, 1, 3000) + bins[:, 0], RNG.integers(1, 4, 3000)
    most, plainly = [], forests._best_sorted
    monkeypatch.setattr(forests, "_best_sorted", lambda node, *rest: most.append(len(node)) or plainly(node, *rest))
    got, _ = forests.grow(bins, y, w, np.concatenate([cells, cells]), 1, 0, 0, 3, 30)
    assert max(most) <= len(cells)
    want = [np.average(y[(bins == c).all(1)], weights=w[(bins == c).all(1)]) for c in cells]
    assert np.allclose(got[:, 0], want * 2)


@pytest.mark.parametrize("classes", [0, 2])
def test_rows_of_equal_bins_ask_once(spark, monkeypatch, classes):
    """Answers leave the trees for each cell and fit, not for each row; no row is left out, in whatever batch or task its cell is."""
    n, written, plainly = 4000, [], forests.cut_lineage
    cells = RNG.integers(0, 5, (n, 3)).astype(float)
    cells[: n // 2] = 2  # half of the rows are one cell, which is dealt over tasks
    y = (cells[:, 0] > 2).astype(float) if classes else cells[:, 0] * 3 + RNG.normal(0, 0.1, n)
    pdf = pd.DataFrame({"_id": range(n), "_key": range(n), "label": y, "_test": RNG.random(n) < 0.3, "_fold": RNG.integers(0, 2, n), "a": cells[:, 0], "b": cells[:, 1], "c": cells[:, 2]})
    monkeypatch.setattr(forests, "cut_lineage", lambda df: written.append(plainly(df)) or written[-1])
    found, _ = forests.forest(spark.createDataFrame(pdf).repartition(5), ["a", "b", "c"], 2, classes, 6)
    found = found.toPandas()
    answers = next(x for x in written if "tree" in x.columns).where("tree < 0")
    assert answers.count() <= 3 * len(np.unique(cells, axis=0))
    assert sorted(found["_id"]) == sorted([*range(n), *pdf["_id"][pdf["_test"]]])
    if classes:
        assert (found["prediction"] == found["label"]).mean() > 0.97
        assert np.allclose([sum(p.toArray()) for p in found["probability"]], 1) and np.allclose([sum(p.toArray()) for p in found["rawPrediction"]], 6)
    else:
        assert np.abs(found["prediction"] - found["label"]).max() < 2
