"""Ward clusters against a literal agglomeration."""

import itertools

import numpy as np
import pytest

from lectern.operators import ward as module
from lectern.operators.clusters import clustering
from lectern.operators.ward import cut_merges, fit_tree, merges, ward


def literal(points, clusters):
    """Merge the two groups whose union adds least to the sum of squares, again and again; heights and partition."""
    groups = [[i] for i in range(len(points))]
    heights = []

    def squares(g):
        return ((points[g] - points[g].mean(0)) ** 2).sum()

    partition = None
    while len(groups) > 1:
        if len(groups) == clusters:
            partition = {frozenset(g) for g in groups}
        grown = {(i, j): squares(groups[i] + groups[j]) - squares(groups[i]) - squares(groups[j]) for i, j in itertools.combinations(range(len(groups)), 2)}
        i, j = min(grown, key=grown.get)
        heights.append(np.sqrt(2 * max(0.0, grown[i, j])))
        groups = [g for n, g in enumerate(groups) if n not in (i, j)] + [groups[i] + groups[j]]
    return heights, partition


@pytest.mark.parametrize("seed,dims", [(0, 1), (1, 2), (2, 5)])
def test_merges_equal_the_literal_agglomeration(seed, dims):
    points = np.random.default_rng(seed).normal(size=(45, dims))
    heights, partition = literal(points, 6)
    found = merges(points, np.ones(len(points)))
    assert np.allclose([h for *_, h in found], heights)
    group = cut_merges(found, len(points), 6)
    assert {frozenset(np.flatnonzero(group == g).tolist()) for g in set(group)} == partition


def test_tree_separates_all_distinct_points():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.integers(0, 4, (60, 2)).astype(float), np.nextafter(np.ones((2, 2)), [[0], [2]])])
    distinct = np.unique(points, axis=0)
    leaves = fit_tree(distinct, np.ones(len(distinct)), 1000).leaves(points)
    assert all((leaves[i] == leaves[j]) == (points[i] == points[j]).all() for i, j in itertools.combinations(range(len(points)), 2))
    assert len(set(fit_tree(distinct, np.ones(len(distinct)), 5).leaves(points))) == 5


def frame(spark, points):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "key long, a double, b double").repartition(3)


def test_weighted_points_and_numbers(spark):
    points = np.random.default_rng(6).normal(size=(40, 2))
    points = np.concatenate([points, points[:15], points[:5]])
    labels, steps = ward(frame(spark, points), ["a", "b"], "key", 5)
    mine = dict(labels.collect())
    heights, partition = literal(points, 5)
    steps = steps.orderBy("step").toPandas()
    assert {frozenset(i for i in mine if mine[i] == c) for c in set(mine.values())} == partition
    assert np.allclose(steps.height, heights[20:]) and np.allclose(heights[:20], 0) and steps.points.iloc[-1] == len(points)
    assert [min(i for i in mine if mine[i] == c) for c in range(5)] == sorted(min(g) for g in partition)
    # the growths of all merges add up to the whole sum of squares
    assert (steps.height**2).sum() / 2 == pytest.approx(((points - points.mean(0)) ** 2).sum())


def test_micro_clusters(spark, monkeypatch):
    monkeypatch.setattr(module, "MICRO", 50)
    monkeypatch.setattr(module, "SAMPLE", 200)
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.normal(c, 0.3, (150, 2)) for c in ((0, 0), (5, 5), (0, 6))])
    labels, steps = ward(frame(spark, points), ["a", "b"], "key", 3)
    mine = dict(labels.collect())
    assert [{mine[i] for i in range(150 * c, 150 * c + 150)} for c in range(3)] == [{0}, {1}, {2}]
    assert steps.count() <= 49 and steps.orderBy("step").collect()[-1]["points"] == 450


def test_few_points(spark):
    two = frame(spark, [(1, 1), (1, 1), (2, 2)])
    labels, steps = ward(two, ["a", "b"], "key", 4)
    assert sorted(map(tuple, labels.collect())) == [(0, 0), (1, 0), (2, 1)] and steps.count() == 1
    labels, steps = ward(two.limit(0), ["a", "b"], "key", 4)
    assert labels.count() == steps.count() == 0
    text = spark.createDataFrame([("x", 1.0), ("b", 9.0), ("c", 9.5)], "name string, v double")
    out = clustering(text, ["v"], "name", "hierarchical", 2)
    assert sorted(map(tuple, out["labels"].collect())) == [("b", 0), ("c", 0), ("x", 1)] and out["merges"].count() == 2


@pytest.mark.parametrize("slow", [0.9, 0.0])
def test_all_points_are_merged_however_many(spark, monkeypatch, slow):
    """No point is replaced by the mean of others before the merges: rounds over boxes give the merges of the whole."""
    monkeypatch.setattr(module, "WHOLE", 40)
    monkeypatch.setattr(module, "BOX", 48)
    monkeypatch.setattr(module, "SLOW", slow)
    points = np.random.default_rng(9).normal(size=(400, 2)) * [1, 3]
    points = np.concatenate([points, points[:60]])
    labels, steps = ward(frame(spark, points), ["a", "b"], "key", 6)
    steps = steps.orderBy("step").toPandas()
    found = merges(points[:400], np.where(np.arange(400) < 60, 2, 1))
    assert steps.step.tolist() == list(range(399)) and np.allclose(steps.height, [h for *_, h in found])
    rows, _ = module._named(found, list(range(400)), list(range(400)), [2 if i < 60 else 1 for i in range(400)])
    assert [tuple(r) for r in steps[["one", "other", "points"]].itertuples(index=False)] == [(r[2], r[3], r[5]) for r in rows]
    group = cut_merges(found, 400, 6)
    mine = dict(labels.collect())
    assert len(mine) == 460 and all(mine[i] == mine[i - 400] for i in range(400, 460))
    assert [mine[i] for i in range(400)] == np.unique(group, return_inverse=True)[1].tolist()


def test_the_highest_merge_may_be_one_of_a_round(spark, monkeypatch):
    """Two far points that are each other's nearest are still two clusters."""
    monkeypatch.setattr(module, "WHOLE", 10)
    monkeypatch.setattr(module, "BOX", 16)
    near = np.random.default_rng(3).normal(size=(60, 2)) * 1e-3
    points = np.concatenate([near, [[0, 900], [0, 1700]]])
    labels, steps = ward(frame(spark, points), ["a", "b"], "key", 3)
    mine = dict(labels.collect())
    assert {i for i in mine if mine[i] == 0} == set(range(60)) and (mine[60], mine[61]) == (1, 2) and steps.count() == 61
