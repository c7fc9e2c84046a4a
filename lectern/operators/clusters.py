"""Clustering: k-means, Ward, bisecting k-means and density-based clusters."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.exprs import q
from lectern.functions.ordering import prefix_counts
from lectern.operators.models import SEED, assembled, standardised
from lectern.operators.ward import ward
from lectern.session import cut_lineage


def _points(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    return df.select(F.col(q(key)).alias("_key"), *[F.col(q(c)).cast("double").alias(c) for c in columns]).dropna()


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cluster")


def centres(df: DataFrame, labels: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Mean of every column per cluster, in original units."""
    return (
        df.join(labels, key)
        .groupBy("cluster")
        .agg(*[F.avg(q(c)).alias(c) for c in columns])
        .orderBy("cluster")
    )


def clustering(
    df: DataFrame,
    features: Sequence[str],
    key: str,
    method: str = "kmeans",
    n_clusters: int = 4,
    starts: int = 10,
    eps: float = 0.5,
    min_samples: int = 5,
) -> dict[str, DataFrame]:
    """Labels, sizes, centres and silhouette on standardised features.

    `hierarchical` merges by Ward's criterion and also returns `merges`; `bisecting` divides top-down. The silhouette uses
    squared distances, which needs only one pass.
    """
    columns = [c for c in features if c in df.columns]
    raw = cut_lineage(_points(df, columns, key))
    scaled = cut_lineage(standardised(raw, columns))
    if method == "kmeans":
        vectors = cut_lineage(assembled(scaled, columns))
        runs = [KMeans(k=n_clusters, seed=SEED + i).fit(vectors) for i in range(starts)]
        labels = min(runs, key=lambda m: m.summary.trainingCost).transform(vectors)
        labels = labels.select("_key", F.col("prediction").alias("cluster"))
    elif method == "hierarchical":
        labels, merges = ward(scaled, columns, "_key", n_clusters)
    elif method == "bisecting":
        # the first split starts from a fraction of the centre's length, which must not be zero
        moved = assembled(scaled.withColumns({c: F.col(q(c)) + 1.0 for c in columns}), columns)
        model = BisectingKMeans(k=n_clusters, seed=SEED).fit(moved)
        labels = model.transform(moved).select("_key", F.col("prediction").alias("cluster"))
    elif method == "dbscan":
        labels = dbscan(scaled, columns, "_key", eps, min_samples)
    else:
        raise ValueError(f"Unknown clustering method: {method}")
    labels = cut_lineage(labels)
    kinds = labels.groupBy().agg(
        F.countDistinct("cluster").alias("all"), F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("k")
    ).first()
    silhouette = 0.0
    if kinds["all"] > 1:
        judged = assembled(scaled.join(labels, "_key"), columns).withColumn("prediction", F.col("cluster") + 1)
        silhouette = ClusteringEvaluator().evaluate(judged)
    metrics = df.sparkSession.createDataFrame(
        pd.DataFrame({"method": [method], "n_clusters": [int(kinds["k"])], "silhouette_score": [float(silhouette)]})
    )
    named = labels.withColumnRenamed("_key", key)
    extra = {"merges": merges} if method == "hierarchical" else {}
    return extra | {
        "labels": named,
        "sizes": cluster_sizes(named),
        "centres": centres(raw.withColumnRenamed("_key", key), named, columns, key),
        "metrics": metrics,
    }


# --- density-based clusters -------------------------------------------------------------
#
# Points are put into cells so small that any two points of a cell are neighbours. A cell with
# enough points has only core points, and no pair inside a cell is ever looked at. The points
# of the other cells are fewer than `min_samples` per cell, so comparing them with the cells
# around multiplies a row by a constant at most. Two cells belong together if some core point
# of one is near a core point of the other; that is decided on bounding boxes, which are
# halved only where they cannot tell.


def _distance2(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for x, y in zip(a, b):
        out = out + (x - y) * (x - y)
    return out


#: Cells around a cell along the joined axes at most, and coordinates of an axis up to which neighbours are picked from a list.
AROUND, FEW = 1500, 64


def _reach(dims: int) -> int:
    return math.ceil(math.sqrt(dims))


def _axes(spots: DataFrame, cells: list[str]) -> dict[str, list[int] | None]:
    """The axes along which neighbouring cells are joined, with their coordinates if these are few.

    Axes are chosen by the data: first those whose occupied coordinates are too far apart to be neighbours (a flag, a code),
    which are joined for equality, then those with the most coordinates for the neighbours they cost, as long as a cell has
    no more than AROUND cells around. Constant axes tell nothing and are left out; axes not chosen are filtered.
    """
    reach = _reach(len(cells))
    long = spots.select(F.inline(F.array(*[F.struct(F.lit(i).alias("axis"), F.col(c).alias("at")) for i, c in enumerate(cells)]))).distinct()
    long = cut_lineage(long)
    counts = {r["axis"]: r["count"] for r in long.groupBy("axis").count().collect()}  # one row per axis
    few = [i for i, n in counts.items() if 1 < n <= FEW]
    values: dict[int, list[int]] = {i: [] for i in few}
    for r in long.where(F.col("axis").isin(few)).collect() if few else []:  # FEW rows per axis at most
        values[r["axis"]].append(r["at"])
    cost = {i: 2 * reach + 1 for i, n in counts.items() if n > FEW}
    for i in few:
        values[i].sort()
        cost[i] = max(sum(abs(v - w) <= reach for w in values[i]) for v in values[i])
    chosen, around = {}, 1
    for i in sorted(cost, key=lambda i: (cost[i] > 1, -counts[i] / cost[i], i)):
        if around * cost[i] <= AROUND:
            around *= cost[i]
            chosen[cells[i]] = values.get(i)
    return chosen or {cells[0]: None}


def _with_neighbours(df: DataFrame, axes: dict[str, list[int] | None], reach: int) -> DataFrame:
    """One row per cell around along the joined axes (itself included), as `n_<cell>` columns."""
    for c, values in axes.items():
        if values is None:
            near = F.sequence(F.col(c) - reach, F.col(c) + reach)
        else:
            near = F.filter(F.array(*[F.lit(v).cast("long") for v in values]), lambda v: F.abs(v - F.col(c)) <= reach)  # noqa: B023 - called at once
        df = df.withColumn(f"n_{c}", F.explode(near))
    return df


def _other_axes_near(cells: list[str], axes: dict[str, list[int] | None], mine: str) -> Column:
    """Along the axes that are not joined, the cells are near enough; `mine` is the prefix of one side's columns."""
    near = F.lit(True)
    for c in cells:
        if c not in axes:
            near = near & (F.abs(F.col(f"{mine}{c}") - F.col(c)) <= _reach(len(cells)))
    return near


def _cell_pairs(left: DataFrame, right: DataFrame, cells: list[str], axes: dict[str, list[int] | None], keep: Sequence[Column]) -> DataFrame:
    """Rows of `left` (the `keep` columns) with the rows of `right` whose cells can hold points within reach."""
    moved = _with_neighbours(left, axes, _reach(len(cells))).select(
        *keep, *[F.col(f"n_{c}").alias(c) for c in axes], *[F.col(c).alias(f"m_{c}") for c in cells if c not in axes]
    )
    return moved.join(right, list(axes)).where(_other_axes_near(cells, axes, "m_"))


def dbscan(
    df: DataFrame, columns: Sequence[str], key: str, eps: float = 0.5, min_samples: int = 5
) -> DataFrame:
    """Exact density-based clusters over any number of columns; noise has cluster -1.

    Clusters are numbered by their smallest core key, and a border point belongs to the first
    of its clusters. The key must be a number that gives the row order, or a text; clusters
    of text keys are numbered in the order of the keys' hashes.
    """
    if not columns:
        raise ValueError("no columns")
    dims, side = len(columns), eps / math.sqrt(len(columns))
    cells = [f"_c{i}" for i in range(dims)]
    spots = (
        df.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("_w"), F.min(key).alias("_id"))  # copies collapse to one point
        .withColumns({c: F.floor(F.col(q(x)) / side) for c, x in zip(cells, columns)})
    )
    spots = cut_lineage(spots)
    sizes = spots.groupBy(*cells).agg(F.sum("_w").alias("_cell_w"))
    spots = cut_lineage(spots.join(sizes, cells))
    dense = F.col("_cell_w") >= min_samples

    axes = _axes(spots, cells)
    near = _cell_pairs(
        spots.where(~dense), spots.select(*columns, *cells, "_w", F.col("_id").alias("_other")), cells, axes,
        ["_id", *[F.col(q(c)).alias(f"p_{c}") for c in columns]],
    ).where(_distance2([F.col(q(f"p_{c}")) for c in columns], [F.col(q(c)) for c in columns]) <= eps * eps)
    counted = near.groupBy("_id").agg(F.sum("_w").alias("_near"))
    core = spots.join(counted, "_id", "left").withColumn(
        "_core", dense | (F.coalesce("_near", F.lit(0)) >= min_samples)
    )
    core = cut_lineage(core.select("_id", *columns, *cells, "_w", "_core"))

    nodes = core.where("_core").groupBy(*cells).agg(F.min("_id").alias("_node"))
    nodes = cut_lineage(nodes)
    edges = _cell_edges(core.where("_core"), nodes, columns, cells, axes, side, eps)
    labels = _components(nodes.select("_node"), edges)
    named = nodes.join(labels, "_node").select(*cells, "_label")

    inner = core.where("_core").join(named, cells).select("_id", "_label")
    of_core = core.where("_core").join(named, cells).select(F.col("_id").alias("_other"), F.col("_label"))
    border = (
        near.join(core.where(~F.col("_core")).select("_id"), "_id", "left_semi")
        .join(of_core, "_other")
        .groupBy("_id")
        .agg(F.min("_label").alias("_label"))
    )
    order = prefix_counts_of_labels(labels)
    found = inner.unionByName(border).join(order, "_label").select("_id", "cluster")
    per_spot = core.join(found, "_id", "left").select(*columns, F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))
    return df.join(per_spot, list(columns)).select(key, "cluster")


def prefix_counts_of_labels(labels: DataFrame) -> DataFrame:
    """Clusters numbered from 0 in the order of their label."""
    distinct = labels.select("_label").distinct().withColumn("_cnt", F.lit(1))
    if dict(distinct.dtypes)["_label"] == "string":
        ranked = distinct.withColumn("_rank", F.struct(F.hash("_label"), F.xxhash64("_label")))
        counted = prefix_counts(ranked.select("_rank", "_cnt"), "_rank").join(ranked.select("_rank", "_label"), "_rank")
    else:
        counted = prefix_counts(distinct, "_label")
    return counted.select("_label", F.col("_before").cast("int").alias("cluster"))


FINEST = 52


def _parts(columns: Sequence[str], cells: list[str], side: float, level: int) -> dict[str, Column]:
    return {
        f"_s{i}": F.greatest(F.floor((F.col(q(x)) / side - F.col(c)) * 2**level), F.lit(0))
        for i, (x, c) in enumerate(zip(columns, cells))
    }


def _boxes(core: DataFrame, columns: Sequence[str], cells: list[str], side: float, level: int) -> DataFrame:
    """Bounding box and one point of every part of a cell; a cell has 2^level parts per axis."""
    subs = _parts(columns, cells, side, level)
    point = F.struct(*[F.col(q(x)).alias(f"r{i}") for i, x in enumerate(columns)])
    return (
        core.withColumns(subs)
        .groupBy("_node", *subs)
        .agg(
            *[F.min(q(x)).alias(f"_lo{i}") for i, x in enumerate(columns)],
            *[F.max(q(x)).alias(f"_hi{i}") for i, x in enumerate(columns)],
            F.min_by(point, F.col("_id")).alias("_r"),
        )
    )


def _cell_edges(
    core: DataFrame, nodes: DataFrame, columns: Sequence[str], cells: list[str], axes: dict[str, list[int] | None], side: float, eps: float
) -> DataFrame:
    """Pairs of cells with core points near each other."""
    dims = range(len(columns))
    core = cut_lineage(core.join(nodes, cells).select("_id", "_node", *columns, *cells))
    pairs = _cell_pairs(nodes, nodes.withColumnRenamed("_node", "b"), cells, axes, [F.col("_node").alias("a")]).where("a < b").select("a", "b")
    todo = pairs.select("a", "b", *[F.lit(0).cast("long").alias(f"{s}{i}") for s in "ab" for i in dims])
    found: list[DataFrame] = []  # no pair is found at two levels
    level = 0
    while True:
        boxes = _boxes(core, columns, cells, side, level)

        def end(tag: str) -> DataFrame:
            up = {f"{tag}{i}": (F.col(f"_s{i}") if level == 0 else F.floor(F.col(f"_s{i}") / 2)) for i in dims}
            return boxes.select(
                F.col("_node").alias(tag),
                *[v.alias(k) for k, v in up.items()],
                *[F.col(f"{c}{i}").alias(f"{tag}{c}{i}") for c in ("_s", "_lo", "_hi") for i in dims],
                F.col("_r").alias(f"{tag}_r"),
            )

        step = todo.join(end("a"), ["a", *[f"a{i}" for i in dims]]).join(end("b"), ["b", *[f"b{i}" for i in dims]])
        gap, span = F.lit(0.0), F.lit(0.0)
        for i in dims:
            between = F.greatest(
                F.lit(0.0), F.col(f"a_lo{i}") - F.col(f"b_hi{i}"), F.col(f"b_lo{i}") - F.col(f"a_hi{i}")
            )
            across = F.greatest(F.col(f"a_hi{i}") - F.col(f"b_lo{i}"), F.col(f"b_hi{i}") - F.col(f"a_lo{i}"))
            gap, span = gap + between * between, span + across * across
        sample = _distance2([F.col(f"a_r.r{i}") for i in dims], [F.col(f"b_r.r{i}") for i in dims])
        flat = F.lit(True)
        for s in "ab":
            for i in dims:
                flat = flat & (F.col(f"{s}_lo{i}") == F.col(f"{s}_hi{i}"))
        single = flat
        limit = eps * eps
        judged = cut_lineage(
            step.select(
                "a",
                "b",
                *[F.col(f"{s}_s{i}").alias(f"{s}{i}") for s in "ab" for i in dims],
                ((span <= limit) | (sample <= limit)).alias("_yes"),
                # two boxes of one point each are settled by their sample
                ((gap <= limit) & ~single).alias("_open"),
            )
        )
        linked = judged.where("_yes").select("a", "b").distinct()
        found.append(linked)
        todo = judged.where("_open").join(linked, ["a", "b"], "left_anti").drop("_yes", "_open")
        if todo.isEmpty():
            return functools.reduce(DataFrame.unionByName, found)
        if level == FINEST:  # halves finer than a double can tell apart: the few points left are compared themselves
            parts = core.withColumns(_parts(columns, cells, side, level))
            point = lambda t: parts.select(
                F.col("_node").alias(t), *[F.col(f"_s{i}").alias(f"{t}{i}") for i in dims], *[F.col(q(c)).alias(f"{t}_p{i}") for i, c in enumerate(columns)]
            )
            both = todo.join(point("a"), ["a", *[f"a{i}" for i in dims]]).join(point("b"), ["b", *[f"b{i}" for i in dims]])
            last = both.where(_distance2([F.col(f"a_p{i}") for i in dims], [F.col(f"b_p{i}") for i in dims]) <= limit)
            return functools.reduce(DataFrame.unionByName, [*found, last.select("a", "b").distinct()])
        level += 1


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node of every node's component.

    Each round takes the smallest label among the neighbours and then the label of that label,
    so the number of rounds grows with the logarithm of the longest path.
    """
    both = cut_lineage(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut_lineage(nodes.select("_node", F.col("_node").alias("_label")))
    while True:
        near = (
            both.join(labels, both["b"] == labels["_node"])
            .groupBy(F.col("a").alias("_node"))
            .agg(F.min("_label").alias("_near"))
        )
        low = labels.join(near, "_node", "left").select(
            "_node", F.col("_label").alias("_old"), F.least("_label", "_near").alias("_low")
        )
        low = cut_lineage(low)
        heads = low.select(F.col("_node").alias("_low"), F.col("_low").alias("_head"))
        jumped = low.join(heads, "_low").select("_node", "_old", F.least("_low", "_head").alias("_label"))
        jumped = cut_lineage(jumped)
        labels = jumped.select("_node", "_label")
        if jumped.where(F.col("_old") != F.col("_label")).isEmpty():
            return labels
