"""Agglomerative clusters with Ward's criterion.

Equal points are one point with a count. Up to WHOLE of them are merged by a nearest-neighbour chain, which needs their number squared in
time and once in memory. More are first merged in rounds that share the work: the space is cut into boxes of about BOX clusters, and a task
merges in its box only pairs of which no cluster of another box can be nearer to either. Merging others never brings a cluster nearer
(Ward's distance is reducible), so these are merges of the greedy order. The cuts move from round to round; where most
clusters lie too near to other boxes, a round compares boxes pairwise and merges all pairs that are each other's nearest. All merges are exact.

Only if MICRO is set are points first gathered into so many micro-clusters, and merges are then those of the micro-clusters.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.exprs import q
from lectern.functions.ordering import ordered_window
from lectern.operators.models import numbered
from lectern.session import cut_lineage

#: Distinct points that are merged in one piece at most, and clusters of a box.
WHOLE, BOX = 20_000, 8192
#: Micro-clusters at most, if an approximation is wanted, and distinct points their tree is fitted on if there are more.
MICRO: int | None = None
SAMPLE = 65_536
#: Clusters per box from which the cuts are taken.
PER_BOX = 64
#: Share of the clusters that must be left by a round for the next one to compare boxes pairwise.
SLOW = 0.9


@dataclass
class Tree:
    """A node sends points with `x[axis] <= cut` to `below`, others to `above`; a leaf has axis -1 and its number in `below`."""

    axis: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    above: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = np.flatnonzero(self.axis[at] >= 0)
            if not len(inner):
                return self.below[at]
            node = at[inner]
            at[inner] = np.where(x[inner, self.axis[node]] <= self.cut[node], self.below[node], self.above[node])


def fit_tree(points: np.ndarray, weight: np.ndarray, leaves: int) -> Tree:
    """Halve the leaf with the largest sum of squares along its widest axis, at its mean, until there are `leaves` or no two points differ."""

    def spread(rows: np.ndarray) -> tuple[float, int]:
        x, w = points[rows], weight[rows][:, None]
        # equal values have no spread, whatever rounding says
        squares = np.where(x.min(0) < x.max(0), np.maximum((w * (x - (w * x).sum(0) / w.sum()) ** 2).sum(0), np.finfo(float).tiny), 0)
        axis = int(squares.argmax())
        return float(squares[axis]), axis

    axis, cut, below, above = [-1], [0.0], [0], [0]
    held = {0: np.arange(len(points))}
    heap = [(-spread(held[0])[0], 0)] if len(points) else []
    while heap and len(held) < leaves:
        size, node = heapq.heappop(heap)
        if size == 0:
            break
        rows = held.pop(node)
        along = spread(rows)[1]
        x, w = points[rows, along], weight[rows]
        mean = float((w * x).sum() / w.sum())
        at = mean if x.min() <= mean < x.max() else float(x.min())
        axis[node], cut[node] = along, at
        for side, part in ((below, rows[x <= at]), (above, rows[x > at])):
            side[node] = len(axis)
            held[len(axis)] = part
            heapq.heappush(heap, (-spread(part)[0], len(axis)))
            for values, new in ((axis, -1), (cut, 0.0), (below, 0), (above, 0)):
                values.append(new)
    for number, node in enumerate(sorted(held)):
        below[node] = number
    return Tree(np.array(axis), np.array(cut), np.array(below), np.array(above))


def merges(mean: np.ndarray, count: np.ndarray, limit: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """All merges by rising height as (one, other, height), each side named by any micro-cluster in it.

    The height is the root of twice the growth of the sum of squares. A chain of nearest neighbours ends in two that
    are each other's nearest; Ward's distance never falls by merging, so merging them at once is what the greedy order would do.
    With `limit`, a growth below which no cluster from outside can be near, only pairs under the limits of both are merged.
    """
    x, count = np.array(np.asarray(mean, float).T, order="C"), count.astype(float).copy()
    number, alive, stuck = np.arange(len(count)), np.ones(len(count), dtype=bool), np.zeros(len(count), dtype=bool)
    limit = None if limit is None else limit.copy()
    out: list[tuple[int, int, float]] = []
    chain: list[int] = []
    first, left = 0, len(count)
    while left > 1:
        if left * 2 < len(count):
            spot = np.cumsum(alive) - 1
            chain = [int(spot[i]) for i in chain]
            first = int(spot[first]) if alive[first] else 0
            x, count, number, stuck = np.ascontiguousarray(x[:, alive]), count[alive], number[alive], stuck[alive]
            limit = None if limit is None else limit[alive]
            alive = np.ones(left, dtype=bool)
        if not chain:
            while first < len(count) and (not alive[first] or stuck[first]):
                first += 1
            if first == len(count):
                break
            chain = [first]
        here = chain[-1]
        squares = np.zeros(len(count))
        for axis in x:
            apart = axis - axis[here]
            squares += apart * apart
        growth = count * count[here] / (count + count[here]) * squares
        growth[here] = np.inf
        near = int(growth.argmin())
        back = chain[-2] if len(chain) > 1 else -1
        if back >= 0 and growth[back] <= growth[near]:
            near = back
        if limit is not None and (stuck[near] or not growth[near] < limit[here]):
            # the nearest may be outside, and so may that of all whose chain leads here
            stuck[chain] = True
            chain = []
            continue
        if near != back:
            chain.append(near)
            continue
        keep, gone = min(here, near), max(here, near)
        out.append((int(number[keep]), int(number[gone]), float(np.sqrt(2 * growth[near]))))
        del chain[-2:]
        total = count[keep] + count[gone]
        x[:, keep] = (count[keep] * x[:, keep] + count[gone] * x[:, gone]) / total
        if limit is not None:
            limit[keep] = min(limit[keep], limit[gone])
        # whatever lies infinitely far away is never the nearest
        x[:, gone], alive[gone], count[keep] = np.inf, False, total
        left -= 1
    return sorted(out, key=lambda m: m[2])


def cut_merges(found: list[tuple[int, int, float]], leaves: int, clusters: int) -> np.ndarray:
    """Cluster of every leaf, named by its first leaf, after the cheapest merges that leave `clusters`."""
    root = np.arange(leaves)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    for a, b, _ in found[: max(0, leaves - max(1, clusters))]:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return np.array([top(i) for i in range(leaves)], dtype=np.int64)


def _lesser(a, b):
    return b if a is None or b is not None and b < a else a


def _named(found: list[tuple[int, int, float]], ids: list, first: list, count: list) -> tuple[list[tuple], np.ndarray]:
    """Rows (gone, keep, one, other, height, points) of merges in their order, and the last cluster of each.

    `gone` is the id of the lighter side, so that following `keep` takes no more steps than the logarithm of the points.
    """
    root, ids, first, count = list(range(len(ids))), list(ids), list(first), list(count)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    rows = []
    for a, b, height in found:
        a, b = top(a), top(b)
        if count[a] < count[b]:
            a, b = b, a
        one = _lesser(first[a], first[b])
        other = first[b] if one is first[a] else first[a]
        count[a] += count[b]
        rows.append((ids[b], ids[a], one, other, height, int(count[a])))
        root[b], first[a] = a, one
    return rows, np.array([top(i) for i in range(len(ids))], dtype=np.int64)


def _micro_clusters(points: DataFrame, columns: Sequence[str], key: str, distinct: DataFrame, few: bool) -> tuple[DataFrame, pd.DataFrame]:
    """`points` with `_leaf`, and one row per leaf: `_leaf`, `_n`, mean of every column, `_first` key. With `few`, a leaf is a distinct point."""
    most = WHOLE if few else MICRO
    seen = distinct if few else distinct.orderBy(F.xxhash64(*[F.col(q(c)) for c in columns])).limit(SAMPLE)
    sample = seen.toPandas()  # WHOLE or SAMPLE rows at most
    tree = fit_tree(sample[list(columns)].to_numpy(dtype=float), sample["_n"].to_numpy(dtype=float), most)

    @F.pandas_udf("int")
    def leaf(x: pd.DataFrame) -> pd.Series:
        return pd.Series(tree.leaves(x.to_numpy(dtype=float)))

    placed = points.withColumn("_leaf", leaf(F.struct(*[F.col(q(c)) for c in columns])))
    found = placed.groupBy("_leaf").agg(F.count(F.lit(1)).alias("_n"), *[F.avg(q(c)).alias(c) for c in columns], F.min(q(key)).alias("_first"))
    return placed, found.orderBy("_leaf").toPandas()  # WHOLE or MICRO rows at most


def boxes(points: np.ndarray, leaves: int, turn: int) -> Tree:
    """Cut the box with most points along its widest axis, near its middle, until there are `leaves`; another `turn` cuts elsewhere."""
    draw = np.random.default_rng(turn)
    axis, cut, below, above = [-1], [0.0], [0], [0]
    held = {0: np.arange(len(points))}
    heap = [(-len(points), 0)]
    while heap and len(held) < leaves:
        _, node = heapq.heappop(heap)
        rows = held[node]
        x = points[rows]
        if len(rows) < 2 or not (x.min(0) < x.max(0)).any():
            continue
        along = int(x.std(0).argmax()) if turn % 3 else int((x.std(0) * draw.uniform(0.3, 1.0, x.shape[1])).argmax())
        x = x[:, along]
        at = float(np.quantile(x, draw.uniform(0.35, 0.65)))
        at = at if at < x.max() else float((x.min() + x.max()) / 2)
        if not x.min() <= at < x.max():
            continue
        del held[node]
        axis[node], cut[node] = along, at
        for side, part in ((below, rows[x <= at]), (above, rows[x > at])):
            side[node] = len(axis)
            held[len(axis)] = part
            heapq.heappush(heap, (-len(part), len(axis)))
            for values, new in ((axis, -1), (cut, 0.0), (below, 0), (above, 0)):
                values.append(new)
    for number, node in enumerate(sorted(held)):
        below[node] = number
    return Tree(np.array(axis), np.array(cut), np.array(below), np.array(above))


@dataclass
class Bounds:
    """Of every box its number, its lowest and highest coordinates, and its smallest count."""

    box: np.ndarray
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray

    def nearest(self, x: np.ndarray, n: np.ndarray, own: int, rows: int = 1024) -> np.ndarray:
        """Below it lies no growth of any row with a cluster of another box."""
        others = self.box != own
        low, high, least = self.low[others], self.high[others], self.least[others]
        out = np.full(len(x), np.inf)
        if len(least):
            for i in range(0, len(x), rows):
                at, m = x[i : i + rows], n[i : i + rows, None]
                gap = sum(np.maximum(np.maximum(low[:, c] - at[:, c, None], at[:, c, None] - high[:, c]), 0) ** 2 for c in range(x.shape[1]))
                out[i : i + rows] = (m * least / (m + least) * gap).min(1)
        # sums and products are rounded
        return out * (1 - 1e-9)

    def pairs(self, most: dict[int, float]) -> list[tuple[int, int]]:
        """The boxes (one, other) of which a cluster in `other` may be as near as `most` to one in `one`."""
        out = []
        for i, b in enumerate(self.box.tolist()):
            gap = (np.maximum(np.maximum(self.low - self.high[i], self.low[i] - self.high), 0) ** 2).sum(1)
            near = self.least[i] * self.least / (self.least[i] + self.least) * gap * (1 - 1e-9) <= most[b]
            out += [(b, t) for t in self.box[near].tolist() if t != b]
        return out


def _boxed(clusters: DataFrame, columns: Sequence[str], number: int, turn: int) -> tuple[DataFrame, Bounds]:
    """`clusters` with `_box`, and the bounds of the boxes."""
    leaves = math.ceil(number / BOX)
    share = min(1.0, PER_BOX * leaves / number)
    bits = F.pmod(F.xxhash64(F.lit(turn), F.col("_id")), F.lit(2**30))
    sample = clusters.where(bits <= int(share * 2**30)).select(*[F.col(q(c)) for c in columns]).toPandas()  # PER_BOX rows for each box
    tree = boxes(sample.to_numpy(dtype=float), leaves, turn)

    @F.pandas_udf("int")
    def box(x: pd.DataFrame) -> pd.Series:
        return pd.Series(tree.leaves(x.to_numpy(dtype=float)))

    placed = cut_lineage(clusters.withColumn("_box", box(F.struct(*[F.col(q(c)) for c in columns]))))
    ends = [f(q(c)).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i, c in enumerate(columns)]
    found = placed.groupBy("_box").agg(*ends, F.min("_n").alias("least")).toPandas()  # one row per box
    sides = [found[[f"{name}{i}" for i in range(len(columns))]].to_numpy(dtype=float) for name in ("low", "high")]
    return placed, Bounds(found["_box"].to_numpy(), *sides, found["least"].to_numpy(dtype=float))


def _shape(columns: Sequence[str], kind: str) -> str:
    return f"_merge boolean, _id long, _n long, {', '.join(f'`{c}` double' for c in columns)}, _first {kind}, _other {kind}, _keep long, _height double, _at int"


def _inside(placed: DataFrame, bounds: Bounds, columns: Sequence[str], kind: str) -> DataFrame:
    """The clusters that are left, and rows of merges, of a round in which no pair from two boxes is merged."""
    columns = list(columns)
    fields = ["_merge", "_id", "_n", *columns, "_first", "_other", "_keep", "_height", "_at"]

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id")
        x, n = pdf[columns].to_numpy(dtype=float), pdf["_n"].to_numpy(dtype=float)
        ids, first = pdf["_id"].tolist(), pdf["_first"].tolist()
        found = merges(x, n, bounds.nearest(x, n, int(pdf["_box"].iat[0])))
        rows, top = _named(found, ids, first, pdf["_n"].tolist())
        smallest = list(first)
        for i, t in enumerate(top.tolist()):
            smallest[t] = _lesser(smallest[t], first[i])
        total, mean = np.bincount(top, n, len(n)), [np.bincount(top, n * v, len(n)) for v in x.T]
        out = []
        for i in np.unique(top).tolist():
            alone = total[i] == n[i]
            out.append((False, ids[i], int(total[i]), *[float(v) if alone else float(m[i] / total[i]) for m, v in zip(mean, x[i])], smallest[i], smallest[i], ids[i], 0.0, 0))
        zeros = [0.0] * len(columns)
        out += [(True, gone, points, *zeros, one, other, keep, height, at) for at, (gone, keep, one, other, height, points) in enumerate(rows)]
        return pd.DataFrame({f: pd.Series(list(v), dtype=object if f in ("_first", "_other") else None) for f, v in zip(fields, zip(*out))})

    return placed.repartition(len(bounds.box), "_box").groupBy("_box").applyInPandas(merged, _shape(columns, kind))


def _closest(x: np.ndarray, n: np.ndarray, ids: np.ndarray, near: np.ndarray, m: np.ndarray, names: np.ndarray, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """The smallest growth of every row with one of `near` but itself, and the smallest of the ids it is reached with; `names` rise."""
    growth, partner = np.full(len(x), np.inf), np.full(len(x), -1, np.int64)
    for i in range(0, len(x), rows):
        squares = np.zeros((len(x[i : i + rows]), len(near)))
        for c in range(x.shape[1]):
            apart = x[i : i + rows, c, None] - near[:, c]
            squares += apart * apart
        a = n[i : i + rows, None]
        found = a * m / (a + m) * squares
        found[ids[i : i + rows, None] == names] = np.inf
        best = found.argmin(1)
        growth[i : i + rows] = found[np.arange(len(best)), best]
        partner[i : i + rows] = np.where(np.isfinite(growth[i : i + rows]), names[best], -1)
    return growth, partner


def _across(placed: DataFrame, bounds: Bounds, columns: Sequence[str], kind: str) -> DataFrame:
    """Like `_inside`, for a round that merges all pairs that are each other's nearest, found by comparing near boxes pairwise.

    Of pairs with equal growth the one with the smallest ids counts as nearer, so there is always one to merge.
    """
    spark, columns = placed.sparkSession, list(columns)
    cells = f"_box int, _id long, _n long, {', '.join(f'`{c}` double' for c in columns)}"

    def parts(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
        return pdf[columns].to_numpy(dtype=float), pdf["_n"].to_numpy(dtype=float), pdf["_id"].to_numpy()

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id")
        growth, partner = _closest(*parts(pdf), *parts(pdf))
        return pdf[["_box", "_id", "_n", *columns]].assign(_growth=growth, _partner=partner)

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        asking, near = pdf[pdf["_asks"]], pdf[~pdf["_asks"]].sort_values("_id")
        if not len(asking) or not len(near):
            return pd.DataFrame({"_id": [], "_growth": [], "_partner": []})
        growth, partner = _closest(*parts(asking), *parts(near))
        out = pd.DataFrame({"_id": asking["_id"].to_numpy(), "_growth": growth, "_partner": partner})
        return out[growth <= asking["_growth"].to_numpy()]

    own = cut_lineage(placed.repartition(len(bounds.box), "_box").groupBy("_box").applyInPandas(within, f"{cells}, _growth double, _partner long"))
    most = {r["_box"]: r["g"] for r in own.groupBy("_box").agg(F.max("_growth").alias("g")).collect()}  # one row per box
    pairs = cut_lineage(spark.createDataFrame(bounds.pairs(most), "_one int, _two int"))
    rows = ["_one", "_two", "_id", "_n", *[q(c) for c in columns], "_growth"]
    both = own.join(pairs, F.col("_box") == F.col("_one")).select(*rows, F.lit(True).alias("_asks"))
    both = both.unionByName(own.join(pairs, F.col("_box") == F.col("_two")).select(*rows, F.lit(False).alias("_asks")))
    nearer = both.groupBy("_one", "_two").applyInPandas(between, "_id long, _growth double, _partner long")
    best = own.select("_id", "_growth", "_partner").unionByName(nearer).where("_partner >= 0").groupBy("_id").agg(F.min(F.struct("_growth", "_partner")).alias("b"))
    sides = [f("_id", "b._partner").alias(name) for f, name in ((F.least, "_low"), (F.greatest, "_high"))]
    edges = best.select(*sides, "b._growth").groupBy("_low", "_high").agg(F.count(F.lit(1)).alias("_both"), F.first("_growth").alias("_growth"))
    edges = cut_lineage(edges.where("_both = 2").select(F.monotonically_increasing_id().alias("_edge"), "_low", "_high", "_growth"))
    ends = edges.select("_edge", "_growth", F.explode(F.array("_low", "_high")).alias("_id")).join(placed, "_id")
    value = [F.col(q(c)) for c in columns]
    # the heavier one, and of equal ones the one with the smaller id, goes on
    rank = F.struct(F.col("_n").alias("n"), (-F.col("_id")).alias("i"), F.col("_id").alias("id"), F.col("_first").alias("f"), F.array(*value).alias("x"))
    two = ends.groupBy("_edge", "_growth").agg(F.max(rank).alias("a"), F.min(rank).alias("b"))
    total = F.col("a.n") + F.col("b.n")
    means = [((F.col("a.n") * F.col("a.x")[i] + F.col("b.n") * F.col("b.x")[i]) / total).alias(c) for i, c in enumerate(columns)]
    first = F.least("a.f", "b.f")
    other = F.when(first == F.col("a.f"), F.col("b.f")).otherwise(F.col("a.f"))
    head = [total.alias("_n")]
    grown = two.select(F.lit(False).alias("_merge"), F.col("a.id").alias("_id"), *head, *means, first.alias("_first"), first.alias("_other"), F.col("a.id").alias("_keep"), F.lit(0.0).alias("_height"), F.lit(0).alias("_at"))
    steps = two.select(
        F.lit(True).alias("_merge"), F.col("b.id").alias("_id"), *head, *[F.lit(0.0).alias(c) for c in columns], first.alias("_first"), other.alias("_other"),
        F.col("a.id").alias("_keep"), F.sqrt(2 * F.col("_growth")).alias("_height"), F.lit(0).alias("_at"),
    )
    alone = placed.join(ends.select("_id"), "_id", "left_anti").select(
        F.lit(False).alias("_merge"), "_id", "_n", *value, "_first", F.col("_first").alias("_other"), F.col("_id").alias("_keep"), F.lit(0.0).alias("_height"), F.lit(0).alias("_at")
    )
    return alone.unionByName(grown).unionByName(steps)


def _in_rounds(points: DataFrame, columns: Sequence[str], key: str, distinct: DataFrame, clusters: int) -> tuple[DataFrame, DataFrame]:
    """`ward` for more than WHOLE distinct points."""
    spark, kind = points.sparkSession, points.schema[key].dataType.simpleString()
    keys = [F.col(q(c)) for c in columns]
    single = cut_lineage(numbered(distinct))
    left, number, turn, slow = single, single.count(), 0, False
    rounds: list[DataFrame] = []
    edge = ["_id", "_keep", "_first", "_other", "_height", "_n"]
    while number > WHOLE:
        placed, bounds = _boxed(left, columns, number, turn)
        done = cut_lineage((_across if slow else _inside)(placed, bounds, columns, kind))
        rounds.append(done.where("_merge").select(*edge, F.lit(turn).alias("_turn"), "_at"))
        left = done.where("NOT _merge").select("_id", "_n", *keys, "_first")
        before, number = number, left.count()
        # a round of pairs is followed by one inside of boxes
        slow, turn = not slow and number > SLOW * before, turn + 1
    rest = left.orderBy("_id").toPandas()  # WHOLE rows at most
    found = merges(rest[list(columns)].to_numpy(dtype=float), rest["_n"].to_numpy())
    rows, _ = _named(found, rest["_id"].tolist(), rest["_first"].tolist(), rest["_n"].tolist())
    last = [(gone, keep, one, other, height, n, turn, at) for at, (gone, keep, one, other, height, n) in enumerate(rows)]
    steps = spark.createDataFrame(last, f"_id long, _keep long, _first {kind}, _other {kind}, _height double, _n long, _turn int, _at int")
    for part in rounds:
        steps = steps.unionByName(part)
    steps = cut_lineage(steps.withColumn("_all", F.lit(0)))
    order = ["_height", "_turn", "_at", "_id"]
    steps = cut_lineage(ordered_window(steps, ["_all"], order, row_number="_step"))
    # without the highest merges, following what is kept leads to a point of the cluster
    high = [r["_id"] for r in steps.orderBy(F.desc("_step")).limit(max(0, clusters - 1)).select("_id").collect()]  # one row per cluster
    links = cut_lineage(steps.where(~F.col("_id").isin(high)).select("_id", "_keep"))
    total = single.agg(F.sum("_n").alias("n")).first()["n"]
    for _ in range(max(1, math.ceil(math.log2(math.log2(total) + 1)))):
        beyond = links.select(F.col("_id").alias("_keep"), F.col("_keep").alias("_next"))
        links = cut_lineage(links.join(beyond, "_keep", "left").select("_id", F.coalesce("_next", "_keep").alias("_keep")))
    named = single.join(links, "_id", "left").withColumn("_top", F.coalesce("_keep", "_id"))
    named = cut_lineage(named.select(*keys, "_first", "_top"))
    smallest = named.groupBy("_top").agg(F.min("_first").alias("_s")).collect()  # one row per cluster
    order = sorted(smallest, key=lambda r: (r["_s"] is not None, r["_s"], r["_top"]))
    names = spark.createDataFrame([(r["_top"], i) for i, r in enumerate(order)], "_top long, cluster int")
    labels = points.join(named.join(F.broadcast(names), "_top").select(*keys, "cluster"), list(columns)).select(F.col(q(key)), "cluster")
    shown = (F.col("_step") - 1).cast("int").alias("step")
    return labels, steps.select(shown, F.col("_first").alias("one"), F.col("_other").alias("other"), F.col("_height").alias("height"), F.col("_n").alias("points"))


def ward(points: DataFrame, columns: Sequence[str], key: str, clusters: int = 4) -> tuple[DataFrame, DataFrame]:
    """Labels (`key`, `cluster`) of points without nulls, and the merges (`step`, `one`, `other`, `height`, `points`).

    Clusters are numbered from 0 by their smallest key; `one` and `other` are the smallest keys of the two that merge. Equal
    merge heights are taken in the order of the tree's leaves, or of rounds. With fewer distinct points than `clusters`, each is a cluster.
    """
    kind = points.schema[key].dataType.simpleString()
    spark = points.sparkSession
    shape = f"step int, one {kind}, other {kind}, height double, points long"
    distinct = cut_lineage(points.groupBy(*[F.col(q(c)) for c in columns]).agg(F.count(F.lit(1)).alias("_n"), F.min(q(key)).alias("_first")))
    few = distinct.limit((MICRO or WHOLE) + 1).count() <= (MICRO or WHOLE)
    if not few and MICRO is None:
        return _in_rounds(points, columns, key, distinct, clusters)
    placed, leaves = _micro_clusters(points, columns, key, distinct, few)
    if not len(leaves):
        return points.select(F.col(q(key)), F.lit(0).alias("cluster")), spark.createDataFrame([], shape)
    number = leaves["_leaf"].tolist()
    found = merges(leaves[list(columns)].to_numpy(dtype=float), leaves["_n"].to_numpy())
    rows, _ = _named(found, number, leaves["_first"].tolist(), leaves["_n"].tolist())
    steps = [(step, one, other, height, size) for step, (_, _, one, other, height, size) in enumerate(rows)]
    group = cut_merges(found, len(leaves), clusters)
    smallest: dict[int, object] = {}
    for i, g in enumerate(group.tolist()):
        smallest[g] = min(smallest.get(g, leaves["_first"].iat[i]), leaves["_first"].iat[i])
    order = {g: n for n, g in enumerate(sorted(smallest, key=smallest.__getitem__))}
    names = spark.createDataFrame([(int(leaf), order[g]) for leaf, g in zip(number, group.tolist(), strict=True)], "_leaf int, cluster int")
    labels = placed.join(F.broadcast(names), "_leaf").select(F.col(q(key)), "cluster")  # WHOLE or MICRO rows at most
    return labels, spark.createDataFrame(steps, shape)
