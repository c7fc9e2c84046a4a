"""Random forests whose tasks hold a bounded part of one tree.

No tree can tell rows apart whose columns fall into the same bins, so rows are a cell for each combination of bins that occurs. A tree is
grown from the sums of its cells, and answers one question for each cell that holds rows to be scored. If no more than NODE_ROWS cells occur, one task
grows a few whole trees of a fit. Otherwise rows are sent to nodes level by level, with histograms added up by Spark, while a node has more
than NODE_ROWS rows, and then each node's cells are sent to one task, which grows the rest of its tree. The trees, which
may have as many leaves as there are cells, are never gathered.

Bootstrap weights are Poisson, splits are binary between at most BINS quantile bins, the gain is that of variance or Gini impurity, and
a leaf answers with its mean or its class shares: the same forest as the engine's, from other random draws.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.exprs import q
from lectern.session import bucket_count, cut_lineage

BINS = 32
#: Rows from which the candidates for splits are taken.
SPLIT_ROWS = 10_000
#: Cells, or rows of a node, that one task may finish, times the statistics of a cell.
NODE_ROWS = 500_000
#: Trees of a fit that one task may grow one after another, and the cells it may hold for that.
BUNCH, BUNCH_CELLS = 10, 1_000_000
#: The fit on the training part; fits of folds have the number of their fold.
MAIN = -1

#: A gain that is a smaller share of the squared labels is rounding.
NOISE = 1e-12

#: Bits of the whole numbers as which labels are summed where nodes have few rows; the rows take their part of them.
SUM_BITS = 62

POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def _mix(x: np.ndarray) -> np.ndarray:
    """Bits that look random, from 64 bit numbers."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _weights(hashes: np.ndarray, tree: int) -> np.ndarray:
    """How often each row is drawn for a tree; the same for any partitioning."""
    draw = _mix(hashes ^ _mix(np.array([tree + 1], np.uint64))) >> np.uint64(11)
    return np.searchsorted(POISSON, draw * 2.0**-53, side="right").astype(np.int32)


def _picks(nodes: np.ndarray, tree: int, columns: int, chosen: int) -> np.ndarray:
    """The columns that may split each node."""
    if chosen >= columns:
        return np.tile(np.arange(columns), (len(nodes), 1))
    start = _mix(nodes.astype(np.uint64) ^ _mix(np.array([tree + 1], np.uint64)))
    return np.argsort(_mix(start[:, None] + np.arange(columns, dtype=np.uint64)), 1)[:, :chosen]


def _cells(place: np.ndarray, y: np.ndarray, w: np.ndarray, places: int, classes: int) -> np.ndarray:
    """Per place the class counts, or count and sum of the label."""
    if classes:
        return np.bincount(place * classes + y.astype(np.int64), w, places * classes).reshape(places, classes)
    return np.stack([np.bincount(place, w, places), np.bincount(place, w * y, places)], 1)


def _size(x: np.ndarray, classes: int) -> np.ndarray:
    return x.sum(-1) if classes else x[..., 0]


def _purity(x: np.ndarray, classes: int) -> np.ndarray:
    return (x * x).sum(-1) / x.sum(-1) if classes else x[..., 1] ** 2 / x[..., 0]


def _best(cells: np.ndarray, classes: int, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best bin to split after, and its gain times the rows, for cells of shape (nodes, BINS, statistics).

    The first of the bins whose gains differ by rounding only, so that the order of the rows does not matter.
    """
    left = np.cumsum(cells, 1)
    every = left[:, -1:]
    left = left[:, :-1]
    right = every - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = _purity(left, classes) + _purity(right, classes) - _purity(every, classes)
    gain[(_size(left, classes) <= 0) | (_size(right, classes) <= 0)] = -np.inf
    cut = (gain >= gain.max(1, keepdims=True) - slack[:, None]).argmax(1)
    return cut, gain[np.arange(len(gain)), cut]


def _best_sorted(
    node: np.ndarray, bins: np.ndarray, running: list[np.ndarray], totals: list[np.ndarray], scale: float, classes: int, slack: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes that a column can split, and as `_best` the bin to split after and its gain: only the cells that hold rows are built.

    Rows come by node and bin, with the running sums of their statistics; `totals` are the sums of the nodes, 0 for one without rows here.
    Sums are whole numbers, so differences are exact; those of labels are in units of `scale`.
    """
    ends = np.flatnonzero((bins[1:] != bins[:-1]) & (node[1:] == node[:-1]))
    if not len(ends):
        return ends, ends, np.zeros(0)
    at = node.take(ends)
    lower, whole = np.empty((2, len(totals), len(ends)))
    for k, (run, total) in enumerate(zip(running, totals)):
        lower[k] = run.take(ends) - (np.cumsum(total) - total).take(at)
        whole[k] = total.take(at)
    if not classes:
        lower[1] *= scale
        whole[1] *= scale
    gain = _purity(lower.T, classes) + _purity((whole - lower).T, classes) - _purity(whole.T, classes)
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    found = at.take(starts)
    least = np.zeros(len(slack))
    least[found] = np.maximum.reduceat(gain, starts) - slack.take(found)
    good = np.flatnonzero(gain >= least.take(at))
    nodes = at.take(good)
    first = good[np.append(True, nodes[1:] != nodes[:-1])]
    return found, bins.take(ends.take(first)).astype(np.int64), gain.take(first)


def _best_occupied(
    at: np.ndarray, bins: np.ndarray, stats: np.ndarray, places: int, classes: int, slack: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """`_best_sorted` for rows in any order."""
    order = np.lexsort((bins, at))
    totals = np.zeros((places, stats.shape[1]), np.int64)
    np.add.at(totals, at, stats)
    found, cuts, gains = _best_sorted(at[order], bins[order], list(np.cumsum(stats[order], 0).T), list(totals.T), 1.0, classes, slack)
    cut, gain = np.zeros(places, np.int64), np.full(places, -np.inf)
    cut[found], gain[found] = cuts, gains
    return cut, gain


def _answer(cells: np.ndarray, classes: int) -> np.ndarray:
    return cells / cells.sum(-1, keepdims=True) if classes else cells[:, 1:] / cells[:, :1]


def _alike(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts rows of equal bins together, and where each new one begins."""
    order = np.lexsort(bins.T)
    by = bins[order]
    return order, np.flatnonzero(np.append(True, (by[1:] != by[:-1]).any(1))[: len(by)])


def grow(
    bins: np.ndarray, y: np.ndarray, w: np.ndarray, asked: np.ndarray, root: int, tree: int, classes: int, chosen: int, depth: int
) -> tuple[np.ndarray, np.ndarray]:
    """Answers of one tree below `root` for the rows `asked`, and the gains of its columns.

    Nodes have the number of their path: the children of n are 2n and 2n + 1. Rows of equal bins go the same way in any tree, so
    the tree is grown from one sum for each combination of bins that occurs, and rows of equal bins share an answer.
    """
    columns = bins.shape[1]
    same, heads = _alike(asked)
    asked = asked[same[heads]]
    answers, gains = np.zeros((len(asked), classes or 1)), np.zeros(columns)
    nodes, level = np.array([root], np.int64), root.bit_length() - 1
    spot, rows = np.zeros(len(asked), np.int64), np.arange(len(asked))
    # labels are summed as whole numbers, so that sums of neighbouring rows are differences of running sums
    bits = SUM_BITS - int(w.sum()).bit_length()
    unit = 1.0 if classes else 2.0 ** min(bits - math.frexp(float(np.abs(y).max(initial=0)) or 1.0)[1], 400)
    w = w.astype(np.int64)
    stats = [w * (y == k) for k in range(classes)] if classes else [w, w * np.rint(y * unit).astype(np.int64)]
    worth = w.astype(float) if classes else w * y * y
    order, begins = _alike(bins)
    stats, worth = [np.add.reduceat(x.take(order), begins) for x in stats], np.add.reduceat(worth.take(order), begins)
    by, size = np.ascontiguousarray(bins[order[begins]].T), len(begins)
    # the rows of every node along each column: sorted once, and kept in order when nodes are split
    turns = [np.argsort(x, kind="stable") for x in by]
    starts = np.zeros(1, np.int64)
    while len(nodes):
        n, here = len(nodes), turns[0]
        sizes = np.diff(np.append(starts, len(here)))
        node = np.repeat(np.arange(n), sizes)
        totals = [np.add.reduceat(x.take(here), starts) for x in stats]
        every = np.stack([totals[0], totals[1] / unit], 1) if not classes else np.stack(totals, 1).astype(float)
        slack = NOISE * np.add.reduceat(worth.take(here), starts)
        cut, column, best = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -np.inf)
        # a node of one class or one row is not split
        mixed = (every > 0).sum(1) > 1 if classes else sizes > 1
        if level < depth and mixed.any():
            picks, every_node = _picks(nodes, tree, columns, chosen), np.arange(n)
            cuts, tops = np.zeros((columns, n), np.int64), np.full((columns, n), -np.inf)
            for c in range(columns):
                wanted = mixed & (picks == c).any(1) if chosen < columns else mixed
                at, turn, sums = node, turns[c], totals
                if not wanted.all():
                    some = np.flatnonzero(wanted.take(node))
                    at, turn, sums = node.take(some), turn.take(some), [x * wanted for x in totals]
                found, after, gain = _best_sorted(at, by[c].take(turn), [np.cumsum(x.take(turn)) for x in stats], sums, 1.0 / unit, classes, slack)
                cuts[c, found], tops[c, found] = after, gain
            for s in range(picks.shape[1]):
                of = picks[:, s]
                gain = tops[of, every_node]
                better = gain > best + slack
                cut[better], column[better], best[better] = cuts[of, every_node][better], of[better], gain[better]
        split = best > slack
        gains += np.bincount(column[split], best[split], columns)
        ended = ~split[spot]
        answers[rows[ended]] = _answer(every, classes)[spot[ended]]
        # two places for every node that is split
        first = np.cumsum(split) * 2 - 2
        nodes = np.stack([2 * nodes[split], 2 * nodes[split] + 1], 1).ravel()
        rows, spot = rows[~ended], spot[~ended]
        spot = first[spot] + (asked[rows, column[spot]] > cut[spot])
        going = np.flatnonzero(split.take(node))
        node, here = node.take(going), here.take(going)
        above = np.zeros(size, np.int64)
        ups = (by.take(column.take(node) * size + here) > cut.take(node)).astype(np.int64)
        above[here] = ups
        uppers = np.bincount(node, ups, n).astype(np.int64)
        lowers = np.where(split, sizes - uppers, 0)
        children = np.stack([lowers, uppers], 1)[split].ravel()
        starts = np.cumsum(children) - children
        # a lower row follows all upper rows of the nodes before, an upper row all lower ones up to those of its own node
        uppers_before, lowers_upto = (np.cumsum(uppers) - uppers).take(node), np.cumsum(lowers).take(node)
        place = np.arange(len(node)) + uppers_before
        shift = lowers_upto - 1 - place
        for c in range(columns):
            turn = turns[c].take(going)
            up = above.take(turn)
            run = np.cumsum(up)
            turns[c] = np.empty_like(turn)
            turns[c][place - run + up * (shift + 2 * run)] = turn
        level += 1
    out = np.empty((len(same), classes or 1))
    out[same] = np.repeat(answers, np.diff(np.append(heads, len(same))), 0)
    return out, gains


def split_points(values: np.ndarray) -> np.ndarray:
    """At most BINS - 1 candidates: between all distinct values if they are few, else between quantiles."""
    distinct, counts = np.unique(values, return_counts=True)
    if len(distinct) > BINS:
        marks = np.arange(1, BINS) * len(values) / BINS
        ends = np.unique(np.searchsorted(np.cumsum(counts), marks).clip(0, len(distinct) - 2))
    else:
        ends = np.arange(len(distinct) - 1)
    return distinct[ends] / 2 + distinct[ends + 1] / 2


class _Top:
    """The nodes of all trees above those that a task finishes: per fit and tree sorted node numbers, columns and bins of splits, and leaves."""

    def __init__(self) -> None:
        self.splits: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.leaves: dict[tuple[int, int], dict[int, list[float]]] = {}

    def route(self, key: tuple[int, int], bins: np.ndarray) -> np.ndarray:
        at = np.ones(len(bins), np.int64)
        if key not in self.splits:
            return at
        nodes, columns, cuts = self.splits[key]
        moving = np.arange(len(bins))
        while len(moving):
            place = np.searchsorted(nodes, at[moving]).clip(0, len(nodes) - 1)
            hit = nodes[place] == at[moving]
            moving, place = moving[hit], place[hit]
            at[moving] = 2 * at[moving] + (bins[moving, columns[place]] > cuts[place])
        return at


def _decoded(pdf: pd.DataFrame, columns: int) -> tuple[np.ndarray, ...]:
    bins = np.frombuffer(b"".join(pdf["_bins"]), np.uint8).reshape(-1, columns)
    return bins, pdf["_hash"].to_numpy().view(np.uint64), pdf["label"].to_numpy(), pdf["_fold"].to_numpy(), pdf["_test"].to_numpy().astype(bool)


def _record(columns: int) -> np.dtype:
    # a cell to learn from has a tree, a weight and its (mean) label, a cell to be scored no weight and its number
    return np.dtype([("v", np.float64), ("w", np.int32), ("t", np.uint16), ("b", np.uint8, (columns,))])


def _above(
    table: DataFrame, top: _Top, wide: set[tuple[int, int, int]], columns: int, classes: int, trees: int, fits: Sequence[int], chosen: int, worth: float
) -> DataFrame:
    """The best split of every node in `wide`, from histograms added up over all partitions."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for pdf in batches:
            bins, hashes, y, folds, test = _decoded(pdf, columns)
            for tree in range(trees):
                drawn = _weights(hashes, tree)
                for fit in fits:
                    mine = np.flatnonzero((drawn > 0) & (~test if fit == MAIN else folds != fit))
                    at = top.route((fit, tree), bins[mine])
                    for node in np.unique(at).tolist():
                        if (fit, tree, node) not in wide:
                            continue
                        here = mine[at == node]
                        found = np.stack([_cells(bins[here, c].astype(np.int64), y[here], drawn[here], BINS, classes) for c in range(columns)])
                        key = (fit, tree, node)
                        sums[key] = sums[key] + found if key in sums else found.astype(float)
        if sums:
            keys = list(zip(*sums))
            yield pd.DataFrame({"fit": keys[0], "tree": keys[1], "node": keys[2], "cells": [s.tobytes() for s in sums.values()]})

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = sum(np.frombuffer(c) for c in pdf["cells"]).reshape(columns, BINS, -1)
        fit, tree, node = (int(pdf[c].iloc[0]) for c in ("fit", "tree", "node"))
        slack = NOISE * worth * _size(cells.sum(1), classes)
        cut, gain = _best(cells, classes, slack)
        allowed = _picks(np.array([node]), tree, columns, chosen)[0]
        best = int(allowed[np.argmax(gain[allowed] >= gain[allowed].max() - slack[0])])
        left, every = cells[best, : cut[best] + 1].sum(0), cells[best].sum(0)
        sizes = [float(_size(x, classes)) for x in (left, every - left)]
        return pd.DataFrame([(fit, tree, node, best, int(cut[best]), float(gain[best]), *sizes, _answer(every[None], classes)[0].tolist())], columns=["fit", "tree", "node", "best", "cut", "gain", "left", "right", "answer"])

    counted = table.mapInPandas(count, "fit int, tree int, node long, cells binary")
    return counted.groupBy("fit", "tree", "node").applyInPandas(
        choose, "fit int, tree int, node long, best int, cut int, gain double, left double, right double, answer array<double>"
    )


def forest(
    data: DataFrame, columns: Sequence[str], folds: int, classes: int = 0, trees: int = 100, depth: int = 30, seed: int = 42,
    score_all: bool = False, node_rows: int = NODE_ROWS,
) -> tuple[DataFrame, np.ndarray]:
    """Fit on the rows without `_test` and, for each fold, on the rows of the other folds.

    `data` is a table with `_id` (unique), `_key`, `label`, `_test`, `_fold` and the columns. Returns its rows with `prediction` (and, for
    classes, `rawPrediction` and `probability`) and `_fit`: MAIN for the test rows (or all rows), a fold's number for the rows of that
    fold. Also the importances of the columns in the fit on the training part. Classes are numbered from 0; none means regression.
    Candidates for splits come from the columns, not the labels, of at most about SPLIT_ROWS rows to learn from.
    """
    spark, width = data.sparkSession, len(columns)
    chosen = math.ceil(math.sqrt(width)) if classes else width
    fits = [MAIN, *range(folds)]
    hashed = data.withColumn("_hash", F.xxhash64(F.lit(seed), F.col("_key").cast("string"), *[F.col(q(c)) for c in columns], F.col("label")))
    facts = data.where(~F.col("_test")).agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("mean"), F.var_pop("label").alias("spread")).first()
    if not facts["n"] or not columns:
        raise ValueError("a forest needs rows to learn from, and columns")
    share = min(1.0, SPLIT_ROWS / facts["n"])
    sampled = hashed.where(~F.col("_test") & (F.pmod(F.col("_hash"), F.lit(2**30)) <= int(share * 2**30))).select(*[F.col(q(c)) for c in columns])
    points = [split_points(x) for x in sampled.toPandas().to_numpy(float).T]  # about SPLIT_ROWS rows
    middle, worth = (0.0, 1.0) if classes else (facts["mean"], facts["spread"])

    @F.pandas_udf(T.BinaryType())
    def binned(values: pd.DataFrame) -> pd.Series:
        found = np.empty(values.shape, np.uint8)
        for c, p in enumerate(points):
            found[:, c] = np.searchsorted(p, values.iloc[:, c].to_numpy())
        return pd.Series([r.tobytes() for r in found], dtype=object)

    parts = max(bucket_count(spark), 2 * spark.sparkContext.defaultParallelism)
    cells = F.struct(*[F.col(q(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    slim = hashed.select("_id", "_hash", (F.col("label") - middle).alias("label"), F.col("_fold").cast("int").alias("_fold"), "_test", binned(cells).alias("_bins"))
    slim = cut_lineage(slim)
    names = cut_lineage(slim.groupBy("_bins").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_cell", F.monotonically_increasing_id()))
    known = names.agg(F.count(F.lit(1)).alias("cells"), F.sum("_rows").alias("rows")).first()
    # a cell with more rows than a task's share is dealt over tasks
    dealt = F.when(F.col("_rows") > known["rows"] / parts, F.pmod("_hash", F.lit(parts))).otherwise(0)
    table = cut_lineage(slim.join(names, "_bins").repartition(parts, "_cell", dealt).sortWithinPartitions("_cell").drop("_rows"))

    top, limit = _Top(), node_rows * 2 // max(classes, 2)
    whole = known["cells"] <= limit
    bunch = max(1, min(BUNCH, BUNCH_CELLS // known["cells"])) if whole else 1
    sizes = {} if whole else {(f, t, 1): facts["n"] * 0.7 for f in fits for t in range(trees)}  # a tree draws 63 % of the rows
    gained: dict[int, np.ndarray] = {t: np.zeros(width) for t in range(trees)}
    while wide := {k for k, n in sizes.items() if n > limit}:
        sizes = {}
        # one small row for each node that is too large for a task
        for r in _above(table, top, wide, width, classes, trees, fits, chosen, worth).collect():
            key, node = (r["fit"], r["tree"]), r["node"]
            if not r["gain"] > NOISE * worth * (r["left"] + r["right"]) or node.bit_length() > depth:
                top.leaves.setdefault(key, {})[node] = r["answer"]
                continue
            old = top.splits.get(key, (np.zeros(0, np.int64),) * 3)
            new = [np.append(a, b) for a, b in zip(old, (node, r["best"], r["cut"]))]
            order = np.argsort(new[0])
            top.splits[key] = tuple(a[order] for a in new)
            sizes |= {(*key, 2 * node): r["left"], (*key, 2 * node + 1): r["right"]}
            if r["fit"] == MAIN:
                gained[r["tree"]][r["best"]] += r["gain"]
    record = _record(width)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf.sort_values(["_cell", "label"] if classes else "_cell")
            bins, hashes, y, fold, test = _decoded(pdf, width)
            cell = pdf["_cell"].to_numpy()
            new = np.append(True, cell[1:] != cell[:-1])
            heads = np.flatnonzero(new | np.append(True, y[1:] != y[:-1]) if classes else new)
            drawn = [_weights(hashes, t) for t in range(trees)]
            for fit in fits:
                rows: list[tuple] = []
                learn = ~test if fit == MAIN else fold != fit
                wanted = np.flatnonzero(np.ones(len(test), bool) if fit == MAIN and score_all else test if fit == MAIN else fold == fit)
                wanted = wanted[np.append(True, np.diff(cell[wanted]) != 0)[: len(wanted)]]
                asked = np.zeros(len(wanted), record)
                asked["v"], asked["b"] = cell[wanted].view(np.float64), bins[wanted]
                for start in range(0, trees, bunch):
                    found = [asked]
                    for t in range(start, min(start + bunch, trees)):
                        w = drawn[t] * learn
                        size = np.add.reduceat(w, heads)
                        some = np.flatnonzero(size)
                        out = np.empty(len(some), record)
                        # labels of a cell are one label, or count as their mean
                        out["v"] = y[heads[some]] if classes else np.add.reduceat(w * y, heads)[some] / size[some]
                        out["w"], out["t"], out["b"] = size[some], t, bins[heads[some]]
                        found.append(out)
                    out = np.concatenate(found)
                    at, leaves = top.route((fit, start), out["b"]), top.leaves.get((fit, start), {})
                    if (fit, start) in top.splits or leaves:
                        for node in np.unique(at).tolist():
                            here = out[at == node]
                            if node not in leaves:
                                rows.append((fit, start, node, 0, here.tobytes()))
                                continue
                            # a leaf has its answer, so what it is asked is dealt over tasks
                            here = here[here["w"] == 0]
                            piece = np.ascontiguousarray(here["v"]).view(np.int64) % parts
                            rows += [(fit, start, node, int(k), here[piece == k].tobytes()) for k in np.unique(piece)]
                    else:
                        rows.append((fit, start, 1, 0, out.tobytes()))
                yield pd.DataFrame(rows, columns=["fit", "tree", "node", "piece", "rows"])

    votes = [f"p{k}" for k in range(classes or 1)]

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        fit, tree, node = (int(pdf[c].iloc[0]) for c in ("fit", "tree", "node"))
        rows = np.frombuffer(b"".join(pdf["rows"]), record)
        learn, asked = rows[rows["w"] > 0], rows[rows["w"] == 0]
        # a cell whose rows are dealt over batches or tasks asks more than once
        numbers, once = np.unique(np.ascontiguousarray(asked["v"]).view(np.int64), return_index=True)
        asked = asked["b"][once]
        leaf = top.leaves.get((fit, tree), {}).get(node)
        answers, gains = np.zeros((len(asked), len(votes))), {t: np.zeros(width) for t in range(tree, min(tree + bunch, trees))}
        for t in gains:
            mine = learn[learn["t"] == t]
            if leaf is not None:
                answers += leaf
            elif len(mine):  # else a tree that draws no row at all
                found, gains[t] = grow(mine["b"], mine["v"], mine["w"], asked, node, t, classes, chosen, depth)
                answers += found
        out = pd.DataFrame(answers, columns=votes).assign(fit=fit, tree=-1, number=numbers)
        if fit == MAIN:
            extra = [pd.DataFrame(0.0, index=range(width), columns=votes).assign(p0=g, fit=fit, tree=t, number=range(width)) for t, g in gains.items()]
            out = pd.concat([out, *extra])
        return out[["fit", "tree", "number", *votes]]

    keys = ["fit", "tree", "node", "piece"]
    pieces = table.mapInPandas(deal, "fit int, tree int, node long, piece int, rows binary").repartition(4 * parts, *keys)
    answers = pieces.groupBy(*keys).applyInPandas(finish, f"fit int, tree int, number long, {', '.join(f'{v} double' for v in votes)}")
    summed = cut_lineage(answers.groupBy("fit", "tree", "number").agg(*[F.sum(v).alias(v) for v in votes]))
    for r in summed.where(F.col("tree") >= 0).collect():  # one row per tree and column
        gained[r["tree"]][r["number"]] += r["p0"]
    shares = sum((g / g.sum() for g in gained.values() if g.sum() > 0), np.zeros(width))
    scored = F.array(F.when(F.col("_test") | F.lit(score_all), F.lit(MAIN)), F.when(F.col("_fold") < folds, F.col("_fold")))
    asking = table.select("_id", "_cell", F.explode(F.array_compact(scored)).alias("_fit"))
    found = summed.where(F.col("tree") < 0).select(F.col("number").alias("_cell"), F.col("fit").alias("_fit"), *votes)
    return _scored(data, asking.join(found, ["_cell", "_fit"]).drop("_cell"), votes, classes, trees, middle), shares / (shares.sum() or 1.0)


def _scored(data: DataFrame, found: DataFrame, votes: list[str], classes: int, trees: int, middle: float) -> DataFrame:
    joined = data.join(found, "_id")
    if not classes:
        return joined.withColumn("prediction", F.col("p0") / trees + F.lit(float(middle))).drop(*votes)
    raw, every = F.array(*votes), sum((F.col(v) for v in votes[1:]), F.col(votes[0]))
    chance = F.array(*[F.col(v) / every for v in votes])
    return joined.withColumns(
        {
            "rawPrediction": array_to_vector(raw), "probability": array_to_vector(chance),
            "prediction": (F.array_position(raw, F.array_max(raw)) - 1).cast("double"),
        }
    ).drop(*votes)
