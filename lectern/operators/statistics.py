"""Distribution statistics, correlation matrices and hypothesis tests."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.exprs import numeric_columns, q, rounded, significance_text
from lectern.functions.ordering import exact_quantiles_of, prefix_sums
from lectern.functions.pvalues import f_p_value, t_p_value
from lectern.session import cut_lineage

# Columns of the published summary table.
SUMMARY_COLUMNS = ["count", "mean", "std", "min", "q25", "median", "q75", "max", "skew", "kurtosis"]


def _value(df: DataFrame, c: str) -> Column:
    v = F.col(q(c)).cast("double")
    return F.when(F.isnan(v), None).otherwise(v)


def _moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One aggregate over all columns, reshaped to one row per column.

    Skew and kurtosis carry the small-sample correction; they are 0 for a constant column
    and null for fewer than 3 (or 4) values.
    """
    aggs = []
    for i, c in enumerate(columns):
        v = _value(df, c)
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.avg(v).alias(f"a{i}"),
            F.stddev_samp(v).alias(f"s{i}"),
            F.skewness(v).alias(f"g{i}"),
            F.kurtosis(v).alias(f"k{i}"),
            F.min(v).alias(f"l{i}"),
            F.max(v).alias(f"h{i}"),
        ]

    def cell(i: int, c: str) -> Column:
        n = F.col(f"n{i}").cast("double")
        flat = F.col(f"l{i}") == F.col(f"h{i}")
        skew = F.when(flat, 0.0).otherwise(F.col(f"g{i}") * F.sqrt(n * (n - 1)) / (n - 2))
        kurt = ((n + 1) * F.col(f"k{i}") + 6) * (n - 1) / ((n - 2) * (n - 3))
        return F.struct(
            F.lit(c).alias("feature"),
            F.col(f"n{i}").alias("count"),
            F.col(f"a{i}").alias("mean"),
            F.when(n > 1, F.col(f"s{i}")).alias("std"),
            F.when(n > 2, skew).alias("skew"),
            F.when(n > 3, F.when(flat, 0.0).otherwise(kurt)).alias("kurtosis"),
            F.col(f"l{i}").alias("min"),
            F.col(f"h{i}").alias("max"),
        )

    row = df.agg(*aggs)
    return row.select(F.inline(F.array(*[cell(i, c) for i, c in enumerate(columns)])))


def describe(df: DataFrame, columns: Sequence[str], quantiles: bool = True) -> DataFrame:
    """Moments, extremes and exact quartiles; one row per column."""
    base = _moments(df, columns)
    if not quantiles:
        return base
    parts = exact_quantiles_of(
        df.select(*[_value(df, c).alias(c) for c in columns]), columns, {"q25": 0.25, "median": 0.5, "q75": 0.75}
    )
    return base.join(F.broadcast(parts), "feature", "left")  # one row per column


def distributions(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Statistics of the numeric columns that have values."""
    chosen = [c for c in columns if c in df.columns] if columns else numeric_columns(df)
    return describe(df, chosen).where(F.col("count") > 0)


def summary_table(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 3) -> DataFrame:
    stats = describe(df, columns or numeric_columns(df))
    return stats.select("feature", *[rounded(c, digits).alias(c) for c in SUMMARY_COLUMNS])


def format_table(df: DataFrame, digits: int = 3) -> DataFrame:
    """Round numbers; p-values become text with significance stars."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType) and "p_value" in f.name:
            out.append(significance_text(q(f.name), digits).alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(rounded(q(f.name), digits).alias(f.name))
        else:
            out.append(F.col(q(f.name)))
    return df.select(*out)


def _pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


def correlation_matrix(pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long (a, b, r) rows to a square matrix with a `feature` column; at most one row per pair."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    cells = [F.max(F.when(F.col("b") == c, F.col("r"))).alias(c) for c in columns]
    wide = both.groupBy(F.col("a").alias("feature")).agg(*cells)
    return wide.select(
        "feature", *[F.when(F.col("feature") == c, 1.0).otherwise(F.col(q(c))).alias(c) for c in columns]
    )


def pearson_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairs in one aggregate; each uses the rows where both values are known."""
    pairs = _pairs(columns)
    aggs = []
    for i, (a, b) in enumerate(pairs):
        known = F.col(q(a)).isNotNull() & F.col(q(b)).isNotNull()
        aggs.append(F.corr(F.when(known, _value(df, a)), F.when(known, _value(df, b))).alias(f"r{i}"))
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(~F.isnan(f"r{i}"), F.col(f"r{i}")).alias("r"))
        for i, (a, b) in enumerate(pairs)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


#: Digits of ranks count up to this, so that no table of cells has more than its square of rows, whatever the data are.
RANK_BASE = 1024


def _ranked_rows(df: DataFrame, columns: Sequence[str], partners: bool) -> DataFrame:
    """One row per input row with `s`, an array of (f, dense, ranks) for each of its known values, by column number.

    `dense` counts the smaller distinct values of the column. With `partners`, `ranks[g]` is the rank among the rows that
    know column g too, minus the mean rank; ties share their average rank. All columns are ranked together in long form, so
    the number of passes over the data does not depend on the number of columns or pairs.
    """
    known = [_value(df, c) for c in columns]
    sides = [F.col(f"p{i}") for i in range(len(columns))] if partners else []
    wide = df.select(
        F.monotonically_increasing_id().alias("_row"),
        *[v.alias(f"v{i}") for i, v in enumerate(known)],
        *[v.isNotNull().cast("int").alias(f"p{i}") for i, v in enumerate(known) if partners],
    )
    # written, so that a row keeps its number if a task is run again
    wide = cut_lineage(wide)
    cells = wide.select(
        "_row", *sides, F.inline(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"v{i}").alias("value")) for i in range(len(columns))]))
    ).where(F.col("value").isNotNull())
    counts = [f"c{i}" for i in range(len(columns)) if partners]
    hist = cells.groupBy("f", "value").agg(F.lit(1).alias("one"), *[F.sum(f"p{i}").alias(c) for i, c in enumerate(counts)])
    ranked = prefix_sums(cut_lineage(hist), "value", ["one", *counts], ["f"])
    rank = [F.col(f"_before_{c}") + (F.col(c) + 1) / 2 - (F.col(f"_all_{c}") + 1) / 2 for c in counts]
    ranks = ranked.select("f", "value", F.col("_before_one").alias("dense"), F.array(*rank).alias("ranks"))
    joined = cells.select("_row", "f", "value").join(ranks, ["f", "value"])
    return joined.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("f", "dense", "ranks"))).alias("s"))


def _row_pairs(rows: DataFrame) -> DataFrame:
    """`a`, `b` (column numbers) and `x`, `y` for every two known values of a row."""
    found = F.expr(
        "flatten(transform(s, (x, i) -> transform(slice(s, i + 2, size(s)), y -> struct(x.f AS a, y.f AS b, x AS x, y AS y))))"
    )
    return rows.select(F.inline(found))


def _all_pairs(df: DataFrame, found: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`a`, `b`, `r` for all pairs of column names; r is null where no row knows both."""
    names = [F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), F.lit(columns[i]).alias("_a"), F.lit(columns[j]).alias("_b")) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    pairs = df.sparkSession.range(1).select(F.inline(F.array(*names)))
    return pairs.join(F.broadcast(found), ["a", "b"], "left").select(F.col("_a").alias("a"), F.col("_b").alias("b"), "r")  # one row per pair


def spearman_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rank correlations of all pairs, each over the rows where both values are known."""
    both = _row_pairs(_ranked_rows(df, columns, partners=True)).select(
        "a", "b", F.element_at("x.ranks", F.col("b") + 1).alias("x"), F.element_at("y.ranks", F.col("a") + 1).alias("y")
    )
    x, y = F.col("x"), F.col("y")
    sums = both.groupBy("a", "b").agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"))
    return _all_pairs(df, sums.select("a", "b", F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")).alias("r")), columns)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two columns; one row."""
    return spearman_pairs(df, [a, b])


_SIGNS = "a int, b int, s double"
_TABLE = ["a", "b", "lx", "ly", "px", "py"]


def _signed_pairs(group: np.ndarray, rank: np.ndarray, key: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Per element i, the sum of w_i * w_j * sign(key_i - key_j) over the j of its group with rank_j < rank_i.

    Counted like a merge sort: at each level the ranks of a group fall into blocks with two halves, and
    cumulative weights along the keys tell how much of the left half lies below and above every element of the right half.
    Groups, ranks and keys are whole numbers from 0.
    """
    total, size = np.zeros(len(rank)), 1
    top, width = int(rank.max(initial=0)) + 1, int(key.max(initial=0)) + 1
    while size < top:
        block = group * top + rank // (2 * size)
        order = np.lexsort((key, block))
        g = block[order]
        run = g * width + key[order]
        w, right = weight[order], (rank[order] // size) % 2 == 1
        upto = np.concatenate([[0.0], np.cumsum(np.where(right, 0.0, w))])
        below = upto[np.searchsorted(run, run, side="left")] - upto[np.searchsorted(g, g, side="left")]
        above = upto[np.searchsorted(g, g, side="right")] - upto[np.searchsorted(run, run, side="right")]
        total[order] += np.where(right, w * (below - above), 0.0)
        size *= 2
    return total


def _table_signs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Signed pairs of whole tables of cells; a partition holds tables one after the other."""

    def counted(parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(parts, ignore_index=True)
        keys = rows[_TABLE].to_numpy()
        start = np.r_[True, (keys[1:] != keys[:-1]).any(1)]
        group = np.cumsum(start) - 1
        several = (np.bincount(group) > 1)[group]  # a table of one cell has no pairs
        rows, group = rows[several], np.unique(group[several], return_inverse=True)[1]
        signs = _signed_pairs(group, rows["x"].to_numpy(), rows["y"].to_numpy(), rows["w"].to_numpy(dtype=float))
        return rows[["a", "b"]].assign(s=signs).groupby(["a", "b"], as_index=False).sum()

    kept: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[_TABLE].to_numpy()
        # the last table of the batch may go on in the next one
        last = int(np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])[-1])
        if kept and last == 0 and (kept[-1][_TABLE].to_numpy()[-1] == keys[0]).all():
            kept.append(batch)
            continue
        done = [*kept, batch.iloc[:last]]
        if sum(map(len, done)):
            yield counted(done)
        kept = [batch.iloc[last:]]
    if kept:
        yield counted(kept)


def _table_cells(points: DataFrame) -> DataFrame:
    """Cells of all tables. A pair of columns gets the tables of the places that its own ranks have: at a higher place all digits are 0, so no pair counts there."""
    bounds = points.groupBy("a", "b").agg(F.max("x").alias("x"), F.max("y").alias("y")).collect()  # one row per pair of columns
    places = lambda top: next(n for n in range(1, 64) if RANK_BASE**n > top)
    out = []
    for (i, j), pairs in sorted(_grouped({(r["a"], r["b"]): (places(r["x"]), places(r["y"])) for r in bounds}).items()):
        tables = F.array(*[
            F.struct(
                F.lit(k).alias("lx"), F.lit(m).alias("ly"),
                F.expr(f"x div {RANK_BASE ** (k + 1)}").alias("px"), F.expr(f"y div {RANK_BASE ** (m + 1)}").alias("py"),
                F.expr(f"x div {RANK_BASE**k} % {RANK_BASE}").alias("x"), F.expr(f"y div {RANK_BASE**m} % {RANK_BASE}").alias("y"),
            )
            for k in range(i) for m in range(j)
        ])
        mine = reduce(or_, [(F.col("a") == a) & (F.col("b") == b) for a, b in pairs])
        out.append(F.when(mine, tables))
    # no bounds, no rows
    chosen = F.coalesce(*out) if out else F.expr("array(struct(0 AS lx, 0 AS ly, 0L AS px, 0L AS py, x, y))")
    return points.select("a", "b", "w", F.inline(chosen)).groupBy(*_TABLE, "x", "y").agg(F.sum("w").alias("w"))


def _grouped(values: dict) -> dict:
    """Keys by their value."""
    out: dict = {}
    for k, v in values.items():
        out.setdefault(v, []).append(k)
    return out


def kendall_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Kendall's tau-b of all pairs, exact, without building pairs of rows.

    Values become dense ranks, written as digits in base RANK_BASE. Two points differ first in some digit of x and first in
    some digit of y, so every pair of points is counted in exactly one table: the one of these two places and of the digits
    before them, whose cells are the digits at these places. A table has at most RANK_BASE squared cells for any data, and
    points fall together in cells before they are shuffled. Two points in one table that share the digit of x or of y
    count nothing there. Work is N log(N)^2 in the number of distinct points, with the base in the logarithm.
    """
    points = _row_pairs(_ranked_rows(df, columns, partners=False)).select("a", "b", F.col("x.dense").alias("x"), F.col("y.dense").alias("y"))
    points = cut_lineage(points.groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("w")))
    cells = _table_cells(points)
    signs = cells.repartition(*_TABLE).sortWithinPartitions(*_TABLE).mapInPandas(_table_signs, _SIGNS)
    score = signs.groupBy("a", "b").agg(F.sum("s").alias("s"))

    def ties(name: str, *by: str) -> DataFrame:
        c = F.col("w").cast("double")
        return points.groupBy("a", "b", *by).agg(F.sum("w").alias("w")).groupBy("a", "b").agg(F.sum(c * (c - 1) / 2).alias(name))

    # one row per pair of columns each
    wide = ties("p").join(F.broadcast(ties("px", "x")), ["a", "b"]).join(F.broadcast(ties("py", "y")), ["a", "b"]).join(F.broadcast(score), ["a", "b"], "left")
    tau = F.try_divide(F.coalesce("s", F.lit(0.0)), F.sqrt(F.col("p") - F.col("px")) * F.sqrt(F.col("p") - F.col("py")))
    return _all_pairs(df, wide.select("a", "b", tau.alias("r")), columns)


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """Kendall's tau-b of two columns; one row."""
    return kendall_pairs(df, [a, b])


def correlations(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """Correlation matrix: pearson, spearman or kendall."""
    chosen = list(columns) if columns else numeric_columns(df)
    if method == "pearson":
        pairs = pearson_pairs(df, chosen)
    elif method == "spearman":
        pairs = spearman_pairs(df, chosen)
    elif method == "kendall":
        pairs = kendall_pairs(df, chosen)
    else:
        raise ValueError(f"unknown method: {method}")
    return correlation_matrix(pairs, chosen)


def _group_moments(df: DataFrame, column: str, group: str) -> DataFrame:
    return (
        df.select(F.col(q(group)).cast("string").alias("g"), _value(df, column).alias("v"))
        .dropna()
        .groupBy("g")
        .agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s2"))
    )


def _welch(moments: DataFrame, column: str, alpha: float) -> DataFrame:
    """Test of group `a` against group `b`, given one row with the moments of both."""
    ua, ub = F.col("s2a") / F.col("na"), F.col("s2b") / F.col("nb")
    t = F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(ua + ub))
    dof = F.try_divide((ua + ub) * (ua + ub), ua * ua / (F.col("na") - 1) + ub * ub / (F.col("nb") - 1))
    out = moments.select("*", t.alias("t"), dof.alias("dof")).withColumn("p", t_p_value("t", "dof"))
    return out.select(
        F.lit("independent_t_test").alias("test"),
        F.lit(column).alias("column"),
        F.col("a").alias("group_a"),
        F.col("b").alias("group_b"),
        F.col("ma").alias("group_a_mean"),
        F.col("mb").alias("group_b_mean"),
        F.col("na").cast("long").alias("group_a_n"),
        F.col("nb").cast("long").alias("group_b_n"),
        F.col("t").alias("t_statistic"),
        F.col("p").alias("p_value"),
        (F.col("p") < alpha).alias("significant"),
        F.lit(alpha).alias("alpha"),
    )


def _side(moments: DataFrame, tag: str) -> DataFrame:
    return moments.select(
        F.col("g").alias(tag), *[F.col(c).alias(f"{c}{tag}") for c in ("n", "m", "s2")]
    )


def t_test(df: DataFrame, column: str, group: str, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    """Welch's t-test of two named groups; one row."""
    two = df.where(F.col(q(group)).cast("string").isin(str(a), str(b)))
    per = _group_moments(two, column, group)
    left, right = _side(per.where(F.col("g") == str(a)), "a"), _side(per.where(F.col("g") == str(b)), "b")
    return _welch(left.crossJoin(F.broadcast(right)), column, alpha)  # one row each


def t_test_first_two(df: DataFrame, column: str, group: str, alpha: float = 0.05) -> DataFrame:
    """Welch's t-test of the two smallest group values."""
    per = _group_moments(df, column, group)
    first = per.orderBy("g").limit(2)
    edges = first.agg(F.min(F.struct("g", "n", "m", "s2")).alias("l"), F.max(F.struct("g", "n", "m", "s2")).alias("h"))
    row = edges.where(F.col("l.g") != F.col("h.g")).select(
        F.col("l.g").alias("a"),
        F.col("h.g").alias("b"),
        *[F.col(f"{s}.{c}").alias(f"{c}{t}") for s, t in (("l", "a"), ("h", "b")) for c in ("n", "m", "s2")],
    )
    return _welch(row, column, alpha)


def anova(df: DataFrame, column: str, group: str, alpha: float = 0.05) -> DataFrame:
    """One-way analysis of variance; one row. With fewer than two groups, p is 1 and `error` is set."""
    per = _group_moments(df, column, group)
    grand = per.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_g"))
    d = F.col("m") - F.col("_g")
    parts = per.crossJoin(F.broadcast(grand)).agg(  # one row
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * d * d).alias("between"),
        F.sum(F.coalesce(F.col("s2"), F.lit(0.0)) * (F.col("n") - 1)).alias("within"),
    )
    df1, df2 = F.col("k") - 1.0, F.col("n") - F.col("k")
    enough = F.col("k") >= 2
    f = F.try_divide(F.try_divide(F.col("between"), df1), F.try_divide(F.col("within"), df2))
    out = parts.select("k", F.when(enough, f).alias("f"), df1.alias("d1"), df2.alias("d2"))
    out = out.withColumn("p", F.when(F.col("k") < 2, 1.0).otherwise(f_p_value("f", "d1", "d2")))
    return out.select(
        F.lit("one_way_anova").alias("test"),
        F.lit(column).alias("column"),
        F.lit(group).alias("group_column"),
        F.col("k").alias("n_groups"),
        F.col("f").alias("f_statistic"),
        F.col("p").alias("p_value"),
        (F.col("p") < alpha).alias("significant"),
        F.lit(alpha).alias("alpha"),
        F.when(F.col("k") < 2, F.lit("Need at least 2 groups")).alias("error"),
    )
