"""Order statistics and ordered windows that never put a whole group into one task.

A group may hold a third of all rows, so neither `percentile` (one value map per
group) nor a plain window per group (one sort per group) is safe. Both are built here
from the same step: approximate quantiles of the ordering column give a short array
of bounds, every row falls into the bucket between two bounds, and per-bucket totals
(at most one row per group and bucket) carry state from one bucket to the next. The
bounds only decide how the work is cut; results are exact for any bounds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.exprs import q
from lectern.session import bucket_count, cut_lineage


#: Groups of input splits whose marks are merged before all marks meet.
MERGERS = 256


def _bounds(df: DataFrame, values: Sequence[Column], buckets: int) -> DataFrame:
    """One row of marks per value (`_b0`, `_b1`, ..), coarse, and merged in two levels.

    Bounds never change a result, only how evenly the work is cut. No task gets a sketch of every input split: MERGERS tasks
    merge those of their splits, and the last one sees their marks only.
    """
    marks = F.lit(np.arange(1, buckets) / buckets)
    sketch = lambda c: F.percentile_approx(c, marks, 20 * buckets)
    named = df.select(*[v.alias(f"_v{i}") for i, v in enumerate(values)], (F.spark_partition_id() % MERGERS).alias("_m"))
    first = named.groupBy("_m").agg(*[sketch(F.col(f"_v{i}")).alias(f"_b{i}") for i in range(len(values))])
    zipped = F.arrays_zip(*[F.coalesce(f"_b{i}", F.array()).alias(f"_b{i}") for i in range(len(values))])
    return first.select(F.inline(zipped)).agg(*[sketch(F.col(f"_b{i}")).alias(f"_b{i}") for i in range(len(values))])


def _coarse(bounds: str, buckets: int) -> Column:
    step = max(1, math.isqrt(buckets))
    return F.filter(F.col(bounds), lambda _, i: (i + 1) % step == 0)


def _bucket(value: Column, bounds: str, coarse: str, buckets: int) -> Column:
    """Number of bounds below `value`, searched in two steps of about sqrt(buckets)."""
    step = max(1, math.isqrt(buckets))
    first = F.size(F.filter(F.col(coarse), lambda b: b < value)) * step
    return first + F.size(F.filter(F.slice(F.col(bounds), first + 1, F.lit(step)), lambda b: b < value))


def _leaves(column: Column, kind: T.DataType) -> list[tuple[Column, T.DataType]]:
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in _leaves(column.getField(f.name), f.dataType)]
    return [(column, kind)]


#: A text is ordered by this many numbers of six bytes each; texts that agree in all of them stay in one piece.
TEXT_PARTS, TEXT_BYTES = 4, 6


def _text_parts(text: Column) -> list[Column]:
    """Numbers that never decrease along the order of texts, which is that of their UTF-8 bytes."""
    raw = text.cast("binary")
    part = lambda i: F.rpad(F.substring(raw, 1 + TEXT_BYTES * i, TEXT_BYTES), TEXT_BYTES, F.lit(b"\0"))
    return [F.conv(F.hex(part(i)), 16, 10).cast("double") for i in range(TEXT_PARTS)]


def order_leaves(df: DataFrame, order_by: Sequence[str]) -> list[Column]:
    """The leading columns of an ordering as doubles, by which it can be cut; struct fields count one by one.

    Numbers, times, booleans, texts and binaries can lead. A text is cut by its first bytes, so nothing after it is used.
    """
    times = (T.TimestampType, T.TimestampNTZType, T.DateType)
    out: list[Column] = []
    for column, kind in [x for c in order_by for x in _leaves(F.col(q(c)), df.schema[c].dataType)]:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return out + _text_parts(column)
        if isinstance(kind, T.BooleanType):
            column = column.cast("int")
        elif not isinstance(kind, (T.NumericType, *times)):
            break
        out.append((column.cast("timestamp") if isinstance(kind, times) else column).cast("double"))
    return out


def with_order_bucket(
    df: DataFrame, order_by: Sequence[str], out: str = "_seg", seen: Column | None = None
) -> DataFrame:
    """Add a bucket that never decreases along `order_by`: a number, or a struct of numbers if several columns order the rows.

    A value that equals a bound may be very frequent, so its rows are cut again by the
    next ordering column. Nulls come first. `seen` limits the rows the bounds are taken from.
    """
    leaves = order_leaves(df, order_by)
    if not leaves:
        raise ValueError(f"ordering must start with a number, time, boolean, text or binary: {list(order_by)}")
    n = bucket_count(df.sparkSession)
    sampled = leaves if seen is None else [F.when(seen, leaf) for leaf in leaves]
    stats = _bounds(df, sampled, n)
    stats = stats.select("*", *[_coarse(f"_b{i}", n).alias(f"_c{i}") for i in range(len(leaves))])
    # one row, a fixed number of array elements
    wide = df.crossJoin(F.broadcast(stats))
    places, tied = [], F.lit(True)
    for i, leaf in enumerate(leaves):
        bucket = F.coalesce(_bucket(leaf, f"_b{i}", f"_c{i}", n), F.lit(-1))
        places.append(F.when(tied, bucket).otherwise(-1).cast("int"))
        tied = tied & F.coalesce(F.get(F.col(f"_b{i}"), bucket) == leaf, F.lit(False))
    found = places[0] if len(places) == 1 else F.struct(*[p.alias(f"b{i}") for i, p in enumerate(places)])
    return wide.withColumn(out, found).drop(*[f"_{k}{i}" for k in "bc" for i in range(len(leaves))])


def value_counts(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct non-null values per group with their number of rows (`_cnt`)."""
    kept = df.where(F.col(q(value)).isNotNull())
    for k in keys:
        kept = kept.where(F.col(q(k)).isNotNull())
    return kept.groupBy(*[F.col(q(k)) for k in keys], F.col(q(value))).agg(F.count(F.lit(1)).alias("_cnt"))


def _bucketed_offsets(hist: DataFrame, value: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    # reading the counts here makes the bounds use the same shuffled counts as the other branches
    cut = with_order_bucket(hist, [value], seen=F.col("_cnt") > 0)
    totals = cut.groupBy(*keys, "_seg").agg(F.sum("_cnt").alias("_in"))
    per_key = Window.partitionBy(*keys)  # at most one row per bucket
    offsets = totals.select(
        *keys,
        "_seg",
        "_in",
        F.coalesce(
            F.sum("_in").over(per_key.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_off"),
        F.sum("_in").over(per_key).alias("_n"),
    )
    return cut, offsets


def _join_offsets(cut: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    # without keys there is one row per bucket, so the side is bounded; with keys the planner decides
    return cut.join(offsets if keys else F.broadcast(offsets), [*keys, "_seg"])


def _running(joined: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys, "_seg").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn("_before", F.col("_off") + F.coalesce(F.sum("_cnt").over(w), F.lit(0)))


def prefix_counts(hist: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Add `_before`, the rows of the group with a smaller value, and `_n`, the rows of the group."""
    cut, offsets = _bucketed_offsets(hist, value, keys)
    return _running(_join_offsets(cut, offsets, keys), value, keys).drop("_seg", "_in", "_off")


def prefix_sums(hist: DataFrame, value: str, sums: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Add for every summed column `c` its sum over smaller values of the group, `_before_c`, and over the group, `_all_c`."""
    cut = with_order_bucket(hist, [value])
    totals = cut.groupBy(*keys, "_seg").agg(*[F.sum(c).alias(f"_in_{c}") for c in sums])
    per_key = Window.partitionBy(*keys)  # at most one row per bucket
    earlier = per_key.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_seg",
        *[F.coalesce(F.sum(f"_in_{c}").over(earlier), F.lit(0)).alias(f"_off_{c}") for c in sums],
        *[F.sum(f"_in_{c}").over(per_key).alias(f"_all_{c}") for c in sums],
    )
    inside = Window.partitionBy(*keys, "_seg").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(offsets, [*keys, "_seg"])
    joined = joined.withColumns({f"_before_{c}": F.col(f"_off_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    return joined.drop("_seg", *[f"_off_{c}" for c in sums])


def exact_quantiles(
    df: DataFrame, value: str, marks: dict[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per group, one column per mark."""
    hist = value_counts(df, value, keys).withColumn(value, F.col(q(value)).cast("double"))
    cut, offsets = _bucketed_offsets(hist, value, keys)
    pos = {m: (F.col("_n") - 1) * F.lit(float(p)) for m, p in marks.items()}
    ranks = [f(x) for x in pos.values() for f in (F.floor, F.ceil)]

    def holds(start: Column, size: Column) -> Column:
        hit = F.lit(False)
        for r in ranks:
            hit = hit | ((r >= start) & (r < start + size))
        return hit

    wanted = offsets.where(holds(F.col("_off"), F.col("_in")))
    rows = _running(_join_offsets(cut, wanted, keys), value, keys)

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_cnt")), F.col(q(value))))

    picked = rows.groupBy(*keys).agg(
        F.max("_n").alias("_n"),
        *[at(F.floor(x)).alias(f"_lo_{m}") for m, x in pos.items()],
        *[at(F.ceil(x)).alias(f"_hi_{m}") for m, x in pos.items()],
    )
    return picked.select(
        *keys,
        *[
            (F.col(f"_lo_{m}") + (F.col(f"_hi_{m}") - F.col(f"_lo_{m}")) * (x - F.floor(x))).alias(m)
            for m, x in pos.items()
        ],
    )


def exact_quantiles_of(df: DataFrame, columns: Sequence[str], marks: dict[str, float]) -> DataFrame:
    """`exact_quantiles` of several columns at once, in long form keyed by `feature`."""
    return exact_quantiles(unpivoted(df, columns), "value", marks, ["feature"])


def unpivoted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(q(c)).cast("double").alias("value")) for c in columns]
    )
    return df.select(F.inline(cells))


#: Rows of a group that one task may order by itself. Larger groups are cut, so one is never sorted in one piece.
WHOLE_ROWS = 100_000


def ordered_window(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    *,
    row_number: str | None = None,
    lag: dict[str, str] | None = None,
    running_max: dict[str, str] | None = None,
    whole_rows: int = WHOLE_ROWS,
) -> DataFrame:
    """Row number, previous value and running maximum per group in the given order.

    Groups of at most `whole_rows` rows are plain windows. Larger ones, which are counted first and are few, are cut along
    the order. The input is read twice, and three times more where there are large groups, so it should be a table or
    persisted. Rows without a key are left out.
    """
    lag, running_max = lag or {}, running_max or {}
    known = df
    for k in keys:
        known = known.where(F.col(q(k)).isNotNull())
    large = cut_lineage(known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > whole_rows).select(*keys))
    if large.isEmpty():
        return _whole_window(known, keys, order_by, row_number, lag, running_max)
    small = _whole_window(known.join(large, list(keys), "left_anti"), keys, order_by, row_number, lag, running_max)
    return small.unionByName(_cut_window(known.join(large, list(keys), "left_semi"), keys, order_by, row_number, lag, running_max))


def _whole_window(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], row_number: str | None, lag: dict[str, str], running_max: dict[str, str]
) -> DataFrame:
    along = Window.partitionBy(*keys).orderBy(*[F.col(q(c)) for c in order_by])  # at most WHOLE_ROWS rows per group
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    final = [F.col(q(c)) for c in df.columns]
    if row_number:
        final.append(F.row_number().over(along).cast("long").alias(row_number))
    final += [F.lag(q(c)).over(along).alias(o) for o, c in lag.items()]
    final += [F.max(q(c)).over(upto).alias(o) for o, c in running_max.items()]
    return df.select(*final)


def _cut_window(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], row_number: str | None, lag: dict[str, str], running_max: dict[str, str]
) -> DataFrame:
    """Each group is cut along the order, windows run inside a piece, and the last row, the row count and the maximum of every piece are carried into the next one."""
    cut = with_order_bucket(df, order_by)
    order = F.struct(*[F.col(q(c)) for c in order_by])
    parts = cut.groupBy(*keys, "_seg").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.max_by(F.struct(F.col(q(c)).alias("v")), order).alias(f"_last_{o}") for o, c in lag.items()],
        *[F.max(q(c)).alias(f"_top_{o}") for o, c in running_max.items()],
    )
    along = Window.partitionBy(*keys).orderBy("_seg")  # at most one row per piece
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(
        *keys,
        "_seg",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows"),
        *[F.lag(f"_last_{o}").over(along).getField("v").alias(f"_last_{o}") for o in lag],
        *[F.max(f"_top_{o}").over(earlier).alias(f"_top_{o}") for o in running_max],
    )
    joined = cut.join(carry, [*keys, "_seg"])
    inside = Window.partitionBy(*keys, "_seg").orderBy(*[F.col(q(c)) for c in order_by])
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outputs = {"_rn": F.row_number().over(inside)}
    for o, c in lag.items():
        outputs[f"_lag_{o}"] = F.lag(q(c)).over(inside)
    for o, c in running_max.items():
        outputs[f"_max_{o}"] = F.max(q(c)).over(upto)
    wide = joined.withColumns(outputs)
    final = [F.col(q(c)) for c in df.columns]
    if row_number:
        final.append((F.col("_rows") + F.col("_rn")).cast("long").alias(row_number))
    for o in lag:
        final.append(F.when(F.col("_rn") == 1, F.col(f"_last_{o}")).otherwise(F.col(f"_lag_{o}")).alias(o))
    for o in running_max:
        final.append(F.greatest(F.col(f"_top_{o}"), F.col(f"_max_{o}")).alias(o))
    return wide.select(*final)


def first_present(column: str, order_by: Sequence[str]) -> Column:
    """First non-null value in the given order, as an aggregate."""
    present = F.col(q(column)).isNotNull()
    return F.min_by(q(column), F.when(present, F.struct(*[F.col(q(c)) for c in order_by])))
