"""Cleaning: sparse columns, types, duplicates, missing values, timestamps, percentages.

Two orders of steps exist, for exports and for student sources. Decisions about columns
(drop, cast) are taken from one profile pass; imputation values are computed lazily as
one row and joined in.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.exprs import TIMESTAMP_FORMATS, clip, number, q, timestamp, whole_number
from lectern.functions.ordering import exact_quantiles_of
from lectern.session import cut_lineage
from lectern.sources.readers import ROW_ID, PROVENANCE

# Name parts that mark a timestamp column of a student source.
TIMESTAMP_NAMES = re.compile(
    r"(timestamp|datetime|date|time|created|updated|_at$|_on$|start|end|session)", re.IGNORECASE
)

# types whose least and greatest value a hash aggregation can keep
FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class CleanOptions:
    numeric: str = "median"  # mean, median, zero, drop
    categorical: str = "mode"  # mode, unknown, drop
    unknown: str = "Unknown"
    missing_threshold: float = 0.5
    numeric_share: float = 0.5
    keep: str = "first"  # first, last, false
    subset: tuple[str, ...] | None = None
    order_by: tuple[str, ...] = ()
    formats: tuple[str, ...] = TIMESTAMP_FORMATS
    sequential: bool = True  # column by column, so that a dropped row leaves later statistics


STUDENT_OPTIONS = CleanOptions(unknown="unknown", numeric_share=0.8, sequential=False)


@dataclass(frozen=True)
class Profile:
    rows: int
    present: dict[str, int] = field(default_factory=dict)
    parsed: dict[str, int] = field(default_factory=dict)
    whole: dict[str, int] = field(default_factory=dict)

    def null_share(self, c: str) -> float:
        return 0.0 if self.rows == 0 else 1 - self.present[c] / self.rows


def _is_text(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.StringType)


def _is_number(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def _data_columns(df: DataFrame, order_by: Sequence[str]) -> list[str]:
    """All columns but the ordering and those the readers add."""
    return [c for c in df.columns if c not in order_by and c not in PROVENANCE]


def _ordering(df: DataFrame, order_by: Sequence[str]) -> tuple[str, ...]:
    """The given ordering, or the readers' row number where the frame has one."""
    return tuple(order_by) or ((ROW_ID,) if ROW_ID in df.columns else ())


def _present(df: DataFrame, c: str) -> Column:
    """Not missing; NaN counts as missing."""
    known = F.col(q(c)).isNotNull()
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        known = known & ~F.isnan(F.col(q(c)))
    return known


def profile(df: DataFrame, columns: Sequence[str]) -> Profile:
    """Non-null counts of all columns and parseable counts of the text columns: one aggregate."""
    text = [c for c in columns if _is_text(df, c)]
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.count_if(_present(df, c)).alias(f"p{i}") for i, c in enumerate(columns)]
    aggs += [F.count(number(q(c))).alias(f"x{i}") for i, c in enumerate(text)]
    aggs += [F.count(whole_number(q(c))).alias(f"w{i}") for i, c in enumerate(text)]
    row = df.agg(*aggs).first()
    return Profile(
        row["n"],
        {c: row[f"p{i}"] for i, c in enumerate(columns)},
        {c: row[f"x{i}"] for i, c in enumerate(text)},
        {c: row[f"w{i}"] for i, c in enumerate(text)},
    )


def null_shares(df: DataFrame) -> DataFrame:
    """Share of missing values per column, in long form."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(_present(df, c)).alias(f"p{i}") for i, c in enumerate(df.columns)])
    cells = [
        F.struct(F.lit(c).alias("column"), (1 - F.col(f"p{i}") / F.col("n")).alias("null_share"))
        for i, c in enumerate(df.columns)
    ]
    return row.select(F.inline(F.array(*cells)))


def drop_sparse_columns(
    df: DataFrame, threshold: float = 0.5, order_by: Sequence[str] = (), known: Profile | None = None
) -> DataFrame:
    columns = _data_columns(df, order_by)
    known = known or profile(df, columns)
    return df.drop(*[c for c in columns if known.null_share(c) > threshold])


def infer_numbers(
    df: DataFrame, share: float = 0.5, order_by: Sequence[str] = (), known: Profile | None = None
) -> DataFrame:
    """Cast text columns to numbers where more than `share` of the non-null values parse.

    If all that parse are whole and fit 64 bits they become whole numbers, so that ids keep their digits; else doubles.
    """
    columns = [c for c in _data_columns(df, order_by) if _is_text(df, c)]
    known = known or profile(df, columns)
    # a column without values counts as numeric in neither order
    chosen = [c for c in columns if known.parsed[c] > share * known.present[c]]
    cast = {c: (whole_number if known.whole[c] == known.parsed[c] else number)(q(c)) for c in chosen}
    return df.withColumns(cast) if chosen else df


def _free_name(df: DataFrame, name: str) -> str:
    """The name with as many leading underscores as make it differ from all columns, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _least_of_each(group: GroupedData, c: str, keep: str, copies: str) -> DataFrame:
    """The first or last `c` of each group, or the only one, counted as `copies`; nulls are before all values."""
    value = F.col(q(c))
    rows = F.count(F.lit(1))
    if keep == "last":
        return group.agg(F.max(value).alias(c))
    least = F.when(F.count(value) == rows, F.min(value)).alias(c)
    if keep == "first":
        return group.agg(least)
    return group.agg(least, rows.alias(copies)).where(F.col(copies) == 1)


def remove_duplicates(
    df: DataFrame, keep: str = "first", subset: Sequence[str] | None = None, order_by: Sequence[str] = ()
) -> DataFrame:
    """Keep the first, the last or none of the rows that agree on `subset` (default: all data columns).

    One aggregation with map-side merging, so a value that fills a third of the table costs
    one row per task. Nulls are equal to each other; a row without an order comes first. Where
    only one ordering column of fixed width is not compared, it is a hash aggregation.
    """
    order_by = _ordering(df, order_by)
    keys = list(subset) if subset else _data_columns(df, order_by)
    if keep not in ("first", "last", "false"):
        raise ValueError(f"unknown keep: {keep}")
    rest = [c for c in df.columns if c not in keys]
    if keep != "false" and not rest:
        return df.dropDuplicates()
    if keep != "false" and not order_by:
        raise ValueError("keeping the first or last row needs an ordering")
    group = df.groupBy(*[F.col(q(c)) for c in keys])
    row, copies = _free_name(df, "_row"), _free_name(df, "_copies")
    if len(rest) == 1 and rest == list(order_by) and isinstance(df.schema[rest[0]].dataType, FIXED_WIDTH):
        return _least_of_each(group, rest[0], keep, copies).select(*[F.col(q(c)) for c in df.columns])
    body = F.struct(*[F.col(q(c)) for c in rest]) if rest else F.struct(F.lit(0).alias("_x"))
    order = F.struct(*[F.col(q(c)) for c in order_by]) if order_by else F.lit(0)
    pick = (F.max_by if keep == "last" else F.min_by)(body, order).alias(row)
    picked = group.agg(pick, F.count(F.lit(1)).alias(copies))
    if keep == "false":
        picked = picked.where(F.col(copies) == 1)
    names = {c: F.col(q(c)) if c in keys else F.col(row).getField(c) for c in df.columns}
    return picked.select(*[v.alias(k) for k, v in names.items()])


def _modes(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Most frequent value per column, the smallest on ties, as one row of text columns."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), v.cast("string").alias("value")) for c, v in columns.items()]
    )
    counts = (
        df.select(F.inline(cells))
        .where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = counts.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
    return best.agg(*[F.max(F.when(F.col("feature") == c, F.col("value"))).alias(f"_fill_{c}") for c in columns])


def _means(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.agg(*[F.avg(v).alias(f"_fill_{c}") for c, v in columns.items()])


def _medians(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    wide = df.select(*[v.cast("double").alias(c) for c, v in columns.items()])
    long = exact_quantiles_of(wide, list(columns), {"m": 0.5})
    return long.agg(*[F.max(F.when(F.col("feature") == c, F.col("m"))).alias(f"_fill_{c}") for c in columns])


def fill_missing(
    df: DataFrame,
    numeric: str = "median",
    categorical: str = "mode",
    unknown: str = "Unknown",
    order_by: Sequence[str] = (),
    sequential: bool = True,
    text_only: bool = False,
    known: Profile | None = None,
) -> DataFrame:
    """Impute or drop missing values; columns without any stay as they are.

    With `sequential`, columns are treated from left to right, and a row dropped for one
    column no longer counts in the statistics of the columns after it.
    """
    if numeric not in ("mean", "median", "zero", "drop") or categorical not in ("mode", "unknown", "drop"):
        raise ValueError(f"unknown strategy: {numeric}, {categorical}")
    columns = _data_columns(df, order_by)
    known = known or profile(df, columns)
    columns = [c for c in columns if known.present[c] < known.rows]
    numbers = [c for c in columns if _is_number(df, c)]
    others = [c for c in columns if c not in numbers and (not text_only or _is_text(df, c))]
    todo = [c for c in columns if c in numbers or c in others] if sequential else numbers + others

    alive = F.lit(True)
    visible: dict[str, Column] = {}  # the values each column's statistic may see
    for c in todo:
        here = _present(df, c)
        visible[c] = F.when(alive & here, F.col(q(c)))
        if (numeric if c in numbers else categorical) == "drop":
            alive = alive & here

    stats = None
    for names, strategy in ((numbers, numeric), (others, categorical)):
        chosen = {c: visible[c] for c in names}
        if not chosen or strategy not in ("mean", "median", "mode"):
            continue
        row = {"mean": _means, "median": _medians, "mode": _modes}[strategy](df, chosen)
        stats = row if stats is None else stats.crossJoin(row)  # one row each
    out = df.where(alive) if "drop" in (numeric, categorical) else df
    if stats is not None:
        out = out.crossJoin(F.broadcast(stats))  # one row

    def filled(c: str) -> Column:
        value = F.when(_present(df, c), F.col(q(c)))
        strategy = numeric if c in numbers else categorical
        if c not in todo or strategy == "drop":
            return F.col(q(c))
        if strategy == "zero":
            return F.coalesce(value, F.lit(0)).cast(df.schema[c].dataType)
        if strategy == "unknown":
            return F.coalesce(value, F.lit(unknown)) if _is_text(df, c) else F.col(q(c))
        fill = F.col(q(f"_fill_{c}"))
        if strategy == "mode":
            return F.coalesce(value, fill.cast(df.schema[c].dataType))
        return F.coalesce(value.cast("double"), fill)

    return out.select(*[filled(c).alias(c) for c in df.columns])


def named_timestamp_columns(df: DataFrame) -> list[str]:
    """Text columns of an export whose name says timestamp or date."""
    return [c for c in df.columns if _is_text(df, c) and ("timestamp" in c.lower() or "date" in c.lower())]


def detected_timestamp_columns(
    df: DataFrame, formats: Sequence[str] = TIMESTAMP_FORMATS, order_by: Sequence[str] = ()
) -> list[str]:
    """Text columns of a student source that hold times, by name or because all values parse."""
    text = [c for c in _data_columns(df, order_by) if _is_text(df, c)]
    named = [c for c in text if TIMESTAMP_NAMES.search(c)]
    unnamed = [c for c in text if c not in named]
    if not unnamed:
        return named
    row = df.agg(
        *[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(unnamed)],
        *[F.count(timestamp(q(c), formats)).alias(f"x{i}") for i, c in enumerate(unnamed)],
    ).first()
    parsed = [c for i, c in enumerate(unnamed) if row[f"n{i}"] and row[f"n{i}"] == row[f"x{i}"]]
    return named + parsed


def normalise_timestamps(df: DataFrame, columns: Sequence[str], formats: Sequence[str] = TIMESTAMP_FORMATS) -> DataFrame:
    """Text to timestamps; what does not parse becomes null and stays null."""
    chosen = {c: timestamp(q(c), formats) for c in columns if c in df.columns and _is_text(df, c)}
    return df.withColumns(chosen) if chosen else df


def clip_percentages(df: DataFrame) -> DataFrame:
    chosen = [c for c in df.columns if ("(%)" in c or "pct" in c.lower()) and _is_number(df, c)]
    return df.withColumns({c: clip(q(c), 0, 100).cast(df.schema[c].dataType) for c in chosen}) if chosen else df


def clean_export(df: DataFrame, options: CleanOptions = CleanOptions()) -> DataFrame:
    """Sparse columns, types, duplicates, missing values, timestamps, percentages: in this order."""
    order_by = _ordering(df, options.order_by)
    known = profile(df, _data_columns(df, order_by))
    out = drop_sparse_columns(df, options.missing_threshold, order_by, known)
    out = infer_numbers(out, options.numeric_share, order_by, known)
    # written once: the profile, the statistics and the result all read the table without its copies
    out = cut_lineage(remove_duplicates(out, options.keep, options.subset, order_by))
    out = fill_missing(out, options.numeric, options.categorical, options.unknown, order_by, options.sequential)
    out = normalise_timestamps(out, named_timestamp_columns(out), options.formats)
    return clip_percentages(out)


def clean_student_source(df: DataFrame, options: CleanOptions = STUDENT_OPTIONS) -> DataFrame:
    """Types, duplicates, sparse columns, missing values, timestamps: in this order."""
    order_by = _ordering(df, options.order_by)
    out = infer_numbers(df, options.numeric_share, order_by, profile(df, _data_columns(df, order_by)))
    out = cut_lineage(remove_duplicates(out, options.keep, options.subset, order_by))
    out = drop_sparse_columns(out, options.missing_threshold, order_by)
    out = fill_missing(
        out, options.numeric, options.categorical, options.unknown, order_by, options.sequential, text_only=True
    )
    return normalise_timestamps(out, detected_timestamp_columns(out, options.formats, order_by), options.formats)


def _missing_cells(df: DataFrame, columns: Sequence[str]) -> Column:
    cells = F.lit(0)
    for c in columns:
        cells = cells + (~_present(df, c)).cast("int")
    return cells


def cleaning_report(before: DataFrame, after: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    """Rows, columns and missing cells before and after; one row."""

    def counted(df: DataFrame, tag: str) -> DataFrame:
        columns = _data_columns(df, order_by)
        return df.agg(
            F.count(F.lit(1)).alias(f"rows_{tag}"),
            F.lit(len(columns)).alias(f"cols_{tag}"),
            F.coalesce(F.sum(_missing_cells(df, columns)), F.lit(0)).alias(f"missing_{tag}"),
        )

    both = counted(before, "before").crossJoin(F.broadcast(counted(after, "after")))  # one row each
    return both.select(
        "rows_before",
        "rows_after",
        (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
        "cols_before",
        "cols_after",
        (F.col("cols_before") - F.col("cols_after")).alias("cols_removed"),
        "missing_before",
        "missing_after",
        (F.col("missing_before") - F.col("missing_after")).alias("missing_filled"),
    )


def quality_kpis(df: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    """Rows, missing cells, repeated rows and columns; one pass, one row."""
    columns = _data_columns(df, order_by)
    groups = df.groupBy(*[F.col(q(c)) for c in columns]).agg(F.count(F.lit(1)).alias("_copies"))
    return groups.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(_missing_cells(df, columns) * F.col("_copies")), F.lit(0)).alias("missing_values"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"),
        F.lit(len(columns)).alias("num_columns"),
    )
