"""Student sources: id mapping, aggregation to student and course, joining, conflicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.exprs import numeric_columns, q
from lectern.functions.fixed import SOURCE_PRIORITY, STUDENT_ID_COLUMNS
from lectern.functions.ordering import first_present


def _id_column(id_map: DataFrame | None, source: str) -> str | None:
    column = STUDENT_ID_COLUMNS.get(source)
    return column if id_map is not None and column in id_map.columns else None


def _lookup(id_map: DataFrame, column: str) -> DataFrame:
    return id_map.select(F.col(column).alias("_source_id"), F.col("student_id").alias("_student"))


def map_ids(df: DataFrame, id_map: DataFrame | None, source: str) -> DataFrame:
    """Replace a source's student ids by the canonical ones; rows without a match are dropped.

    The planner broadcasts the map if it is small; otherwise both sides are shuffled, and
    adaptive execution splits the partitions of very active students.
    """
    column = _id_column(id_map, source)
    if column is None:
        return df
    known = _lookup(id_map, column).where(F.col("_student").isNotNull())
    joined = df.join(known, df["student_id"] == known["_source_id"])
    return joined.select(*[F.col("_student").alias(c) if c == "student_id" else F.col(q(c)) for c in df.columns])


def unmatched(df: DataFrame, id_map: DataFrame | None, source: str) -> DataFrame:
    """Number of rows per source whose id has no canonical id; ids are counted before the join."""
    column = _id_column(id_map, source)
    counts = df.groupBy("student_id").agg(F.count(F.lit(1)).alias("n"))
    if column is not None:
        known = _lookup(id_map, column).where(F.col("_student").isNotNull())
        counts = counts.join(known, counts["student_id"] == known["_source_id"], "left_anti")
    else:
        counts = counts.where(F.lit(False))
    return counts.agg(F.lit(source).alias("source"), F.coalesce(F.sum("n"), F.lit(0)).alias("unmatched_records"))


def _split(df: DataFrame, order_by: Sequence[str]) -> tuple[list[str], list[str], list[str]]:
    keys = [c for c in ("student_id", "course_id") if c in df.columns]
    skip = {*keys, *order_by}
    numbers = numeric_columns(df, skip)
    return keys, numbers, [c for c in df.columns if c not in skip and c not in numbers]


def aggregate_source(df: DataFrame, source: str, order_by: Sequence[str]) -> DataFrame:
    """Student and course level: means of numbers, first known value of the rest, row count."""
    keys, numbers, others = _split(df, order_by)
    return (
        df.dropna(subset=keys)
        .groupBy(*keys)
        .agg(
            *[F.avg(q(c)).alias(c) for c in numbers],
            *[first_present(c, order_by).alias(c) for c in others],
            F.count(F.lit(1)).alias(f"{source}_record_count"),
        )
    )


def map_and_aggregate(df: DataFrame, id_map: DataFrame | None, source: str, order_by: Sequence[str]) -> DataFrame:
    """`aggregate_source` of `map_ids`, summing per source id first.

    The map then meets one row per source id and course, so a student with a third of all
    rows is merged on the map side and never crosses the network as rows.
    """
    column = _id_column(id_map, source)
    if column is None:
        return aggregate_source(df, source, order_by)
    keys, numbers, others = _split(df, order_by)
    order = F.struct(*[F.col(q(c)) for c in order_by])

    def first(c: str) -> Column:
        return F.min(F.when(F.col(q(c)).isNotNull(), F.struct(order.alias("o"), F.col(q(c)).alias("v"))))

    partial = (
        df.dropna(subset=keys)
        .groupBy(*keys)
        .agg(
            *[F.sum(q(c)).alias(f"_s_{c}") for c in numbers],
            *[F.count(q(c)).alias(f"_n_{c}") for c in numbers],
            *[first(c).alias(f"_f_{c}") for c in others],
            F.count(F.lit(1)).alias("_rows"),
        )
    )
    return (
        map_ids(partial, id_map, source)
        .groupBy(*keys)
        .agg(
            *[(F.sum(q(f"_s_{c}")) / F.sum(q(f"_n_{c}"))).alias(c) for c in numbers],
            *[F.min(q(f"_f_{c}")).getField("v").alias(c) for c in others],
            F.sum("_rows").alias(f"{source}_record_count"),
        )
    )


def join_sources(frames: dict[str, DataFrame], join_key: str = "student_id") -> DataFrame:
    """Full outer join of all sources on the join key and, where both have it, the course.

    Columns that clash get source names: both sides in the first join, the new side later.
    """
    names = list(frames)
    if not names:
        raise ValueError("no sources")
    out = frames[names[0]]
    for i, name in enumerate(names[1:], 1):
        right = frames[name]
        keys = [k for k in dict.fromkeys((join_key, "course_id")) if k in out.columns and k in right.columns]
        keys = keys or [join_key]
        clash = [c for c in right.columns if c in out.columns and c not in keys]
        right = right.withColumnsRenamed({c: f"{c}_{name}" for c in clash})
        if i == 1:
            out = out.withColumnsRenamed({c: f"{c}_{names[0]}" for c in clash})
        out = out.join(right, keys, "full_outer")
    return out


def conflicts(columns: Sequence[str], priority: Sequence[str] = SOURCE_PRIORITY) -> dict[str, list[tuple[str, str]]]:
    """Columns that differ only in their source suffix, by base name; at least two each."""
    sources = list(dict.fromkeys([*priority, *STUDENT_ID_COLUMNS]))
    found: dict[str, list[tuple[str, str]]] = {}
    for c in columns:
        source = next((s for s in sources if c.endswith(f"_{s}")), None)
        if source:
            found.setdefault(c.removesuffix(f"_{source}"), []).append((c, source))
    return {base: cols for base, cols in found.items() if len(cols) > 1}


def resolve_conflicts(
    df: DataFrame, strategy: str = "latest", priority: Sequence[str] = SOURCE_PRIORITY
) -> DataFrame:
    """First known value: in column order ("latest"), or by source ("source_priority")."""
    out = df
    for base, cols in conflicts(df.columns, priority).items():
        chosen = cols
        if strategy == "source_priority" and priority:
            rank = {s: i for i, s in enumerate(priority)}
            chosen = sorted(cols, key=lambda x: rank.get(x[1], len(rank)))
        merged = F.coalesce(*[F.col(q(c)) for c, _ in chosen])
        out = out.withColumn(base, merged).drop(*[c for c, _ in cols])
    return out


def integrate(
    frames: dict[str, DataFrame],
    id_map: DataFrame | None,
    order_by: dict[str, Sequence[str]],
    strategy: str = "latest",
    priority: Sequence[str] = SOURCE_PRIORITY,
    join_key: str = "student_id",
) -> DataFrame:
    """Map, aggregate, join and resolve all sources."""
    level = {s: map_and_aggregate(df, id_map, s, order_by[s]) for s, df in frames.items()}
    return resolve_conflicts(join_sources(level, join_key), strategy, priority)


def integrity_issues(df: DataFrame) -> DataFrame:
    """Null ids and members of repeated (student, course) pairs; one row."""
    keys = [c for c in ("student_id", "course_id") if c in df.columns]
    pairs = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    zero = F.lit(0).cast("long")

    def rows(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("_n"))), zero)

    return pairs.agg(
        (rows(F.col("student_id").isNull()) if "student_id" in keys else zero).alias("null_student_ids"),
        (rows(F.col("course_id").isNull()) if "course_id" in keys else zero).alias("null_course_ids"),
        (rows(F.col("_n") > 1) if len(keys) == 2 else zero).alias("duplicate_student_course_pairs"),
    )


def integration_report(
    frames: dict[str, DataFrame], id_map: DataFrame | None, joined: DataFrame, priority: Sequence[str] = SOURCE_PRIORITY
) -> DataFrame:
    """Sources, matched and unmatched records, resolved conflicts; one row.

    `joined` is the result of `join_sources`, before conflicts are resolved.
    """
    lost = None
    for s, df in frames.items():
        part = unmatched(df, id_map, s)
        lost = part if lost is None else lost.unionByName(part)
    lost = lost.agg(F.sum("unmatched_records").alias("unmatched_records"))
    matched = joined.agg(F.count(F.lit(1)).alias("matched_records"))
    return matched.crossJoin(F.broadcast(lost)).select(  # one row each
        F.lit(len(frames)).alias("total_sources"),
        "matched_records",
        "unmatched_records",
        F.lit(len(conflicts(joined.columns, priority))).alias("conflicts_resolved"),
    )
