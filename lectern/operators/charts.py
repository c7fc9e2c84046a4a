"""Tables behind charts and dashboards: KPIs, histograms, pivots, series, listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.exprs import flag_mean, q, rounded, total


def executive_kpis(activity: DataFrame, engagement: DataFrame | None = None) -> DataFrame:
    """Headline numbers; one row. `active_learners` equals the learner total by definition."""
    base = activity.agg(
        F.countDistinct("email").alias("total_learners"),
        F.countDistinct("course_id").alias("total_courses"),
        rounded(flag_mean("is_completed") * 100, 1).alias("overall_completion_rate"),
        rounded(total("learning_hours"), 1).alias("total_learning_hours"),
    )
    if engagement is None:
        base = base.withColumns({"avg_engagement_score": F.lit(0.0), "at_risk_count": F.lit(0).cast("long")})
    else:
        scores = engagement.agg(
            rounded(F.avg("score"), 1).alias("avg_engagement_score"),
            F.count_if(F.col("category") == "At-Risk").alias("at_risk_count"),
        )
        base = base.crossJoin(F.broadcast(scores))  # one row
    hours = rounded(F.col("total_learning_hours") / F.col("total_learners"), 1)
    return base.select(
        "total_learners",
        F.col("total_learners").alias("active_learners"),
        "total_courses",
        "overall_completion_rate",
        "avg_engagement_score",
        "at_risk_count",
        "total_learning_hours",
        F.when(F.col("total_learners") > 0, hours).otherwise(0.0).alias("avg_hours_per_learner"),
    )


def student_kpis(features: DataFrame) -> DataFrame:
    return features.agg(
        F.countDistinct("student_id").alias("total_students"),
        rounded(F.avg("engagement_score") * 100, 1).alias("avg_engagement_pct"),
        rounded(F.avg("dropout") * 100, 1).alias("dropout_rate_pct"),
    )


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over [min, max]; every bin appears, the last one is closed."""
    value = F.col(q(column)).cast("double")
    span = df.agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    flat = F.col("_min") == F.col("_max")
    span = span.select(
        (F.col("_min") - F.when(flat, 0.5).otherwise(0.0)).alias("_lo"),
        (F.col("_max") + F.when(flat, 0.5).otherwise(0.0)).alias("_hi"),
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    counted = (
        df.select(value.alias("_v"))
        .where(F.col("_v").isNotNull())
        .crossJoin(F.broadcast(span))  # one row
        .select(F.least(F.floor((F.col("_v") - F.col("_lo")) / width).cast("int"), F.lit(bins - 1)).alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = span.select(
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), F.col("_lo"), width.alias("_w")
    )
    return grid.join(counted, "bin", "left").select(
        "bin",
        (F.col("_lo") + F.col("_w") * F.col("bin")).alias("low"),
        (F.col("_lo") + F.col("_w") * (F.col("bin") + 1)).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def cohort_pivot(
    df: DataFrame, cohort: str, time: str, metric: str, times: Sequence | None = None
) -> DataFrame:
    """Mean of `metric` by cohort (rows) and time (columns)."""
    kept = df.dropna(subset=[cohort, time])
    pre = kept.groupBy(cohort, time).agg(F.avg(metric).alias("_mean"))
    pivoted = pre.groupBy(cohort).pivot(time, list(times) if times is not None else None)
    return pivoted.agg(F.first("_mean", ignorenulls=True))


def time_series(df: DataFrame, time: str, values: Sequence[str], tie_break: Sequence[str] = ()) -> DataFrame:
    present = [c for c in values if c in df.columns]
    return df.select(time, *[c for c in tie_break if c != time], *present).orderBy(time, *tie_break)


def category_counts(df: DataFrame, column: str) -> DataFrame:
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column)
    )


def by_email(df: DataFrame, email: str) -> DataFrame:
    return df.where(F.col("email") == email)


def engagement_listing(engagement: DataFrame, category: str | None = None, limit: int = 50) -> DataFrame:
    """Learners of a category, best score first; `limit` is between 1 and 500."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    kept = engagement if category is None else engagement.where(F.col("category") == category)
    return kept.orderBy(F.desc("score"), "email").limit(limit)


def preview(df: DataFrame, order_by: Sequence[str], rows: int = 100) -> DataFrame:
    return df.orderBy(*order_by).limit(rows)


def tagged_union(frames: dict[str, DataFrame], tag: str = "_source") -> DataFrame:
    """Rows of all frames by column name, missing columns null, with the frame's name in `tag`."""
    out = None
    for name, df in frames.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no frames")
    return out
