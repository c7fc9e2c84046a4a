"""Engagement scores per learner: progress, hours, video and recency."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.exprs import as_timestamp, clip, rounded, total, whole_days
from lectern.functions.fixed import ENGAGEMENT_WEIGHTS
from lectern.functions.ordering import exact_quantiles
from lectern.operators.learners import moment
from lectern.session import cut_lineage

CATEGORIES = ["High", "Medium", "Low", "At-Risk"]


def category(score: str | Column) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= 75, "High").when(s >= 50, "Medium").when(s >= 25, "Low").otherwise("At-Risk")


def _p95(df: DataFrame, column: str, out: str) -> DataFrame:
    """95th percentile as one row; 0 counts as 1."""
    row = exact_quantiles(df, column, {out: 0.95}).agg(F.max(out).alias(out))
    return row.select(F.when(F.col(out) == 0, 1.0).otherwise(F.col(out)).alias(out))


def progress_component(activity: DataFrame) -> DataFrame:
    return (
        activity.where(F.col("email").isNotNull())
        .groupBy("email")
        .agg(F.avg("progress_pct").alias("progress_component"))
    )


def hours_component(activity: DataFrame) -> DataFrame:
    hours = cut_lineage(
        activity.where(F.col("email").isNotNull()).groupBy("email").agg(total("learning_hours").alias("total_hours"))
    )
    return _scaled_hours(hours).select("email", "total_hours", "hours_component")


def _scaled_hours(learners: DataFrame) -> DataFrame:
    share = F.col("total_hours") / F.col("_p95h") * 100
    return learners.crossJoin(F.broadcast(_p95(learners, "total_hours", "_p95h"))).withColumn(  # one row
        "hours_component", clip(share, 0.0, 100.0)
    )


def watched(videos: DataFrame) -> DataFrame:
    """Mean completion and number of watches per learner, written."""
    return cut_lineage(
        videos.where(F.col("email").isNotNull())
        .groupBy("email")
        .agg(F.avg("completion_pct").alias("_completion"), total("watch_count").alias("total_watches"))
    )


def video_component(videos: DataFrame) -> DataFrame:
    return _watched_component(watched(videos))


def _watched_component(per: DataFrame) -> DataFrame:
    watches = clip(F.col("total_watches") / F.col("_p95w") * 100, 0.0, 100.0)
    return per.crossJoin(F.broadcast(_p95(per, "total_watches", "_p95w"))).select(  # one row
        "email", rounded(F.col("_completion") * 0.6 + watches * 0.4, 2).alias("video_component")
    )


def _recency(last: Column, reference_date: datetime | str) -> Column:
    days = clip(whole_days(moment(reference_date), last), low=0)
    return rounded(clip((1 - days / 365) * 100, 0.0, 100.0), 2)


def recency_component(activity: DataFrame, reference_date: datetime | str) -> DataFrame:
    per = activity.where(F.col("email").isNotNull()).groupBy("email")
    if "last_activity_ts" not in activity.columns:
        return per.agg(F.lit(50.0).alias("recency_component"))
    last = per.agg(F.max(as_timestamp(activity, "last_activity_ts")).alias("_last"))
    return last.select("email", _recency(F.col("_last"), reference_date).alias("recency_component"))


def engagement_scores(
    activity: DataFrame,
    videos: DataFrame | None,
    reference_date: datetime | str,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Score, category and components of every learner.

    One aggregation of the activity table gives three components. It is written,
    because the 95th percentile needs it before the scores do.
    """
    has_time = "last_activity_ts" in activity.columns
    last = F.max(as_timestamp(activity, "last_activity_ts")) if has_time else F.lit(None).cast("timestamp")
    learners = cut_lineage(
        activity.where(F.col("email").isNotNull())
        .groupBy("email")
        .agg(
            F.avg("progress_pct").alias("progress_component"),
            total("learning_hours").alias("total_hours"),
            last.alias("_last"),
        )
    )
    return scores_of_totals(learners, None if videos is None else watched(videos), reference_date, weights, has_time)


def scores_of_totals(
    learners: DataFrame,
    seen: DataFrame | None,
    reference_date: datetime | str,
    weights: dict[str, float] | None = None,
    has_time: bool = True,
) -> DataFrame:
    """`engagement_scores` from written totals: per email `progress_component`, `total_hours`, `_last`, and what `watched` gives."""
    w = weights or ENGAGEMENT_WEIGHTS
    recency = _recency(F.col("_last"), reference_date) if has_time else F.lit(50.0)
    parts = _scaled_hours(learners).select(
        "email", "progress_component", "hours_component", recency.alias("recency_component")
    )
    if seen is None:
        parts = parts.withColumn("video_component", F.lit(50.0))
    else:
        parts = parts.join(_watched_component(seen), "email", "left")
    names = ["progress_component", "hours_component", "video_component", "recency_component"]
    parts = parts.na.fill(0.0, names)
    score = (
        F.col("progress_component") * w["progress_pct"]
        + F.col("hours_component") * w["learning_hours"]
        + F.col("video_component") * w["video_interactions"]
        + F.col("recency_component") * w["recency_score"]
    )
    return parts.withColumn("score", rounded(score, 1)).select("email", "score", category("score").alias("category"), *names)


def category_distribution(scores: DataFrame) -> dict[str, DataFrame]:
    counts = scores.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")
    return {"distribution": counts, "summary": score_summary(scores)}


def score_summary(scores: DataFrame) -> DataFrame:
    base = scores.agg(
        F.count(F.lit(1)).alias("total_learners"),
        rounded(F.avg("score"), 1).alias("avg_score"),
        *[F.count_if(F.col("category") == c).alias(c.lower().replace("-", "_")) for c in CATEGORIES],
    )
    median = exact_quantiles(scores, "score", {"median_score": 0.5}).agg(
        rounded(F.max("median_score"), 1).alias("median_score")
    )
    return base.crossJoin(F.broadcast(median))  # one row each
