"""Features: student level (with custom features) and the learner matrix for models."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.exprs import as_timestamp, clip, flag_sum, q, rounded, total, whole_days
from lectern.functions.fixed import OUTCOME_COLUMNS, STUDENT_ENGAGEMENT_WEIGHTS
from lectern.functions.ordering import ordered_window
from lectern.session import cut_lineage
from lectern.operators.engagement import scores_of_totals
from lectern.operators.learners import moment
from lectern.operators.statistics import describe

FEATURE_COLUMNS = [
    "engagement_score", "session_frequency", "video_completion_pct", "video_completed",
    "assessment_improvement", "dropout", "final_score",
]

LOG = logging.getLogger(__name__)
Feature = Callable[[DataFrame], Column]


def session_frequency(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Sum of the record counts of a row; else the running row number of the student; else 1."""
    counts = [c for c in df.columns if c.endswith("_record_count")]
    if counts:
        total_count = F.lit(0)
        for c in counts:
            total_count = total_count + F.coalesce(F.col(q(c)), F.lit(0))
        return df.withColumn("session_frequency", total_count)
    if "student_id" in df.columns:
        return ordered_window(df, ["student_id"], order_by, row_number="session_frequency")
    return df.withColumn("session_frequency", F.lit(1))


def video_completion(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    if "completion_pct" not in df.columns:
        return df.withColumns(
            {"video_completion_pct": F.lit(None).cast("double"), "video_completed": F.lit(None).cast("int")}
        )
    done = F.when(F.col("completion_pct") >= threshold, 1).otherwise(0)
    return df.withColumns({"video_completion_pct": F.col("completion_pct"), "video_completed": done})


def assessment_improvement(df: DataFrame, order_by: Sequence[str], method: str = "slope") -> DataFrame:
    """Difference to (or relative change from) the student's previous score; 0 where unknown."""
    score = next((c for c in ("score", "gpa") if c in df.columns), None)
    if score is None:
        return df.withColumn("assessment_improvement", F.lit(None).cast("double"))
    if "student_id" not in df.columns:
        return df.withColumn("assessment_improvement", F.lit(0.0))
    before = ordered_window(df, ["student_id"], order_by, lag={"_previous": score})
    now, then = F.col(score), F.col("_previous")
    change = F.try_divide(now, then) - 1 if method == "pct_change" else now - then
    return before.withColumn("assessment_improvement", F.coalesce(change, F.lit(0.0))).drop("_previous")


def with_min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add each column's minimum and maximum to every row (one row is broadcast)."""
    row = df.agg(
        *[F.min(q(c)).alias(f"_min_{c}") for c in columns], *[F.max(q(c)).alias(f"_max_{c}") for c in columns]
    )
    return df.crossJoin(F.broadcast(row))


def _scaled(c: str) -> Column:
    low, high = F.col(f"_min_{c}"), F.col(f"_max_{c}")
    return F.when(low == high, 0.5).otherwise((F.col(q(c)) - low) / (high - low))


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale columns to [0, 1]; a constant column becomes 0.5."""
    wide = with_min_max(df, columns)
    return wide.select(*[_scaled(c).alias(c) if c in columns else F.col(q(c)) for c in df.columns])


def student_engagement(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean of the available components, with weights re-normalised."""
    w = weights or STUDENT_ENGAGEMENT_WEIGHTS
    scaled = {
        "session_frequency": "session_frequency",
        "assessment_score": "score" if "score" in df.columns else "avg_assessment_score",
        "forum_activity": "forum_posts",
    }
    scaled = {k: c for k, c in scaled.items() if c in df.columns}
    if not scaled and "video_completion_pct" not in df.columns:
        return df.withColumn("engagement_score", F.lit(None).cast("double"))
    wide = with_min_max(df, list(scaled.values())) if scaled else df
    parts = {k: _scaled(c) for k, c in scaled.items()}
    if "video_completion_pct" in df.columns:
        parts["video_completion"] = clip("video_completion_pct", 0.0, 1.0)
    score, weight = F.lit(0.0), 0.0
    for name in ("session_frequency", "video_completion", "assessment_score", "forum_activity"):
        if name in parts:
            score = score + F.coalesce(parts[name], F.lit(0.0)) * w.get(name, 0.0)
            weight += w.get(name, 0.0)
    if weight > 0:
        score = score / weight
    return wide.select(*[F.col(q(c)) for c in df.columns], rounded(score, 4).alias("engagement_score"))


def dropout_flag(df: DataFrame) -> DataFrame:
    if "enrollment_status" not in df.columns:
        return df
    return df.withColumn("dropout", F.when(F.col("enrollment_status") == "withdrawn", 1).otherwise(0))


def final_score(df: DataFrame) -> DataFrame:
    column = next((c for c in ("gpa", "score") if c in df.columns), None)
    return df.withColumn("final_score", F.col(column)) if column else df


def custom_features(df: DataFrame, features: dict[str, Feature]) -> tuple[DataFrame, dict[str, str]]:
    """Add user features (functions from the frame to a column, pandas UDFs included).

    A feature that does not resolve is left out, and its error is returned.
    """
    errors: dict[str, str] = {}
    for name, make in features.items():
        try:
            candidate = df.withColumn(name, make(df))
            candidate.schema  # resolves the plan
            df = candidate
        except Exception as e:
            errors[name] = str(e)
    return df, errors


def generate_features(
    df: DataFrame,
    order_by: Sequence[str],
    *,
    threshold: float = 0.8,
    method: str = "slope",
    weights: dict[str, float] | None = None,
    features: dict[str, Feature] | None = None,
) -> DataFrame:
    """All features. The input is written once: the windows and the scaling read it several times.

    Scaling comes before the window over scores, so that its minimum and maximum do not
    depend on that window.
    """
    out = session_frequency(cut_lineage(df), order_by)
    out = student_engagement(video_completion(out, threshold), weights)
    out = assessment_improvement(out, order_by, method)
    out = final_score(dropout_flag(out))
    out, errors = custom_features(out, features or {})
    for name, error in errors.items():
        LOG.warning("custom feature %s is left out: %s", name, error)
    return out


def feature_summary(df: DataFrame, custom: Sequence[str] = ()) -> DataFrame:
    """Count, mean, standard deviation, minimum and maximum of the features that exist."""
    columns = [c for c in [*FEATURE_COLUMNS, *custom] if c in df.columns]
    stats = describe(df, columns, quantiles=False)
    return stats.where(F.col("count") > 0).select(
        "feature", "count", *[rounded(c, 4).alias(c) for c in ("mean", "std", "min", "max")]
    )


def learner_matrix(
    activity: DataFrame,
    engagement: DataFrame | None,
    videos: DataFrame | None,
    reference_date: datetime | str,
) -> DataFrame:
    """Behaviour and outcome columns per learner, nulls as 0.

    One aggregation per fact; all joins are on email.
    """
    totals = _activity_totals(activity)
    seen = None if videos is None else _video_totals(videos)
    return _matrix_of_totals(totals, engagement, seen, reference_date)


def scored_learner_matrix(activity: DataFrame, videos: DataFrame, reference_date: datetime | str) -> DataFrame:
    """`learner_matrix` with the engagement scores of the same tables.

    The scores need totals that the matrix has as well, so each fact is read and aggregated once, and its totals are written.
    """
    totals, seen = cut_lineage(_activity_totals(activity)), cut_lineage(_video_totals(videos))
    scores = scores_of_totals(
        totals.select("email", F.col("avg_progress").alias("progress_component"), "total_hours", "_last"),
        seen.select("email", F.col("avg_video_completion").alias("_completion"), F.col("total_rewatches").alias("total_watches")),
        reference_date,
    )
    return _matrix_of_totals(totals, scores, seen, reference_date)


def _activity_totals(activity: DataFrame) -> DataFrame:
    per = activity.where(F.col("email").isNotNull())
    has = set(activity.columns)
    aggs = [F.count("course_id").alias("courses_enrolled")]
    if "learning_hours" in has:
        aggs += [
            total("learning_hours").alias("total_hours"),
            F.avg("learning_hours").alias("avg_hours_per_course"),
            F.stddev_samp("learning_hours").alias("std_hours"),
        ]
    if {"enrollment_ts", "last_activity_ts"} <= has:
        begin = as_timestamp(activity, "enrollment_ts")
        aggs += [
            F.min(begin).alias("_begin"),
            F.max(begin).alias("_latest"),
            F.max(as_timestamp(activity, "last_activity_ts")).alias("_last"),
        ]
    aggs += [
        F.avg("progress_pct").alias("avg_progress"),
        F.max("progress_pct").alias("max_progress"),
        flag_sum("is_completed").alias("courses_completed"),
    ]
    return per.groupBy("email").agg(*aggs)


def _video_totals(videos: DataFrame) -> DataFrame:
    return (
        videos.where(F.col("email").isNotNull())
        .groupBy("email")
        .agg(
            F.count("video_id").alias("videos_watched"),
            F.countDistinct("video_id").alias("unique_videos"),
            F.avg("completion_pct").alias("avg_video_completion"),
            total("watch_seconds").alias("total_watch_seconds"),
            total("watch_count").alias("total_rewatches"),
            F.avg("watch_count").alias("avg_rewatch_rate"),
        )
        .withColumn(
            "rewatch_ratio",
            rounded(F.coalesce(F.try_divide(F.col("total_rewatches"), F.col("videos_watched")), F.lit(0.0)), 3),
        )
    )


def _matrix_of_totals(
    base: DataFrame, engagement: DataFrame | None, seen: DataFrame | None, reference_date: datetime | str
) -> DataFrame:
    ref = moment(reference_date)
    outcomes = ["avg_progress", "max_progress", "courses_completed", "completion_rate"]
    columns = [F.col(c) for c in base.columns if c not in outcomes and not c.startswith("_")]
    if "_begin" in base.columns:
        age = clip(whole_days(ref, F.col("_begin")), low=0)
        columns += [
            clip(whole_days(ref, F.col("_last")), low=0).alias("days_since_last_activity"),
            age.alias("account_age_days"),
            whole_days(F.col("_latest"), F.col("_begin")).alias("enrollment_span_days"),
        ]
        if "total_hours" in base.columns:
            columns.append(rounded(F.col("total_hours") / F.greatest(age / 7, F.lit(1.0)), 3).alias("hours_per_week"))
    rate = F.coalesce(F.try_divide(F.col("courses_completed"), F.col("courses_enrolled")), F.lit(0.0))
    out = base.select(*columns, *outcomes[:3], rate.alias("completion_rate"))
    if engagement is not None:
        safe = [c for c in ("hours_component", "video_component", "recency_component") if c in engagement.columns]
        out = out.join(engagement.select("email", *safe), "email", "left")
    if seen is not None:
        out = out.join(seen, "email", "left")
    behaviour = [c for c in out.columns if c not in outcomes]
    filled = out.na.fill(0, [c for c in behaviour if c != "email"])
    return filled.select(*behaviour, *outcomes)


def model_inputs(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Feature columns, without the email, the outcomes and anything in `exclude`."""
    skip = {"email", *OUTCOME_COLUMNS, *exclude}
    return [c for c in df.columns if c not in skip]
