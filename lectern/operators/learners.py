"""Learner metrics: activity, velocity, completion, ranking and detail."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.exprs import as_timestamp, clip, flag_sum, rounded, total, whole_days
from lectern.functions.ordering import exact_quantiles
from lectern.operators.statistics import describe

# Raw export header for each dimension; either name is accepted.
DIMENSION_HEADERS = {"business_unit": "Business Unit", "role": "Role", "location": "Location"}


def moment(ts: datetime | str) -> Column:
    return F.lit(str(ts)).cast("timestamp")


def active_vs_inactive(activity: DataFrame, reference_date: datetime | str, days: int = 90) -> DataFrame:
    """Learners with activity in the last `days` days, and the others; one row."""
    if "last_activity_ts" not in activity.columns:
        return activity.sparkSession.range(1).select(
            *[F.lit(0).cast("long").alias(c) for c in ("active", "inactive", "total")],
            F.lit(0.0).alias("pct_active"),
            F.lit(days).alias("cutoff_days"),
        )
    cutoff = moment(reference_date) - F.expr(f"INTERVAL {int(days)} DAYS")
    last = (
        activity.where(F.col("email").isNotNull())
        .groupBy("email")
        .agg(F.max(as_timestamp(activity, "last_activity_ts")).alias("last"))
    )
    counts = last.agg(
        F.count_if(F.col("last") >= cutoff).alias("active"), F.count_if(F.col("last") < cutoff).alias("inactive")
    ).withColumn("total", F.col("active") + F.col("inactive"))
    share = F.when(F.col("total") > 0, rounded(F.col("active") / F.col("total") * 100, 1)).otherwise(0.0)
    return counts.select("active", "inactive", "total", share.alias("pct_active"), F.lit(days).alias("cutoff_days"))


def learning_velocity(activity: DataFrame) -> DataFrame:
    """Hours per week of each learner, over the longest enrolment (at least one week)."""
    weeks = whole_days(as_timestamp(activity, "last_activity_ts"), as_timestamp(activity, "enrollment_ts")) / 7
    return (
        activity.where(F.col("email").isNotNull())
        .groupBy("email")
        .agg(total("learning_hours").alias("total_hours"), F.max(clip(weeks, low=1.0)).alias("total_weeks"))
        .withColumn("hours_per_week", rounded(F.col("total_hours") / F.col("total_weeks"), 2))
    )


def velocity_summary(activity: DataFrame) -> DataFrame:
    return describe(learning_velocity(activity), ["total_hours", "total_weeks", "hours_per_week"])


def completion_summary(activity: DataFrame) -> DataFrame:
    """Enrolments, completions, their rate, mean and median progress; one row."""
    base = activity.agg(
        F.count(F.lit(1)).alias("total_enrollments"),
        flag_sum("is_completed").alias("total_completed"),
        rounded(F.avg("progress_pct"), 1).alias("avg_progress"),
    )
    median = exact_quantiles(activity, "progress_pct", {"_median": 0.5}).agg(F.max("_median").alias("_median"))
    rate = rounded(F.col("total_completed") / F.col("total_enrollments") * 100, 1)
    return base.crossJoin(F.broadcast(median)).select(  # one row each
        "total_enrollments",
        "total_completed",
        F.when(F.col("total_enrollments") > 0, rate).otherwise(0.0).alias("completion_rate"),
        "avg_progress",
        rounded("_median", 1).alias("median_progress"),
    )


def completion_by_dimension(activity: DataFrame, dimension: str) -> DataFrame:
    """Completion per value of any column, best first."""
    header = DIMENSION_HEADERS.get(dimension, dimension)
    column = dimension if dimension in activity.columns else header
    if column not in activity.columns:
        raise ValueError(f"no column for dimension '{dimension}'")
    return (
        activity.where(F.col(f"`{column}`").isNotNull())
        .groupBy(F.col(f"`{column}`").alias(dimension))
        .agg(
            F.count("email").alias("enrollments"),
            flag_sum("is_completed").alias("completed"),
            F.avg("progress_pct").alias("avg_progress"),
            F.avg("learning_hours").alias("avg_hours"),
        )
        .withColumn("completion_rate", rounded(F.col("completed") / F.col("enrollments") * 100, 1))
        .orderBy(F.desc("completion_rate"), dimension)
    )


def top_learners(activity: DataFrame, n: int = 20) -> DataFrame:
    """The n best learners by completions, progress and hours."""
    score = F.col("courses_completed") * 10 + F.col("avg_progress") * 0.5 + F.col("total_hours") * 0.3
    return (
        activity.where(F.col("email").isNotNull())
        .groupBy("email")
        .agg(
            flag_sum("is_completed").alias("courses_completed"),
            total("learning_hours").alias("total_hours"),
            F.avg("progress_pct").alias("avg_progress"),
            F.count("course_id").alias("courses_enrolled"),
        )
        .withColumn("score", score)
        .orderBy(F.desc("score"), "email")
        .limit(n)
    )


def learner_detail(
    activity: DataFrame, email: str, engagement: DataFrame | None = None, skills: DataFrame | None = None
) -> dict[str, DataFrame]:
    """One learner's courses, totals, engagement and skills, each as rows.

    The course list stays a DataFrame: one learner may own a large part of the table.
    """
    mine = activity.where(F.col("email") == email)
    out = {
        "courses": mine.select("email", "course_id", "course_name", "progress_pct", "is_completed", "learning_hours"),
        "summary": mine.groupBy("email").agg(
            rounded(total("learning_hours"), 1).alias("total_hours"),
            rounded(F.avg("progress_pct"), 1).alias("avg_progress"),
            flag_sum("is_completed").alias("courses_completed"),
        ),
    }
    if engagement is not None:
        out["engagement"] = engagement.where(F.col("email") == email)
    if skills is not None:
        out["skills"] = skills.where(F.col("email") == email).orderBy(F.desc("skill_score"), "skill_name")
    return out


def learner_metrics(activity: DataFrame, reference_date: datetime | str) -> dict[str, DataFrame]:
    return {
        "active_inactive": active_vs_inactive(activity, reference_date),
        "completion": completion_summary(activity),
        "velocity": velocity_summary(activity),
        "top_learners": top_learners(activity, 10),
    }
