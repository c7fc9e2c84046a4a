"""Course metrics: completion, drop-off, time to completion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.exprs import as_timestamp, flag_mean, flag_sum, right_closed_bins, rounded, whole_days
from lectern.functions.ordering import exact_quantiles

# Progress bins of the drop-off report.
DROP_OFF_EDGES = [0, 10, 25, 50, 75, 90, 100]
DROP_OFF_LABELS = ["0-10%", "10-25%", "25-50%", "50-75%", "75-90%", "90-100%"]

COURSE = ["course_id", "course_name"]


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropna(subset=keys)


def completion_rates(activity: DataFrame) -> DataFrame:
    """Enrolments, completions, means and rates per course, best first."""
    aggs = [
        F.count("email").alias("enrollments"),
        flag_sum("is_completed").alias("completed"),
        F.avg("progress_pct").alias("avg_progress"),
    ]
    if "learning_hours" in activity.columns:
        aggs.append(F.avg("learning_hours").alias("avg_hours"))
    if "grade" in activity.columns:
        aggs.append(F.avg("grade").alias("avg_grade"))
    return (
        _keyed(activity, COURSE)
        .groupBy(*COURSE)
        .agg(*aggs)
        .withColumn("completion_rate", rounded(F.col("completed") / F.col("enrollments") * 100, 1))
        .withColumn("drop_off_rate", rounded(100 - F.col("completion_rate"), 1))
        .orderBy(F.desc("completion_rate"), *COURSE)
    )


def drop_off(activity: DataFrame) -> DataFrame:
    """Rows per course and progress bin; bins without rows do not appear."""
    return (
        _keyed(activity, COURSE)
        .withColumn("progress_bucket", right_closed_bins("progress_pct", DROP_OFF_EDGES, DROP_OFF_LABELS))
        .where(F.col("progress_bucket").isNotNull())
        .groupBy(*COURSE, "progress_bucket")
        .agg(F.count(F.lit(1)).alias("learner_count"))
    )


def drop_off_totals(activity: DataFrame) -> DataFrame:
    return drop_off(activity).groupBy("progress_bucket").agg(F.sum("learner_count").alias("learner_count"))


def time_to_completion(activity: DataFrame) -> DataFrame:
    """Days from enrolment to completion (or to the last activity, if there is no completion time)."""
    end = "completion_ts" if "completion_ts" in activity.columns else "last_activity_ts"
    done = (
        _keyed(activity, COURSE)
        .where(F.col("is_completed"))
        .withColumn("days", whole_days(as_timestamp(activity, end), as_timestamp(activity, "enrollment_ts")))
    )
    base = done.groupBy(*COURSE).agg(
        rounded(F.avg("days"), 1).alias("avg_days"),
        F.min("days").alias("min_days"),
        F.max("days").alias("max_days"),
        F.count("email").alias("completions"),
    )
    median = exact_quantiles(done.select(*COURSE, "days"), "days", {"median_days": 0.5}, COURSE)
    return base.join(median, COURSE, "left").withColumn("median_days", rounded("median_days", 1))


def engagement_vs_completion(activity: DataFrame) -> DataFrame:
    return (
        _keyed(activity, ["course_id"])
        .groupBy("course_id")
        .agg(
            F.avg("learning_hours").alias("avg_hours"),
            rounded(flag_mean("is_completed") * 100, 1).alias("completion_rate"),
            F.avg("progress_pct").alias("avg_progress"),
        )
    )


def course_summary(activity: DataFrame) -> DataFrame:
    """Unweighted means of the per-course rates, and the number of courses; one row."""
    return completion_rates(activity).agg(
        rounded(F.avg("completion_rate"), 1).alias("avg_completion_rate"),
        rounded(F.avg("drop_off_rate"), 1).alias("avg_drop_off_rate"),
        F.count(F.lit(1)).alias("total_courses"),
    )


def course_metrics(activity: DataFrame) -> dict[str, DataFrame]:
    return {
        "completion_rates": completion_rates(activity),
        "summary": course_summary(activity),
        "time_to_completion": time_to_completion(activity),
    }


def completion_by_course_name(activity: DataFrame) -> DataFrame:
    return (
        _keyed(activity, ["course_name"])
        .groupBy("course_name")
        .agg((flag_mean("is_completed") * 100).alias("completion_rate"))
        .orderBy("completion_rate", "course_name")
    )
