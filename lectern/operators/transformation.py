"""Unified learner model: dimensions and facts from cleaned exports, and the learner view."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.exprs import (
    as_timestamp,
    clean_name,
    flag_sum,
    numeric,
    q,
    rounded,
    total,
    true_or_false,
    yes_no,
)
from lectern.functions.ordering import exact_quantiles, prefix_counts
from lectern.operators.learners import moment
from lectern.sources.readers import rename_existing
from lectern.session import cut_lineage

# Internal export header -> model column.
COURSE_COLUMNS = {
    "Email": "email",
    "External ID": "external_id",
    "Course Id": "course_id",
    "Course Name": "course_name",
    "Enrollment Timestamp": "enrollment_ts",
    "Completion Timestamp": "completion_ts",
    "Progress (%)": "progress_pct",
    "Grade (%)": "grade",
    "Learning Hours": "learning_hours",
    "Estimated Learning Hours": "estimated_learning_hours",
    "Completed": "is_completed",
    "Last Activity Timestamp": "last_activity_ts",
    "Course Type": "course_type",
    "Business Unit": "business_unit",
    "Role": "role",
    "Location": "location",
    "Location Region": "location_region",
    "Location Country": "location_country",
    "Program Name": "program_name",
    "Removed From Program": "removed_from_program",
}
PROGRAM_COLUMNS = {
    "Email": "email",
    "External ID": "external_id",
    "Program Id": "program_id",
    "Program Name": "program_name",
    "Program Slug": "program_slug",
    "Total Courses in Program": "total_courses",
    "Total Courses": "total_courses",
    "Courses Completed": "courses_completed",
    "Progress (%)": "progress_pct",
    "Learning Hours": "learning_hours",
    "Completed": "is_completed",
    "Enrollment Timestamp": "enrollment_ts",
    "Last Activity Timestamp": "last_activity_ts",
}
SPECIALIZATION_COLUMNS = {
    "Email": "email",
    "External ID": "external_id",
    "Specialization Id": "spec_id",
    "Specialization Name": "spec_name",
    "Specialization Slug": "spec_slug",
    "Total Courses": "total_courses",
    "Courses Completed": "courses_completed",
    "Progress (%)": "progress_pct",
    "Learning Hours": "learning_hours",
    "Completed": "is_completed",
    "Enrollment Timestamp": "enrollment_ts",
    "Last Activity Timestamp": "last_activity_ts",
    "Completion Timestamp": "completion_ts",
    "Institution": "institution",
    "Program Name": "program_name",
}
VIDEO_COLUMNS = {
    "Email": "email",
    "External ID": "external_id",
    "Course Id": "course_id",
    "Course Name": "course_name",
    "Video Name": "video_name",
    "Video Id": "video_id",
    "Watch Duration (seconds)": "watch_seconds",
    "Total Duration (seconds)": "total_seconds",
    "Completion (%)": "completion_pct",
    "Watch Count": "watch_count",
    "Last Watch Timestamp": "last_watch_ts",
    "First Watch Timestamp": "first_watch_ts",
    "Learning Hours": "learning_hours",
    "Estimated Learning Hours": "estimated_learning_hours",
    "Video Completed": "video_completed",
    "Led to Enrollment": "led_to_enrollment",
}
# Columns of the learner and course dimensions.
LEARNER_ATTRIBUTES = [
    "Name", "External ID", "Business Unit", "Role", "Location", "Location Region", "Location Country", "Manager Name",
]
COURSE_ATTRIBUTES = ["Course Slug", "Institution", "Course Type"]


def _order(columns: Sequence[str]):
    return F.struct(*[F.col(q(c)) for c in columns])


def learners(courses: DataFrame, order_by: Sequence[str], reference_date: datetime | str) -> DataFrame:
    """Learner dimension: first row per email, enrolment and activity span, sequential id.

    One aggregation; ids follow the order of first appearance, numbered without a global sort
    in one task. A struct of the ordering columns must be numeric, or a single number.
    """
    attributes = [c for c in LEARNER_ATTRIBUTES if c in courses.columns]
    order = _order(order_by)
    aggs = [F.min(order).alias("_first")]
    aggs += [F.min_by(F.struct(*[F.col(q(c)).alias(clean_name(c)) for c in attributes]), order).alias("_a")] if attributes else []
    if "Enrollment Timestamp" in courses.columns:
        aggs.append(F.min(as_timestamp(courses, "Enrollment Timestamp")).alias("enrollment_date"))
    if "Last Activity Timestamp" in courses.columns:
        aggs.append(F.max(as_timestamp(courses, "Last Activity Timestamp")).alias("last_activity"))
    # dropping duplicates keeps one row without an email, but no aggregate matches it
    per = cut_lineage(courses.where(F.col("Email").isNotNull()).groupBy(F.col("Email").alias("email")).agg(*aggs))
    spots = prefix_counts(per.select(F.col("_first"), F.lit(1).alias("_cnt")), "_first")
    numbered = per.join(spots.select("_first", (F.col("_before") + 1).alias("learner_id")), "_first")
    columns = ["learner_id", "email", *[F.col(f"_a.{clean_name(c)}") for c in attributes]]
    columns += [c for c in ("enrollment_date", "last_activity") if c in per.columns]
    if "last_activity" in per.columns:
        cutoff = moment(reference_date) - F.expr("INTERVAL 90 DAYS")
        columns.append(true_or_false(F.col("last_activity") >= cutoff).alias("is_active"))
    return numbered.select(*columns)


def course_table(courses: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Course dimension: first row per course, and the median hours of completed enrolments."""
    key = "Course Id" if "Course Id" in courses.columns else "Course Name"
    attributes = ["Course Name"] if key == "Course Id" and "Course Name" in courses.columns else []
    attributes += [c for c in COURSE_ATTRIBUTES if c in courses.columns]
    keyed = courses.where(F.col(q(key)).isNotNull())
    if attributes:
        body = F.struct(*[F.col(q(c)).alias(clean_name(c)) for c in attributes])
        out = keyed.groupBy(F.col(q(key)).alias("course_id")).agg(F.min_by(body, _order(order_by)).alias("_a"))
        out = out.select("course_id", *[F.col(f"_a.{clean_name(c)}") for c in attributes])
    else:
        out = keyed.select(F.col(q(key)).alias("course_id")).distinct()
    if "Learning Hours" not in courses.columns or "Completed" not in courses.columns:
        return out
    done = keyed.where(F.col("Completed").cast("string") == "Yes").select(
        F.col(q(key)).alias("course_id"), numeric(courses, "Learning Hours").alias("hours")
    )
    return out.join(exact_quantiles(done, "hours", {"estimated_hours": 0.5}, ["course_id"]), "course_id", "left")


def _fact(df: DataFrame, names: dict[str, str], fallback: dict[str, str], zero: list[str]) -> DataFrame:
    out = rename_existing(df, names)
    for key, name in fallback.items():
        if key not in out.columns and name in out.columns:
            out = out.withColumn(key, F.col(name))
    fixes = {c: numeric(out, c, 0.0) for c in zero if c in out.columns}
    if "is_completed" in out.columns:
        fixes["is_completed"] = yes_no("is_completed")
    for c in out.columns:
        if c.endswith("_ts"):
            fixes[c] = as_timestamp(out, c)
    return out.withColumns(fixes) if fixes else out


def course_activity(df: DataFrame) -> DataFrame:
    out = _fact(df, COURSE_COLUMNS, {"course_id": "course_name"}, ["progress_pct", "learning_hours"])
    return out.withColumn("grade", numeric(out, "grade")) if "grade" in out.columns else out


def _with_progress(out: DataFrame) -> DataFrame:
    counts = [c for c in ("courses_completed", "total_courses") if c in out.columns]
    out = out.withColumns({c: numeric(out, c, 0.0).cast("int") for c in counts})
    if "progress_pct" in out.columns or len(counts) < 2:
        return out
    share = F.col("courses_completed") / F.greatest(F.col("total_courses"), F.lit(1)) * 100
    return out.withColumn("progress_pct", rounded(share, 1))


def program_activity(df: DataFrame) -> DataFrame:
    return _with_progress(_fact(df, PROGRAM_COLUMNS, {"program_id": "program_name"}, ["learning_hours"]))


def specialization_activity(df: DataFrame) -> DataFrame:
    return _with_progress(_fact(df, SPECIALIZATION_COLUMNS, {"spec_id": "spec_name"}, ["learning_hours"]))


def video_activity(df: DataFrame) -> DataFrame:
    out = _fact(df, VIDEO_COLUMNS, {"course_id": "course_name", "video_id": "video_name"}, [])
    for seconds, hours in (("watch_seconds", "learning_hours"), ("total_seconds", "estimated_learning_hours")):
        if seconds not in out.columns and hours in out.columns:
            out = out.withColumn(hours, numeric(out, hours, 0.0))
            out = out.withColumn(seconds, rounded(F.col(hours) * 3600, 1))
    zero = [c for c in ("completion_pct", "watch_count", "watch_seconds", "total_seconds") if c in out.columns]
    return out.withColumns({c: numeric(out, c, 0.0) for c in zero}) if zero else out


def transform_all(
    exports: dict[str, DataFrame], order_by: Sequence[str], reference_date: datetime | str
) -> dict[str, DataFrame]:
    """Every model table whose export is present."""
    out: dict[str, DataFrame] = {}
    if "course" in exports:
        out["learners"] = learners(exports["course"], order_by, reference_date)
        out["courses"] = course_table(exports["course"], order_by)
        out["course_activity"] = course_activity(exports["course"])
    if "program" in exports:
        out["program_activity"] = program_activity(exports["program"])
    if "specialization" in exports:
        out["specialization_activity"] = specialization_activity(exports["specialization"])
    if "video" in exports:
        out["video_activity"] = video_activity(exports["video"])
    return out


def _per_learner(df: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """Aggregates named by `wanted`: output -> (kind, column), for the columns that exist."""
    kinds = {"count": F.count, "flags": flag_sum, "mean": F.avg, "sum": total}
    aggs = [kinds[k](c).alias(o) for o, (k, c) in wanted.items() if c in df.columns]
    return df.where(F.col("email").isNotNull()).groupBy("email").agg(*aggs)


def unified_learner_view(tables: dict[str, DataFrame]) -> DataFrame:
    """Learners with their course, video, specialization and program totals.

    Every fact is summed per email before its join, and all joins share that key.
    """
    if "learners" not in tables or "course_activity" not in tables:
        raise ValueError("learners and course_activity are needed")
    courses = _per_learner(
        tables["course_activity"],
        {
            "courses_enrolled": ("count", "course_id"),
            "courses_completed": ("flags", "is_completed"),
            "avg_progress": ("mean", "progress_pct"),
            "total_learning_hours": ("sum", "learning_hours"),
            "avg_grade": ("mean", "grade"),
        },
    )
    rate = rounded(F.col("courses_completed") / F.col("courses_enrolled") * 100, 1)
    out = tables["learners"].join(courses.withColumn("completion_rate", rate), "email", "left")
    plans = {
        "video_activity": {
            "videos_watched": ("count", "video_id"),
            "avg_video_completion": ("mean", "completion_pct"),
            "total_watch_seconds": ("sum", "watch_seconds"),
            "total_rewatches": ("sum", "watch_count"),
        },
        "specialization_activity": {
            "specs_enrolled": ("count", "spec_id"),
            "specs_completed": ("flags", "is_completed"),
            "avg_spec_progress": ("mean", "progress_pct"),
        },
        "program_activity": {
            "programs_enrolled": ("count", "program_id"),
            "programs_completed": ("flags", "is_completed"),
            "avg_program_progress": ("mean", "progress_pct"),
        },
    }
    for name, wanted in plans.items():
        if name in tables:
            out = out.join(_per_learner(tables[name], wanted), "email", "left")
    return out
