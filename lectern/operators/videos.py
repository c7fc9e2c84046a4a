"""Video metrics: watch frequency, completion, rewatching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.exprs import rounded, total
from lectern.functions.ordering import exact_quantiles

VIDEO = ["video_id", "video_name", "course_id"]


def watch_frequency(videos: DataFrame) -> DataFrame:
    return (
        videos.dropna(subset=VIDEO)
        .groupBy(*VIDEO)
        .agg(
            total("watch_count").alias("total_watches"),
            F.countDistinct("email").alias("unique_viewers"),
            F.avg("watch_count").alias("avg_watch_count"),
        )
        .orderBy(F.desc("total_watches"), *VIDEO)
    )


def video_completion(videos: DataFrame) -> DataFrame:
    kept = videos.dropna(subset=VIDEO)
    base = kept.groupBy(*VIDEO).agg(
        rounded(F.avg("completion_pct"), 1).alias("avg_completion"), F.countDistinct("email").alias("viewers")
    )
    median = exact_quantiles(kept, "completion_pct", {"median_completion": 0.5}, VIDEO)
    return base.join(median, VIDEO, "left").orderBy("avg_completion", *VIDEO)


def rewatch_patterns(videos: DataFrame) -> DataFrame:
    return (
        videos.dropna(subset=VIDEO)
        .where(F.col("watch_count") > 1)
        .groupBy(*VIDEO)
        .agg(
            total("watch_count").alias("total_rewatches"),
            rounded(F.avg("watch_count"), 1).alias("avg_rewatch_count"),
            F.countDistinct("email").alias("rewatchers"),
        )
        .orderBy(F.desc("total_rewatches"), *VIDEO)
    )


def course_video_summary(videos: DataFrame) -> DataFrame:
    return (
        videos.dropna(subset=["course_id"])
        .groupBy("course_id")
        .agg(
            F.countDistinct("video_id").alias("total_videos"),
            total("watch_seconds").alias("total_watch_seconds"),
            rounded(F.avg("completion_pct"), 1).alias("avg_completion"),
            F.avg("watch_count").alias("avg_watch_count"),
            F.countDistinct("email").alias("unique_viewers"),
        )
        .withColumn("total_watch_hours", rounded(F.col("total_watch_seconds") / 3600, 1))
    )


def video_summary(videos: DataFrame) -> DataFrame:
    """Number of videos and the unweighted mean of their (rounded) completion; one row."""
    per_video = (
        videos.dropna(subset=VIDEO)
        .groupBy(*VIDEO)
        .agg(rounded(F.avg("completion_pct"), 1).alias("avg_completion"))
    )
    return per_video.agg(
        F.countDistinct("video_id").alias("total_videos"),
        F.coalesce(rounded(F.avg("avg_completion"), 1), F.lit(0.0)).alias("avg_completion"),
    )


def video_metrics(videos: DataFrame, n: int = 10) -> dict[str, DataFrame]:
    return {
        "summary": video_summary(videos),
        "most_watched": watch_frequency(videos).limit(n),
        "most_rewatched": rewatch_patterns(videos).limit(n),
        "lowest_completion": video_completion(videos).limit(n),
        "course_summary": course_video_summary(videos),
    }
