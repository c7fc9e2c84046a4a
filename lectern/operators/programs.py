"""Program metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.exprs import flag_sum, rounded
from lectern.functions.ordering import exact_quantiles

PROGRAM = ["program_id", "program_name"]


def success_rates(programs: DataFrame) -> DataFrame:
    return (
        programs.dropna(subset=PROGRAM)
        .groupBy(*PROGRAM)
        .agg(
            F.count("email").alias("enrollments"),
            flag_sum("is_completed").alias("completed"),
            F.avg("progress_pct").alias("avg_progress"),
            F.avg("learning_hours").alias("avg_hours"),
        )
        .withColumn("success_rate", rounded(F.col("completed") / F.col("enrollments") * 100, 1))
        .orderBy(F.desc("success_rate"), *PROGRAM)
    )


def courses_completed_distribution(programs: DataFrame) -> DataFrame:
    keys = [*PROGRAM, "courses_completed"]
    return programs.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("learner_count"))


def progress_by_program(programs: DataFrame) -> DataFrame:
    kept = programs.dropna(subset=PROGRAM)
    base = kept.groupBy(*PROGRAM).agg(
        rounded(F.avg("progress_pct"), 1).alias("avg_progress"), F.countDistinct("email").alias("learners")
    )
    median = exact_quantiles(kept, "progress_pct", {"median_progress": 0.5}, PROGRAM)
    return base.join(median, PROGRAM, "left").withColumn("median_progress", rounded("median_progress", 1))


def program_summary(programs: DataFrame) -> DataFrame:
    return success_rates(programs).agg(
        F.coalesce(rounded(F.avg("success_rate"), 1), F.lit(0.0)).alias("avg_success_rate"),
        F.count(F.lit(1)).alias("total_programs"),
    )


def program_metrics(programs: DataFrame) -> dict[str, DataFrame]:
    return {
        "success_rates": success_rates(programs),
        "summary": program_summary(programs),
        "progress_by_program": progress_by_program(programs),
    }
