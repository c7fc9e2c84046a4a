"""Inputs that are read several times are written first, and rows are not shuffled by a class."""

import re

from pyspark.sql import functions as F

from lectern.operators import engagement, features, insights, models


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_classes_do_not_make_tasks(spark):
    data = spark.range(200).select(F.col("id").alias("_key"), (F.col("id") % 2).cast("double").alias("label"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joins = re.findall(r"\w+Join\b", _plan(models.split(data, stratify=True)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert joins[0] == "BroadcastHashJoin"  # the outermost one, of the rows with their class


def test_high_performers_read_the_written_matrix(spark):
    matrix = spark.range(50).select(F.col("id").cast("string").alias("email"), F.col("id").cast("double").alias("avg_progress"))
    out = models.high_performer_label(matrix)
    assert "Range" not in _plan(out) and out.agg(F.sum("_label")).first()[0] == 13


def test_scores_are_worked_out_once(spark):
    scores = spark.range(40).select(F.col("id").cast("string").alias("email"), F.when(F.col("id") < 10, "High").otherwise("At-Risk").alias("category"))
    activity = spark.createDataFrame([("1", "a", True, 60.0)], "email string, course_name string, is_completed boolean, progress_pct double")
    out = insights.all_insights(activity.withColumn("learning_hours", F.lit(1.0)), scores, generated_at="2002-01-01")
    assert "Range" not in _plan(out) and out.where("title like '%30%'").count() == 1


def test_matrix_and_scores_aggregate_a_fact_once(spark):
    """The matrix with scores equals the two made one after the other, and every row is read once."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        read.add(1)
        return x

    row = F.col("id")
    email, day = F.when(row % 9 > 0, (row % 9).cast("string")), F.timestamp_seconds(10**9 + row * 86400)
    activity = spark.range(60).select(
        email.alias("email"), F.lit("c").alias("course_id"), (row % 7 * 10.0).alias("progress_pct"), (row * 0.5).alias("hours"),
        (row % 3 == 0).alias("is_completed"), day.alias("enrollment_ts"), day.alias("last_activity_ts"),
    )
    plain = activity.withColumnRenamed("hours", "learning_hours")
    videos = spark.range(20).select(
        (row % 5).cast("string").alias("email"), (row % 4).alias("video_id"), (row * 2.0).alias("completion_pct"),
        (row * 60.0).alias("watch_seconds"), (row % 3).alias("watch_count"),
    )
    scores = engagement.engagement_scores(plain, videos, "2002-01-01")
    want = features.learner_matrix(plain, scores, videos, "2002-01-01")
    got = features.scored_learner_matrix(activity.withColumn("learning_hours", counted("hours")), videos, "2002-01-01")
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert read.value <= 60


def test_cubes_come_from_one_pass(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        read.add(1)
        return x

    row = F.col("id")
    plain = spark.range(60).select(
        F.when(row % 9 > 0, (row % 9).cast("string")).alias("email"), F.when(row % 4 > 0, (row % 4).cast("string")).alias("course_name"),
        F.when(row % 5 > 0, (row % 2).cast("string")).alias("business_unit"), F.when(row % 11 > 0, row % 3 == 0).alias("is_completed"),
        (row % 13 * 9.0).alias("progress_pct"), F.when(row % 7 > 0, row * 0.5).alias("learning_hours"),
    )
    cube, learners = insights.written_cubes(plain.withColumn("learning_hours", counted("learning_hours")))
    for got, want in ((cube, insights.activity_cube(plain)), (learners, insights.learner_cube(plain))):
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert read.value <= 60
