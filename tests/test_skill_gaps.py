"""Skill gaps read scores that are written once."""

from pyspark.sql import functions as F

from lectern.operators import skills


def test_scores_are_written_before_the_gaps(spark):
    scores = spark.range(12).select(
        F.concat(F.lit("e"), (F.col("id") % 4).cast("string")).alias("email"), F.when(F.col("id") < 8, "SQL").otherwise("Python").alias("skill_name"),
        F.lit("Data").alias("skill_category"), F.col("id").cast("double").alias("skill_score"),
    )
    out = skills.skill_gaps(scores)
    assert "Range" not in out._jdf.queryExecution().executedPlan().toString()
    found = [tuple(r) for r in out.select("skill_name", "avg_score", "learners_with_skill", "coverage_pct").collect()]
    assert found == [("SQL", 3.5, 4, 100.0), ("Python", 9.5, 4, 100.0)]
