"""Skills: course-to-skill mapping, scores, profiles, gaps and timelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.exprs import clip, flag_sum, rounded
from lectern.functions.fixed import COURSE_SKILLS, DEFAULT_SKILL, KEYWORD_SKILLS, SKILL_CATEGORIES
from lectern.functions.ordering import ordered_window
from lectern.session import cut_lineage


def taxonomy(spark: SparkSession) -> DataFrame:
    rows = [(c, s) for c, skills in SKILL_CATEGORIES.items() for s in skills]
    return spark.createDataFrame(rows, "skill_category string, skill_name string")


def skill_category(skill: str | Column) -> Column:
    """Category of a skill, or Other."""
    pairs = [F.lit(x) for c, skills in SKILL_CATEGORIES.items() for s in skills for x in (s, c)]
    s = F.col(skill) if isinstance(skill, str) else skill
    return F.coalesce(F.try_element_at(F.create_map(*pairs), s), F.lit("Other"))


def catalogue_skills(spark: SparkSession, mapping: dict[str, list[str]] | None = None) -> DataFrame:
    rows = [(c, s) for c, skills in (mapping or COURSE_SKILLS).items() for s in skills]
    # made from driver memory, so its size is fixed; without the hint the activity would be shuffled on a few course ids
    return F.broadcast(spark.createDataFrame(rows, "course_id string, skill_name string"))


def keyword_skills(activity: DataFrame) -> DataFrame:
    """Skills told by words in the course names; plain substrings, as `java` in `javascript`.

    The words are matched by one array expression per distinct course, so there is no
    join of courses with words. A course with several names gets the skills of all of them.
    """
    key = "course_id" if "course_id" in activity.columns else "course_name"
    name = "course_name" if "course_name" in activity.columns else key
    entries = F.array(
        *[
            F.struct(F.lit(w).alias("word"), F.array(*[F.lit(s) for s in skills]).alias("skills"))
            for w, skills in KEYWORD_SKILLS.items()
        ]
    )
    lowered = F.lower(F.col(name).cast("string"))
    hits = F.filter(entries, lambda e: F.contains(lowered, e["word"]))
    found = F.array_distinct(F.flatten(F.transform(hits, lambda e: e["skills"])))
    courses = activity.where(F.col(key).isNotNull()).select(F.col(key), F.col(name)).distinct()
    named = courses.select(F.col(key).alias("course_id"), F.explode_outer(found).alias("skill_name"))
    # the set holds at most the skills of the fixed list
    sets = named.groupBy("course_id").agg(F.collect_set("skill_name").alias("s"))
    return sets.select(
        "course_id",
        F.explode(F.when(F.size("s") > 0, F.col("s")).otherwise(F.array(F.lit(DEFAULT_SKILL)))).alias("skill_name"),
    )


def course_skills(activity: DataFrame, mapping: dict[str, list[str]] | None = None) -> DataFrame:
    """The given map; else the catalogue if any course is in it; else the keyword map."""
    spark = activity.sparkSession
    if mapping:
        return catalogue_skills(spark, mapping)
    if "course_id" in activity.columns:
        known = activity.where(F.col("course_id").isin(*COURSE_SKILLS)).select("course_id").limit(1)
        if known.count():
            return catalogue_skills(spark)
    return keyword_skills(activity)


def skill_scores(activity: DataFrame, skills: DataFrame | None = None) -> DataFrame:
    """Score of every learner and skill: progress, with a bonus for completions.

    Rows are summed per learner and course first, so the skill map multiplies sums, not rows.
    """
    skills = course_skills(activity) if skills is None else skills
    sums = (
        activity.dropna(subset=["email", "course_id"])
        .groupBy("email", "course_id")
        .agg(
            F.sum("progress_pct").alias("_sum"),
            F.count("progress_pct").alias("_n"),
            F.count(F.lit(1)).alias("_rows"),
            flag_sum("is_completed").alias("_done"),
        )
    )
    score = F.col("avg_progress") * 0.7 + F.col("courses_completed") / F.col("courses_contributing") * 30
    return (
        sums.join(skills, "course_id")
        .groupBy("email", "skill_name")
        .agg(
            (F.sum("_sum") / F.sum("_n")).alias("avg_progress"),
            F.sum("_rows").alias("courses_contributing"),
            F.sum("_done").alias("courses_completed"),
        )
        .select(
            "email",
            "skill_name",
            skill_category("skill_name").alias("skill_category"),
            "avg_progress",
            "courses_contributing",
            "courses_completed",
            rounded(clip(score, 0.0, 100.0), 1).alias("skill_score"),
        )
    )


def skill_profile(activity: DataFrame, email: str, skills: DataFrame | None = None) -> DataFrame:
    skills = course_skills(activity) if skills is None else skills
    mine = activity.where(F.col("email") == email)
    return skill_scores(mine, skills).orderBy(F.desc("skill_score"), "skill_name")


def skill_gaps(scores: DataFrame, target_skills: Sequence[str] | None = None) -> DataFrame:
    """Mean score, coverage and gap of every skill, largest gap first.

    The scores are written first: two aggregations read them, and neither then shares a task's memory with those that make them.
    """
    return _skill_gaps(cut_lineage(scores.select("email", "skill_name", "skill_category", "skill_score")), target_skills)


def _skill_gaps(scores: DataFrame, target_skills: Sequence[str] | None = None) -> DataFrame:
    everyone = scores.agg(F.countDistinct("email").alias("_all"))
    kept = scores if target_skills is None else scores.where(F.col("skill_name").isin(*target_skills))
    per = kept.groupBy("skill_name", "skill_category").agg(
        rounded(F.avg("skill_score"), 1).alias("avg_score"), F.countDistinct("email").alias("learners_with_skill")
    )
    return (
        per.crossJoin(F.broadcast(everyone))  # one row
        .select(
            "skill_name",
            "skill_category",
            "avg_score",
            "learners_with_skill",
            rounded(F.col("learners_with_skill") / F.col("_all") * 100, 1).alias("coverage_pct"),
            rounded(100 - F.col("avg_score"), 1).alias("gap_index"),
        )
        .orderBy(F.desc("gap_index"), "skill_name")
    )


def skill_distribution(scores: DataFrame) -> DataFrame:
    return (
        scores.groupBy("skill_category")
        .agg(
            F.countDistinct("email").alias("total_learners"),
            rounded(F.avg("skill_score"), 1).alias("avg_score"),
            F.count("skill_name").alias("total_skill_entries"),
            F.countDistinct("skill_name").alias("unique_skills"),
        )
        .orderBy(F.desc("total_learners"), "skill_category")
    )


def skill_timeline(
    activity: DataFrame, order_by: Sequence[str], skills: DataFrame | None = None, email: str | None = None
) -> DataFrame:
    """Best score so far of each learner and skill, along the enrolments."""
    skills = course_skills(activity) if skills is None else skills
    mine = activity if email is None else activity.where(F.col("email") == email)
    mine = mine.where(F.col("email").isNotNull())
    gained = F.greatest(
        F.lit(0.0), F.coalesce("progress_pct", F.lit(0.0)) * 0.7 + F.when(F.col("is_completed"), 30.0).otherwise(0.0)
    )
    ordering = [c for c in order_by if c != "enrollment_ts"]
    # the window reads its input several times: keep the few columns it needs
    slim = mine.select("email", "course_id", "enrollment_ts", *ordering, gained.alias("_gain"))
    rows = cut_lineage(slim.join(skills, "course_id"))
    best = ordered_window(rows, ["email", "skill_name"], ["enrollment_ts", *ordering], running_max={"_best": "_gain"})
    return best.select(
        "email",
        "course_id",
        "enrollment_ts",
        "skill_name",
        rounded(F.least(F.col("_best"), F.lit(100.0)), 1).alias("skill_score"),
    )


def skill_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.countDistinct("skill_name").alias("total_skills_tracked"),
        F.coalesce(rounded(F.avg("skill_score"), 1), F.lit(0.0)).alias("avg_skill_score"),
    )


def skill_metrics(activity: DataFrame, skills: DataFrame | None = None) -> dict[str, DataFrame]:
    scores = cut_lineage(skill_scores(activity, skills))
    return {
        "summary": skill_summary(scores),
        "skill_gaps": _skill_gaps(scores).limit(10),
        "org_distribution": skill_distribution(scores),
    }
