"""Insights: frames of zero, one or a few rows with category, severity and texts.

Two aggregations feed all insights on course activity: one per course name, business unit
and progress bin, and one per learner. They are a small fraction of the table, made in one pass and written once.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.exprs import flag_mean, right_closed_bins, rounded, total
from lectern.functions.fixed import INSIGHT_TEXTS
from lectern.operators.learners import moment
from lectern.session import cut_lineage

# Bins of the drop-off insight.
ZONE_EDGES = [0, 10, 25, 50, 75, 100]
ZONE_LABELS = ["0-10%", "10-25%", "25-50%", "50-75%", "75-100%"]

COLUMNS = ["category", "severity", "title", "description", "metric_value", "metadata"]


def shown(c: str | Column, digits: int) -> Column:
    """Number as text with a fixed number of decimals, rounded half to even."""
    return F.format_string(f"%.{digits}f", rounded(c, digits))


def _insight(
    rows: DataFrame,
    category: str,
    severity: str | Column,
    text: str,
    title: list[Column],
    description: list[Column],
    metric: Column | None,
    metadata: dict[str, Column] | None = None,
) -> DataFrame:
    heading, body = INSIGHT_TEXTS[text]
    pairs = [x for k, v in (metadata or {}).items() for x in (F.lit(k), v.cast("string"))]
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return rows.select(
        F.lit(category).alias("category"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        F.format_string(heading, *title).alias("title"),
        F.format_string(body, *description).alias("description"),
        (metric if metric is not None else F.lit(None)).cast("double").alias("metric_value"),
        (F.create_map(*pairs) if pairs else empty).alias("metadata"),
    )


def activity_cube(activity: DataFrame) -> DataFrame:
    """Counts per course name, business unit, completion and progress bin: one pass."""
    unit = next((F.col(f"`{c}`") for c in ("Business Unit", "business_unit") if c in activity.columns), None)
    hours = F.col("learning_hours") if "learning_hours" in activity.columns else F.lit(None).cast("double")
    return activity.groupBy(
        F.col("course_name"),
        (unit if unit is not None else F.lit(None).cast("string")).alias("unit"),
        F.col("is_completed").alias("done"),
        right_closed_bins("progress_pct", ZONE_EDGES, ZONE_LABELS).alias("zone"),
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("email").alias("emails"),
        F.sum(hours).alias("hours"),
        F.count(hours).alias("hours_n"),
    )


def learner_cube(activity: DataFrame) -> DataFrame:
    """Any completion and total hours per learner: one pass."""
    return (
        activity.where(F.col("email").isNotNull())
        .groupBy("email")
        .agg(F.coalesce(F.max("is_completed"), F.lit(False)).alias("has_completion"), total("learning_hours").alias("hours"))
    )


def written_cubes(activity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`activity_cube` and `learner_cube` from one pass over the activity, written."""
    unit = next((F.col(f"`{c}`") for c in ("Business Unit", "business_unit") if c in activity.columns), None)
    hours = F.col("learning_hours") if "learning_hours" in activity.columns else F.lit(None).cast("double")
    rows = activity.select(
        "course_name",
        (unit if unit is not None else F.lit(None).cast("string")).alias("unit"),
        F.col("is_completed").alias("done"),
        right_closed_bins("progress_pct", ZONE_EDGES, ZONE_LABELS).alias("zone"),
        "email",
        F.col("email").isNotNull().alias("_known"),
        F.col("is_completed").alias("_done"),
        hours.alias("_hours"),
    )
    per_bin, per_learner = ["course_name", "unit", "done", "zone"], ["email"]
    sets = [[F.col(c) for c in names] for names in (per_bin, per_learner)]
    both = cut_lineage(
        rows.groupingSets(sets, *[F.col(c) for c in per_bin + per_learner]).agg(
            F.grouping("email").alias("_bin"),
            F.count(F.lit(1)).alias("n"),
            F.count_if("_known").alias("emails"),
            F.sum("_hours").alias("hours"),
            F.count("_hours").alias("hours_n"),
            F.coalesce(F.max("_done"), F.lit(False)).alias("has_completion"),
        )
    )
    cube = both.where("_bin = 1").select(*per_bin, "n", "emails", "hours", "hours_n")
    learners = both.where("_bin = 0 AND email IS NOT NULL").select("email", "has_completion", F.coalesce("hours", F.lit(0)).alias("hours"))
    return cut_lineage(cube), learners  # the cube is small and read often


def _rate(cube: DataFrame, *by: str) -> DataFrame:
    known = cube.where(F.col("done").isNotNull())
    grouped = known.groupBy(*by) if by else known.groupBy()
    share = F.sum(F.when(F.col("done"), F.col("n")).otherwise(0)) / F.sum("n") * 100
    return grouped.agg(share.alias("rate"))


def overall_completion(cube: DataFrame) -> DataFrame:
    rows = _rate(cube)
    pct, rate = shown("rate", 1), F.col("rate")
    low = _insight(rows.where(rate < 30), "completion", "critical", "completion_low", [pct], [pct], rate)
    below = rows.where((rate >= 30) & (rate < 50))
    return low.unionByName(_insight(below, "completion", "warning", "completion_below", [pct], [pct], rate))


def course_extremes(cube: DataFrame) -> DataFrame:
    """Worst and best course; the first name wins a tie."""
    rates = _rate(cube.where(F.col("course_name").isNotNull()), "course_name")
    ends = rates.agg(
        F.min(F.struct("rate", "course_name")).alias("w"),
        F.min(F.struct((-F.col("rate")).alias("key"), F.col("course_name"), F.col("rate"))).alias("b"),
    )
    out = None
    for side, text, severity, cond in (
        ("w", "course_worst", "warning", F.col("w.rate") < 15),
        ("b", "course_best", "info", F.col("b.rate") > 60),
    ):
        name, rate = F.col(f"{side}.course_name"), F.col(f"{side}.rate")
        part = _insight(
            ends.where(cond), "course", severity, text, [name, shown(rate, 1)], [], rate, {"course": name}
        )
        out = part if out is None else out.unionByName(part)
    return out


def engagement_ratio(learners: DataFrame, scores: DataFrame) -> DataFrame:
    """Completion among highly engaged learners against the others, if both groups exceed five."""
    both = learners.join(scores.select("email", "category"), "email")
    done = F.col("has_completion").cast("int") * 100.0
    high, low = F.col("category") == "High", F.col("category").isin("Low", "At-Risk")
    row = both.agg(
        F.count_if(high).alias("nh"),
        F.count_if(low).alias("nl"),
        F.avg(F.when(high, done)).alias("h"),
        F.avg(F.when(low, done)).alias("l"),
    ).where((F.col("nh") > 5) & (F.col("nl") > 5))
    ratio = F.when(F.col("l") > 0, F.try_divide(F.col("h"), F.col("l"))).otherwise(F.lit(float("inf")))
    row = row.withColumn("ratio", ratio).where(F.col("ratio") > 1.5)
    text = F.when(F.col("ratio") == float("inf"), "inf").otherwise(shown("ratio", 1))
    return _insight(
        row, "engagement", "info", "engagement_ratio", [text], [shown("h", 0), shown("l", 0)], F.col("ratio")
    )


def at_risk_share(scores: DataFrame) -> DataFrame:
    row = scores.agg(
        F.count_if(F.col("category") == "At-Risk").alias("k"), F.count(F.lit(1)).alias("n")
    ).where(F.col("k") > 0)
    pct = F.col("k") / F.col("n") * 100
    severity = F.when(pct > 25, "critical").otherwise("warning")
    count = F.col("k").cast("string")
    return _insight(row, "engagement", severity, "at_risk", [count, shown(pct, 1)], [], pct, {"at_risk_count": F.col("k")})


def drop_off_zone(cube: DataFrame) -> DataFrame:
    """Progress bin with most non-completers; the lower bin wins a tie."""
    zones = cube.where(~F.col("done")).groupBy("zone").agg(F.sum("n").alias("k"))
    place = F.coalesce(*[F.when(F.col("zone") == z, F.lit(-i)) for i, z in enumerate(ZONE_LABELS)])
    row = zones.agg(
        F.sum("k").alias("all"),
        F.max(F.when(F.col("zone").isNotNull(), F.struct(F.col("k"), place.alias("p"), F.col("zone")))).alias("top"),
    ).where(F.col("top").isNotNull())
    zone, k = F.col("top.zone"), F.col("top.k")
    pct = k / F.col("all") * 100
    return _insight(
        row, "drop_off", "warning", "drop_off", [zone, shown(pct, 0)], [k.cast("string"), zone], pct
    )


def weak_business_units(cube: DataFrame) -> DataFrame:
    """Units of at least ten rows whose rate is over 15 points below the unweighted mean of units."""
    done = F.sum(F.when(F.col("done"), F.col("n")).otherwise(0))
    known = F.sum(F.when(F.col("done").isNotNull(), F.col("n")))
    units = (
        cube.where(F.col("unit").isNotNull())
        .groupBy("unit")
        .agg(
            (done / known * 100).alias("rate"),
            F.try_divide(F.sum("hours"), F.sum("hours_n")).alias("hours"),
            F.sum("emails").alias("k"),
        )
    )
    mean = units.agg(F.avg("rate").alias("mean"))
    gap = F.col("rate") - F.col("mean")
    weak = units.crossJoin(F.broadcast(mean)).where((gap < -15) & (F.col("k") >= 10))  # one row
    return _insight(
        weak,
        "business_unit",
        "warning",
        "business_unit",
        [F.col("unit"), shown(F.abs(gap), 0)],
        [shown("rate", 1), shown("mean", 1), shown("hours", 1)],
        F.col("rate"),
        {"business_unit": F.col("unit")},
    )


def low_video_completion(videos: DataFrame) -> DataFrame:
    row = videos.agg(F.avg("completion_pct").alias("rate")).where(F.col("rate") < 50)
    return _insight(row, "video", "warning", "video_low", [shown("rate", 1)], [], F.col("rate"))


def most_rewatched_video(videos: DataFrame) -> DataFrame:
    """Video with most watches among rows with more than two, if over ten such rows exist."""
    per = (
        videos.where(F.col("watch_count") > 2)
        .groupBy("video_name")
        .agg(F.sum("watch_count").alias("w"), F.count(F.lit(1)).alias("n"))
    )
    named = F.when(F.col("video_name").isNotNull(), F.struct((-F.col("w")).alias("w"), F.col("video_name")))
    row = per.agg(F.sum("n").alias("n"), F.min(named).alias("top")).where((F.col("n") > 10) & F.col("top").isNotNull())
    name = F.col("top.video_name")
    return _insight(row, "video", "info", "video_rewatched", [name], [], None, {"video": name})


def low_program_completion(programs: DataFrame) -> DataFrame:
    row = programs.agg((flag_mean("is_completed") * 100).alias("rate")).where(F.col("rate") < 20)
    return _insight(row, "program", "warning", "program_low", [shown("rate", 1)], [], F.col("rate"))


def mean_hours(learners: DataFrame) -> DataFrame:
    row = learners.agg(F.avg("hours").alias("h"))
    return _insight(row, "engagement", "info", "mean_hours", [shown("h", 1)], [], F.col("h"))


def severity_rank(c: str = "severity") -> Column:
    s = F.col(c)
    return F.when(s == "critical", 0).when(s == "warning", 1).when(s == "info", 2).otherwise(3)


def all_insights(
    activity: DataFrame,
    scores: DataFrame | None = None,
    videos: DataFrame | None = None,
    programs: DataFrame | None = None,
    *,
    generated_at: datetime | str,
) -> DataFrame:
    """Every insight, by severity and then in the order of the generators."""
    cube, learners = written_cubes(activity)
    parts = [overall_completion(cube), course_extremes(cube)]
    if scores is not None:
        scores = cut_lineage(scores.select("email", "category"))  # read twice
        parts += [engagement_ratio(learners, scores), at_risk_share(scores)]
    parts.append(drop_off_zone(cube))
    if {"Business Unit", "business_unit"} & set(activity.columns):
        parts.append(weak_business_units(cube))
    if videos is not None:
        parts += [low_video_completion(videos), most_rewatched_video(videos)]
    if programs is not None:
        parts.append(low_program_completion(programs))
    if "learning_hours" in activity.columns:
        parts.append(mean_hours(learners))
    out = None
    for i, part in enumerate(parts):
        tagged = part.withColumn("_order", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged)
    ordered = out.orderBy(severity_rank(), "_order", "title")
    return ordered.select(*COLUMNS, moment(generated_at).alias("generated_at"))


def by_severity(insights: DataFrame, severity: str) -> DataFrame:
    return insights.where(F.col("severity") == severity)
