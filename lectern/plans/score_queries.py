"""Queries on engagement, skills and insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.fixed import DEFAULT_SKILL, INSIGHT_TEXTS, KEYWORD_SKILLS, SKILL_CATEGORIES
from lectern.operators import charts, engagement, insights, skills
from lectern.plans.registry import Registry
from lectern.plans.sql import days, quoted, rnd, values, with_tables
from lectern.plans.tables import REFERENCE_DATE, ROW_ID, Tables

TARGET_SKILLS = ["Python", "SQL", "Leadership", "Finance"]


def _engagement(r: Registry) -> None:
    r.add(
        "eng_1_progress_component",
        lambda t: engagement.progress_component(t.course_activity()),
        with_tables("e_progress", f"SELECT email, {rnd('progress_component')} AS progress_component FROM e_progress"),
    )
    r.add(
        "eng_2_hours_component",
        lambda t: engagement.hours_component(t.course_activity()),
        with_tables(
            "e_hours",
            f"SELECT email, {rnd('total_hours')} AS total_hours, {rnd('hours_component')} AS hours_component FROM e_hours",
        ),
    )
    r.add(
        "eng_3_video_component",
        lambda t: engagement.video_component(t.video_activity()),
        with_tables("e_video", "SELECT email, video_component FROM e_video"),
    )
    r.add(
        "eng_4_recency_component",
        lambda t: engagement.recency_component(t.course_activity(), REFERENCE_DATE),
        with_tables("e_recency", "SELECT email, recency_component FROM e_recency"),
    )
    full = f"""SELECT email, score, category, {rnd('progress_component')} AS progress_component,
        {rnd('hours_component')} AS hours_component, video_component, recency_component FROM eng"""
    r.add("eng_5_engagement_scores", lambda t: t.engagement(), with_tables("eng", full))
    r.add(
        "eng_6_category_distribution",
        lambda t: engagement.score_summary(t.engagement()),
        with_tables(
            "eng",
            f"""SELECT count(*) AS total_learners, {rnd('avg(score)', 1)} AS avg_score,
                {rnd('quantile_cont(score, 0.5)', 1)} AS median_score,
                count(*) FILTER (WHERE category = 'High') AS high, count(*) FILTER (WHERE category = 'Medium') AS medium,
                count(*) FILTER (WHERE category = 'Low') AS low, count(*) FILTER (WHERE category = 'At-Risk') AS at_risk
            FROM eng""",
        ),
    )
    r.add(
        "scl_13_threshold_labels",
        lambda t: t.program_activity().select(ROW_ID, engagement.category("progress_pct").alias("label"))
        .withColumnRenamed(ROW_ID, "rid"),
        with_tables(
            "pa",
            """SELECT rid, CASE WHEN progress_pct >= 75 THEN 'High' WHEN progress_pct >= 50 THEN 'Medium'
                WHEN progress_pct >= 25 THEN 'Low' ELSE 'At-Risk' END AS label FROM pa""",
        ),
    )


def _named_activity(t: Tables):
    """Course activity under names that hold skill words: the part names behind the courses."""
    parts = t.raw("part").select("p_partkey", "p_name", "p_type")
    lines = t.raw("lineitem").select("l_partkey", "l_quantity").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    topics = F.array(
        *[F.lit(x) for x in ("Python", "JavaScript", "Building Cloud", "R Programming", "Pottery", "AI Design")]
    )
    topic = F.get(topics, (F.col("p_partkey") % 6).cast("int"))
    return lines.select(
        F.concat(F.lit("P-"), (F.col("p_partkey") % 40).cast("string")).alias("course_id"),
        F.concat(topic, F.lit(" "), F.col("p_name")).alias("course_name"),
        F.lit("x").alias("email"),
        (F.col("l_quantity") * 2).alias("progress_pct"),
    )


NAMED = """SELECT 'P-' || (p_partkey % 40) AS course_id,
        ['Python', 'JavaScript', 'Building Cloud', 'R Programming', 'Pottery', 'AI Design'][p_partkey % 6 + 1] || ' ' || p_name
            AS course_name
    FROM lineitem JOIN part ON l_partkey = p_partkey"""


def _skills(r: Registry) -> None:
    scores_sql = f"""SELECT email, skill_name, skill_category, {rnd('avg_progress')} AS avg_progress, courses_contributing,
        courses_completed, skill_score FROM scores"""
    for name in ("skl_3_skill_scores", "jon_6_map_join"):
        r.add(name, lambda t: skills.skill_scores(t.course_activity()), with_tables("scores", scores_sql))
    r.add(
        "skl_1_chosen_skill_map",
        lambda t: skills.course_skills(t.course_activity()),
        with_tables("course_skills", "SELECT course_id, skill_name FROM course_skills"),
    )
    words = values([(w, s) for w, x in KEYWORD_SKILLS.items() for s in x])
    keyword = f"""SELECT course_id, coalesce(skill_name, {quoted(DEFAULT_SKILL)}) AS skill_name FROM (
            SELECT DISTINCT c.course_id, h.skill_name FROM (SELECT DISTINCT course_id FROM named) c
            LEFT JOIN (SELECT DISTINCT n.course_id, k.skill_name FROM (SELECT DISTINCT * FROM named) n
                JOIN (VALUES {words}) k(word, skill_name) ON contains(lower(n.course_name), k.word)) h
            ON c.course_id = h.course_id)"""
    for name in ("skl_2_keyword_mapping", "jon_5_keyword_theta_join", "scl_10_substring_match"):
        r.add(name, lambda t: skills.keyword_skills(_named_activity(t)), with_tables("", keyword, named=NAMED))
    r.add(
        "skl_4_skill_profile",
        lambda t: skills.skill_profile(t.course_activity(), "42"),
        with_tables("scores", scores_sql + " WHERE email = '42'"),
    )
    gap = f"""SELECT skill_name, skill_category, avg_score, learners_with_skill, coverage_pct,
            {rnd('100 - avg_score', 1)} AS gap_index
        FROM (SELECT skill_name, skill_category, {rnd('avg(skill_score)', 1)} AS avg_score,
                count(DISTINCT email) AS learners_with_skill,
                {rnd('count(DISTINCT email) / (SELECT count(DISTINCT email) FROM scores) * 100', 1)} AS coverage_pct
            FROM scores GROUP BY skill_name, skill_category)"""
    r.add(
        "skl_5_skill_gaps",
        lambda t: skills.skill_gaps(skills.skill_scores(t.course_activity())),
        with_tables("scores", gap),
    )
    r.add(
        "flt_4_target_skills",
        lambda t: skills.skill_gaps(skills.skill_scores(t.course_activity()), TARGET_SKILLS),
        with_tables("scores", gap + f" WHERE skill_name IN ({', '.join(quoted(s) for s in TARGET_SKILLS)})"),
    )
    r.add(
        "skl_6_skill_distribution",
        lambda t: skills.skill_distribution(skills.skill_scores(t.course_activity())),
        with_tables(
            "scores",
            f"""SELECT skill_category, count(DISTINCT email) AS total_learners, {rnd('avg(skill_score)', 1)} AS avg_score,
                count(*) AS total_skill_entries, count(DISTINCT skill_name) AS unique_skills
            FROM scores GROUP BY skill_category""",
        ),
    )
    timeline = f"""SELECT email, course_id, enrollment_ts, skill_name, {rnd('least(best, 100.0)', 1)} AS skill_score
        FROM (SELECT *, max(greatest(progress_pct * 0.7 + CASE WHEN is_completed THEN 30.0 ELSE 0.0 END, 0.0)) OVER
                (PARTITION BY email, skill_name ORDER BY enrollment_ts, rid
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best
            FROM car JOIN course_skills USING (course_id))"""
    for name in ("skl_7_skill_timeline", "win_4_running_maximum"):
        r.add(
            name,
            lambda t: skills.skill_timeline(t.course_activity(), [ROW_ID]),
            with_tables("car course_skills", timeline),
        )
    r.add(
        "skl_8_skill_summary",
        lambda t: skills.skill_metrics(t.course_activity())["summary"],
        with_tables(
            "scores",
            f"SELECT count(DISTINCT skill_name) AS total_skills_tracked, {rnd('avg(skill_score)', 1)} AS avg_skill_score FROM scores",
        ),
    )
    r.add(
        "skl_8_top_gaps",
        lambda t: skills.skill_metrics(t.course_activity())["skill_gaps"],
        with_tables("scores", gap + " ORDER BY gap_index DESC, skill_name LIMIT 10"),
    )
    known = values([(s, c) for c, x in SKILL_CATEGORIES.items() for s in x])
    lookup = f"""SELECT skill_name, coalesce(c, 'Other') AS skill_category, count(*) AS courses
        FROM ({keyword}) LEFT JOIN (VALUES {known}) k(s, c) ON skill_name = s GROUP BY ALL"""
    for name in ("skl_9_taxonomy_lookup", "scl_12_dictionary_lookup"):
        r.add(
            name,
            lambda t: skills.keyword_skills(_named_activity(t))
            .groupBy("skill_name", skills.skill_category("skill_name").alias("skill_category"))
            .agg(F.count(F.lit(1)).alias("courses")),
            with_tables("", lookup, named=NAMED),
        )


def _text(c: str, digits: int) -> str:
    return f"format('{{:.{digits}f}}', {rnd(c, digits)})"


def _templ(text: str, args: list[str]) -> str:
    """SQL concatenation of a %s template."""
    pieces = [quoted(p.replace("%%", "%")) for p in text.split("%s")]
    out = pieces[0]
    for arg, piece in zip(args, pieces[1:]):
        out += f" || {arg} || {piece}"
    return out


def _insight(name: str, category: str, severity: str, title: list[str], body: list[str], metric: str, source: str) -> str:
    heading, text = INSIGHT_TEXTS[name]
    return f"""SELECT {quoted(category)} AS category, {severity} AS severity, {_templ(heading, title)} AS title,
        {_templ(text, body)} AS description, {metric} AS metric_value FROM ({source})"""


SEVERITY = {s: quoted(s) for s in ("critical", "warning", "info")}
RATE = "avg(CAST(is_completed AS INT)) * 100"
COURSE_RATES = f"SELECT course_name, {RATE} AS rate FROM ca GROUP BY course_name"
ZONE = """CASE WHEN progress_pct < 0 THEN NULL WHEN progress_pct <= 10 THEN '0-10%' WHEN progress_pct <= 25 THEN '10-25%'
    WHEN progress_pct <= 50 THEN '25-50%' WHEN progress_pct <= 75 THEN '50-75%' WHEN progress_pct <= 100 THEN '75-100%' END"""
LEARNER_DONE = "SELECT email, bool_or(is_completed) AS has, sum(learning_hours) AS hours FROM ca GROUP BY email"
UNITS = f"""SELECT unit, count(*) AS k, {RATE} AS rate, avg(learning_hours) AS hours FROM cu GROUP BY unit"""


def insight_sql() -> dict[str, str]:
    return {
        "overall": _insight(
            "completion_low", "completion", SEVERITY["critical"], [_text("rate", 1)], [_text("rate", 1)], rnd("rate"),
            f"SELECT * FROM (SELECT {RATE} AS rate FROM ca) WHERE rate < 30",
        )
        + " UNION ALL "
        + _insight(
            "completion_below", "completion", SEVERITY["warning"], [_text("rate", 1)], [_text("rate", 1)], rnd("rate"),
            f"SELECT * FROM (SELECT {RATE} AS rate FROM ca) WHERE rate >= 30 AND rate < 50",
        ),
        "courses": _insight(
            "course_worst", "course", SEVERITY["warning"], ["course_name", _text("rate", 1)], [], rnd("rate"),
            f"SELECT * FROM (SELECT * FROM ({COURSE_RATES}) ORDER BY rate, course_name LIMIT 1) WHERE rate < 15",
        )
        + " UNION ALL "
        + _insight(
            "course_best", "course", SEVERITY["info"], ["course_name", _text("rate", 1)], [], rnd("rate"),
            f"SELECT * FROM (SELECT * FROM ({COURSE_RATES}) ORDER BY rate DESC, course_name LIMIT 1) WHERE rate > 60",
        ),
        "ratio": _insight(
            "engagement_ratio", "engagement", SEVERITY["info"],
            [f"CASE WHEN l > 0 THEN {_text('h / l', 1)} ELSE 'inf' END"], [_text("h", 0), _text("l", 0)],
            f"CASE WHEN l > 0 THEN {rnd('h / l')} ELSE CAST('inf' AS DOUBLE) END",
            f"""SELECT * FROM (SELECT avg(CAST(has AS INT)) FILTER (WHERE category = 'High') * 100 AS h,
                    avg(CAST(has AS INT)) FILTER (WHERE category IN ('Low', 'At-Risk')) * 100 AS l,
                    count(*) FILTER (WHERE category = 'High') AS nh,
                    count(*) FILTER (WHERE category IN ('Low', 'At-Risk')) AS nl
                FROM ({LEARNER_DONE}) JOIN eng USING (email))
            WHERE nh > 5 AND nl > 5 AND (l = 0 OR h / l > 1.5)""",
        ),
        "at_risk": _insight(
            "at_risk", "engagement", "CASE WHEN pct > 25 THEN 'critical' ELSE 'warning' END",
            ["CAST(k AS VARCHAR)", _text("pct", 1)], [], rnd("pct"),
            """SELECT *, k / n * 100 AS pct FROM (SELECT count(*) FILTER (WHERE category = 'At-Risk') AS k, count(*) AS n
                FROM eng) WHERE k > 0""",
        ),
        "drop_off": _insight(
            "drop_off", "drop_off", SEVERITY["warning"], ["zone", _text("pct", 0)], ["CAST(k AS VARCHAR)", "zone"], rnd("pct"),
            f"""SELECT zone, k, k / (SELECT count(*) FROM ca WHERE NOT is_completed) * 100 AS pct
                FROM (SELECT {ZONE} AS zone, count(*) AS k FROM ca WHERE NOT is_completed GROUP BY 1)
                WHERE zone IS NOT NULL ORDER BY k DESC, zone LIMIT 1""",
        ),
        "units": _insight(
            "business_unit", "business_unit", SEVERITY["warning"], ["unit", _text("abs(gap)", 0)],
            [_text("rate", 1), _text("mean", 1), _text("hours", 1)], rnd("rate"),
            f"""SELECT *, rate - mean AS gap FROM ({UNITS}), (SELECT avg(rate) AS mean FROM ({UNITS}))
                WHERE rate - mean < -15 AND k >= 10""",
        ),
        "video": _insight(
            "video_low", "video", SEVERITY["warning"], [_text("rate", 1)], [], rnd("rate"),
            "SELECT * FROM (SELECT avg(completion_pct) AS rate FROM va) WHERE rate < 50",
        ),
        "rewatched": _insight(
            "video_rewatched", "video", SEVERITY["info"], ["video_name"], [], "NULL::DOUBLE",
            """SELECT * FROM (SELECT video_name, sum(watch_count) AS w, sum(count(*)) OVER () AS n FROM va
                WHERE watch_count > 2 GROUP BY video_name) WHERE n > 10 ORDER BY w DESC, video_name LIMIT 1""",
        ),
        "program": _insight(
            "program_low", "program", SEVERITY["warning"], [_text("rate", 1)], [], rnd("rate"),
            f"SELECT * FROM (SELECT {RATE} AS rate FROM pg) WHERE rate < 20",
        ),
        "hours": _insight(
            "mean_hours", "engagement", SEVERITY["info"], [_text("h", 1)], [], rnd("h"),
            f"SELECT avg(hours) AS h FROM ({LEARNER_DONE})",
        ),
    }


# all enrolments with little progress belong to one unit, so that a weak unit exists
UNIT_SQL = "SELECT *, CASE WHEN progress_pct < 84 THEN 'Field' ELSE role END AS unit FROM ca"


def _unit_activity(t: Tables):
    unit = F.when(F.col("progress_pct") < 84, "Field").otherwise(F.col("role"))
    return t.course_activity().withColumn("business_unit", unit)


def _ratio_by_year(t: Tables):
    """Each learner's years as learners of their own, with categories by mean progress."""
    year = F.concat("email", F.lit("-"), F.year("enrollment_ts").cast("string"))
    yearly = t.course_activity().withColumn("email", year)
    scores = engagement.progress_component(yearly).select("email", engagement.category("progress_component").alias("category"))
    return insights.engagement_ratio(insights.learner_cube(yearly), scores)


RATIO_TABLES = {
    "cy": "SELECT * REPLACE (email || '-' || year(enrollment_ts) AS email) FROM ca",
    "ey": """SELECT email, CASE WHEN m >= 75 THEN 'High' WHEN m >= 50 THEN 'Medium' WHEN m >= 25 THEN 'Low' ELSE 'At-Risk' END
        AS category FROM (SELECT email, avg(progress_pct) AS m FROM cy GROUP BY email)""",
}


def _finished_programs(t: Tables):
    """Programs that count as completed only if two thirds of the courses are."""
    return t.program_activity().withColumn("is_completed", F.col("progress_pct") >= 66)


FINISHED = "SELECT email, progress_pct >= 66 AS is_completed FROM pa"


def _insights(r: Registry) -> None:
    sql = insight_sql()
    shown = ["category", "severity", "title", "description", "metric_value"]
    extra = {"cu": UNIT_SQL, "pg": FINISHED}

    def add(name: str, run, part: str) -> None:
        body = f"SELECT * FROM ({sql[part]})"
        r.add(name, lambda t: run(t).select(*shown), with_tables("ca eng va pa", body, **extra))

    add("ins_1_overall_completion", lambda t: insights.overall_completion(insights.activity_cube(t.course_activity())), "overall")
    add("ins_2_course_extremes", lambda t: insights.course_extremes(insights.activity_cube(t.course_activity())), "courses")
    add("ins_3_engagement_ratio", lambda t: insights.engagement_ratio(insights.learner_cube(t.course_activity()), t.engagement()), "ratio")
    r.add(
        "ins_3_engagement_ratio_by_year",
        lambda t: _ratio_by_year(t).select(*shown),
        with_tables("ca", sql["ratio"].replace("FROM ca ", "FROM cy ").replace("JOIN eng ", "JOIN ey "), **RATIO_TABLES),
    )
    add("ins_4_at_risk_share", lambda t: insights.at_risk_share(t.engagement()), "at_risk")
    add("ins_5_drop_off_zone", lambda t: insights.drop_off_zone(insights.activity_cube(t.course_activity())), "drop_off")
    add("ins_6_weak_business_units", lambda t: insights.weak_business_units(insights.activity_cube(_unit_activity(t))), "units")
    add("ins_7_low_video_completion", lambda t: insights.low_video_completion(t.video_activity()), "video")
    add("ins_8_most_rewatched_video", lambda t: insights.most_rewatched_video(t.video_activity()), "rewatched")
    add("ins_9_low_program_completion", lambda t: insights.low_program_completion(_finished_programs(t)), "program")
    add("ins_10_mean_hours", lambda t: insights.mean_hours(insights.learner_cube(t.course_activity())), "hours")

    def everything(t: Tables):
        return insights.all_insights(
            _unit_activity(t), t.engagement(), t.video_activity(), _finished_programs(t), generated_at=REFERENCE_DATE
        )

    union = " UNION ALL ".join(f"SELECT * FROM ({s})" for s in sql.values())
    r.add(
        "ins_11_all_insights",
        lambda t: everything(t).select(*shown),
        with_tables("ca eng va pa", union, **extra),
    )
    r.add(
        "srt_4_severity_rank",
        lambda t: everything(t).select("title", insights.severity_rank().alias("severity_rank")),
        with_tables(
            "ca eng va pa",
            f"""SELECT title, CAST(CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END AS INT)
                AS severity_rank FROM ({union})""",
            **extra,
        ),
    )
    r.add(
        "flt_3_by_severity",
        lambda t: insights.by_severity(everything(t), "warning").select("title", "severity"),
        with_tables("ca eng va pa", f"SELECT title, severity FROM ({union}) WHERE severity = 'warning'", **extra),
    )
    r.add(
        "srt_3_best_and_worst_course",
        lambda t: t.course_activity()
        .groupBy("course_name").agg((F.avg(F.col("is_completed").cast("int")) * 100).alias("rate"))
        .agg(
            F.min(F.struct("rate", "course_name")).getField("course_name").alias("worst"),
            F.min(F.struct((-F.col("rate")).alias("k"), F.col("course_name"))).getField("course_name").alias("best"),
        ),
        with_tables(
            "ca",
            f"""SELECT (SELECT course_name FROM ({COURSE_RATES}) ORDER BY rate, course_name LIMIT 1) AS worst,
                (SELECT course_name FROM ({COURSE_RATES}) ORDER BY rate DESC, course_name LIMIT 1) AS best""",
        ),
    )
    r.add(
        "jon_4_engagement_and_completion",
        lambda t: insights.learner_cube(t.course_activity()).select("email", "has_completion")
        .join(t.engagement().select("email", "score", "category"), "email"),
        with_tables(
            "ca eng",
            f"SELECT email, has AS has_completion, score, category FROM ({LEARNER_DONE}) JOIN eng USING (email)",
        ),
    )


def register(r: Registry) -> None:
    for part in (_engagement, _skills, _insights):
        part(r)
