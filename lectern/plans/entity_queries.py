"""Queries on learners, courses, programs, videos and charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import charts, courses, learners, programs, videos
from lectern.plans.registry import Registry, as_doubles
from lectern.plans.sql import REF, days, rnd, with_tables
from lectern.plans.tables import REFERENCE_DATE, ROW_ID

ONE_LEARNER = "42"
ONE_VIDEO_LEARNER = "7"


def _learners(r: Registry) -> None:
    r.add(
        "lrn_1_active_vs_inactive",
        lambda t: learners.active_vs_inactive(t.course_activity(), REFERENCE_DATE, 365),
        with_tables(
            "ca",
            f"""SELECT active, inactive, active + inactive AS total,
                {rnd('active / (active + inactive) * 100', 1)} AS pct_active, 365 AS cutoff_days
            FROM (SELECT count(*) FILTER (WHERE l >= {REF} - INTERVAL 365 DAY) AS active,
                    count(*) FILTER (WHERE l < {REF} - INTERVAL 365 DAY) AS inactive
                FROM (SELECT max(last_activity_ts) AS l FROM ca GROUP BY email))""",
        ),
    )
    velocity = f"""SELECT email, sum(learning_hours) AS total_hours,
            max(greatest({days('last_activity_ts', 'enrollment_ts')} / 7, 1.0)) AS total_weeks FROM ca GROUP BY email"""
    speed = f"SELECT *, {rnd('total_hours / total_weeks', 2)} AS hours_per_week FROM v0"
    r.add(
        "lrn_2_learning_velocity",
        lambda t: learners.learning_velocity(t.course_activity()),
        with_tables(
            "ca",
            f"""SELECT email, {rnd('total_hours')} AS total_hours, {rnd('total_weeks')} AS total_weeks, hours_per_week
            FROM v1""",
            v0=velocity,
            v1=speed,
        ),
    )
    r.add(
        "lrn_3_completion_summary",
        lambda t: learners.completion_summary(t.course_activity()),
        with_tables(
            "ca",
            f"""SELECT count(*) AS total_enrollments, count(*) FILTER (WHERE is_completed) AS total_completed,
                {rnd('count(*) FILTER (WHERE is_completed) / count(*) * 100', 1)} AS completion_rate,
                {rnd('avg(progress_pct)', 1)} AS avg_progress,
                {rnd('quantile_cont(progress_pct, 0.5)', 1)} AS median_progress FROM ca""",
        ),
    )
    for dim in ("business_unit", "role", "location"):
        r.add(
            f"lrn_4_completion_by_{dim}",
            lambda t, dim=dim: learners.completion_by_dimension(t.course_activity(wide=True), dim),
            with_tables(
                "caw",
                f"""SELECT {dim}, count(*) AS enrollments, count(*) FILTER (WHERE is_completed) AS completed,
                    {rnd('avg(progress_pct)')} AS avg_progress, {rnd('avg(learning_hours)')} AS avg_hours,
                    {rnd('count(*) FILTER (WHERE is_completed) / count(*) * 100', 1)} AS completion_rate
                FROM caw GROUP BY {dim}""",
            ),
        )
    ranked = """SELECT email, count(*) FILTER (WHERE is_completed) AS courses_completed,
            sum(learning_hours) AS total_hours, avg(progress_pct) AS avg_progress, count(*) AS courses_enrolled
        FROM ca GROUP BY email"""
    score = "courses_completed * 10 + avg_progress * 0.5 + total_hours * 0.3"
    top = f"""SELECT email, courses_completed, {rnd('total_hours')} AS total_hours,
            {rnd('avg_progress')} AS avg_progress, courses_enrolled, {rnd(score)} AS score
        FROM ranked ORDER BY {score} DESC, email LIMIT 20"""
    for name in ("lrn_5_top_learners", "srt_2_top_k"):
        r.add(name, lambda t: learners.top_learners(t.course_activity()), with_tables("ca", top, ranked=ranked))
    stats = ", ".join(
        f"""SELECT '{c}' AS feature, {c} AS v FROM v1""" for c in ("total_hours", "total_weeks", "hours_per_week")
    ).replace(", SELECT", " UNION ALL SELECT")
    r.add(
        "lrn_6_velocity_describe",
        lambda t: learners.velocity_summary(t.course_activity()).select(
            "feature", "count", "mean", "std", "min", "q25", "median", "q75", "max"
        ),
        with_tables(
            "ca",
            f"""SELECT feature, count(v) AS count, {rnd('avg(v)')} AS mean, {rnd('stddev_samp(v)')} AS std,
                {rnd('min(v)')} AS min, {rnd('quantile_cont(v, 0.25)')} AS q25, {rnd('quantile_cont(v, 0.5)')} AS median,
                {rnd('quantile_cont(v, 0.75)')} AS q75, {rnd('max(v)')} AS max FROM long GROUP BY feature""",
            v0=velocity,
            v1=speed,
            long=stats,
        ),
    )
    r.add(
        "lrn_7_learner_detail_courses",
        lambda t: learners.learner_detail(t.course_activity(), ONE_LEARNER)["courses"],
        with_tables(
            "ca",
            f"""SELECT email, course_id, course_name, progress_pct, is_completed, {rnd('learning_hours')} AS learning_hours
            FROM ca WHERE email = '{ONE_LEARNER}'""",
        ),
    )
    r.add(
        "lrn_7_learner_detail_summary",
        lambda t: learners.learner_detail(t.course_activity(), ONE_LEARNER)["summary"],
        with_tables(
            "ca",
            f"""SELECT email, {rnd('sum(learning_hours)', 1)} AS total_hours, {rnd('avg(progress_pct)', 1)} AS avg_progress,
                count(*) FILTER (WHERE is_completed) AS courses_completed
            FROM ca WHERE email = '{ONE_LEARNER}' GROUP BY email""",
        ),
    )
    r.add(
        "lrn_7_learner_detail_engagement",
        lambda t: learners.learner_detail(t.course_activity(), ONE_VIDEO_LEARNER, t.engagement())["engagement"],
        with_tables(
            "eng",
            f"""SELECT email, score, category, {rnd('progress_component')} AS progress_component,
                {rnd('hours_component')} AS hours_component, video_component, recency_component
            FROM eng WHERE email = '{ONE_VIDEO_LEARNER}'""",
        ),
    )


RATES = f"""SELECT course_id, course_name, count(*) AS enrollments, count(*) FILTER (WHERE is_completed) AS completed,
        avg(progress_pct) AS avg_progress, avg(learning_hours) AS avg_hours, avg(grade) AS avg_grade,
        {rnd('count(*) FILTER (WHERE is_completed) / count(*) * 100', 1)} AS completion_rate
    FROM ca GROUP BY course_id, course_name"""
BUCKET = """CASE WHEN progress_pct < 0 THEN NULL WHEN progress_pct <= 10 THEN '0-10%' WHEN progress_pct <= 25 THEN '10-25%'
    WHEN progress_pct <= 50 THEN '25-50%' WHEN progress_pct <= 75 THEN '50-75%' WHEN progress_pct <= 90 THEN '75-90%'
    WHEN progress_pct <= 100 THEN '90-100%' END"""


def _courses(r: Registry) -> None:
    rates = with_tables(
        "ca",
        f"""SELECT course_id, course_name, enrollments, completed, {rnd('avg_progress')} AS avg_progress,
            {rnd('avg_hours')} AS avg_hours, {rnd('avg_grade')} AS avg_grade, completion_rate,
            {rnd('100 - completion_rate', 1)} AS drop_off_rate FROM rates""",
        rates=RATES,
    )
    for name in ("crs_1_completion_rates", "srt_1_sorted_rates"):
        r.add(name, lambda t: courses.completion_rates(t.course_activity()), rates)
    drop = f"""SELECT course_id, course_name, {BUCKET} AS progress_bucket, count(*) AS learner_count FROM ca
        GROUP BY ALL"""
    r.add("crs_2_drop_off", lambda t: courses.drop_off(t.course_activity()), with_tables("ca", drop))
    r.add(
        "crs_3_time_to_completion",
        lambda t: courses.time_to_completion(t.course_activity()),
        with_tables(
            "ca",
            f"""SELECT course_id, course_name, {rnd('avg(d)', 1)} AS avg_days, {rnd('quantile_cont(d, 0.5)', 1)} AS median_days,
                min(d) AS min_days, max(d) AS max_days, count(*) AS completions
            FROM (SELECT *, {days('completion_ts', 'enrollment_ts')} AS d FROM ca WHERE is_completed)
            GROUP BY course_id, course_name""",
        ),
    )
    r.add(
        "crs_3_time_to_completion_fallback",
        lambda t: courses.time_to_completion(t.course_activity().drop("completion_ts")),
        with_tables(
            "ca",
            f"""SELECT course_id, course_name, {rnd('avg(d)', 1)} AS avg_days, {rnd('quantile_cont(d, 0.5)', 1)} AS median_days,
                min(d) AS min_days, max(d) AS max_days, count(*) AS completions
            FROM (SELECT *, {days('last_activity_ts', 'enrollment_ts')} AS d FROM ca WHERE is_completed)
            GROUP BY course_id, course_name""",
        ),
    )
    r.add(
        "crs_4_engagement_vs_completion",
        lambda t: courses.engagement_vs_completion(t.course_activity()),
        with_tables(
            "ca",
            f"""SELECT course_id, {rnd('avg(learning_hours)')} AS avg_hours,
                {rnd('avg(CAST(is_completed AS INT)) * 100', 1)} AS completion_rate, {rnd('avg(progress_pct)')} AS avg_progress
            FROM ca GROUP BY course_id""",
        ),
    )
    r.add(
        "crs_5_course_summary",
        lambda t: courses.course_summary(t.course_activity()),
        with_tables(
            "ca",
            f"""SELECT {rnd('avg(completion_rate)', 1)} AS avg_completion_rate,
                {rnd('avg(' + rnd('100 - completion_rate', 1) + ')', 1)} AS avg_drop_off_rate, count(*) AS total_courses
            FROM rates""",
            rates=RATES,
        ),
    )
    r.add(
        "crs_6_completion_by_course_name",
        lambda t: courses.completion_by_course_name(t.course_activity()),
        with_tables(
            "ca",
            f"SELECT course_name, {rnd('avg(CAST(is_completed AS INT)) * 100')} AS completion_rate FROM ca GROUP BY course_name",
        ),
    )
    r.add(
        "crs_7_drop_off_totals",
        lambda t: courses.drop_off_totals(t.course_activity()),
        with_tables("ca", f"SELECT {BUCKET} AS progress_bucket, count(*) AS learner_count FROM ca GROUP BY ALL"),
    )


def _programs(r: Registry) -> None:
    rates = f"""SELECT program_id, program_name, count(*) AS enrollments, count(*) FILTER (WHERE is_completed) AS completed,
            {rnd('avg(progress_pct)')} AS avg_progress, {rnd('avg(learning_hours)')} AS avg_hours,
            {rnd('count(*) FILTER (WHERE is_completed) / count(*) * 100', 1)} AS success_rate
        FROM pa GROUP BY program_id, program_name"""
    r.add("prg_1_success_rates", lambda t: programs.success_rates(t.program_activity()), with_tables("pa", rates))
    r.add(
        "prg_2_courses_completed_distribution",
        lambda t: programs.courses_completed_distribution(t.program_activity()),
        with_tables(
            "pa",
            "SELECT program_id, program_name, courses_completed, count(*) AS learner_count FROM pa GROUP BY ALL",
        ),
    )
    r.add(
        "prg_3_progress_by_program",
        lambda t: programs.progress_by_program(t.program_activity()),
        with_tables(
            "pa",
            f"""SELECT program_id, program_name, {rnd('avg(progress_pct)', 1)} AS avg_progress,
                {rnd('quantile_cont(progress_pct, 0.5)', 1)} AS median_progress, count(DISTINCT email) AS learners
            FROM pa GROUP BY program_id, program_name""",
        ),
    )
    r.add(
        "prg_4_program_summary",
        lambda t: programs.program_summary(t.program_activity()),
        with_tables(
            "pa",
            f"SELECT {rnd('avg(success_rate)', 1)} AS avg_success_rate, count(*) AS total_programs FROM rates",
            rates=rates,
        ),
    )


def _videos(r: Registry) -> None:
    by = "video_id, video_name, course_id"
    watch = f"""SELECT {by}, CAST(sum(watch_count) AS BIGINT) AS total_watches, count(DISTINCT email) AS unique_viewers,
            {rnd('avg(watch_count)')} AS avg_watch_count FROM va GROUP BY {by}"""
    done = f"""SELECT {by}, {rnd('avg(completion_pct)', 1)} AS avg_completion,
            {rnd('quantile_cont(completion_pct, 0.5)')} AS median_completion, count(DISTINCT email) AS viewers
        FROM va GROUP BY {by}"""
    again = f"""SELECT {by}, CAST(sum(watch_count) AS BIGINT) AS total_rewatches, {rnd('avg(watch_count)', 1)} AS avg_rewatch_count,
            count(DISTINCT email) AS rewatchers FROM va WHERE watch_count > 1 GROUP BY {by}"""
    per_course = f"""SELECT course_id, count(DISTINCT video_id) AS total_videos, {rnd('sum(watch_seconds)')} AS total_watch_seconds,
            {rnd('avg(completion_pct)', 1)} AS avg_completion, {rnd('avg(watch_count)')} AS avg_watch_count,
            count(DISTINCT email) AS unique_viewers, {rnd('sum(watch_seconds) / 3600', 1)} AS total_watch_hours
        FROM va GROUP BY course_id"""
    r.add("vid_1_watch_frequency", lambda t: videos.watch_frequency(t.video_activity()), with_tables("va", watch))
    r.add("vid_2_video_completion", lambda t: videos.video_completion(t.video_activity()), with_tables("va", done))
    r.add("vid_3_rewatch_patterns", lambda t: videos.rewatch_patterns(t.video_activity()), with_tables("va", again))
    r.add(
        "vid_4_course_video_summary", lambda t: videos.course_video_summary(t.video_activity()), with_tables("va", per_course)
    )
    r.add(
        "vid_5_video_summary",
        lambda t: videos.video_summary(t.video_activity()),
        with_tables(
            "va",
            f"SELECT count(DISTINCT video_id) AS total_videos, {rnd('avg(avg_completion)', 1)} AS avg_completion FROM d",
            d=done,
        ),
    )
    tops = {
        "most_watched": ("total_watches DESC", watch),
        "most_rewatched": ("total_rewatches DESC", again),
        "lowest_completion": ("avg_completion", done),
    }
    for part, (order, sql) in tops.items():
        r.add(
            f"vid_5_{part}",
            lambda t, part=part: videos.video_metrics(t.video_activity())[part],
            with_tables("va", f"SELECT * FROM d ORDER BY {order}, {by} LIMIT 10", d=sql),
        )


def _histogram_sql(source: str, value: str, bins: int) -> str:
    return f"""SELECT b AS bin, {rnd(f'lo + (hi - lo) / {bins} * b')} AS low, {rnd(f'lo + (hi - lo) / {bins} * (b + 1)')} AS high,
            coalesce(n, 0) AS n
        FROM (SELECT CAST(unnest(range({bins})) AS INT) AS b), (SELECT min({value}) AS lo, max({value}) AS hi FROM {source})
        LEFT JOIN (SELECT CAST(least(floor(({value} - lo) / ((hi - lo) / {bins})), {bins - 1}) AS INT) AS b2, count(*) AS n
            FROM {source}, (SELECT min({value}) AS lo, max({value}) AS hi FROM {source}) GROUP BY b2) ON b = b2"""


def _charts(r: Registry) -> None:
    r.add(
        "kpi_1_executive_kpis",
        lambda t: charts.executive_kpis(t.course_activity(), t.engagement()),
        with_tables(
            "eng",
            f"""SELECT total_learners, total_learners AS active_learners, total_courses, overall_completion_rate,
                avg_engagement_score, at_risk_count, total_learning_hours,
                {rnd('total_learning_hours / total_learners', 1)} AS avg_hours_per_learner
            FROM (SELECT count(DISTINCT email) AS total_learners, count(DISTINCT course_id) AS total_courses,
                    {rnd('avg(CAST(is_completed AS INT)) * 100', 1)} AS overall_completion_rate,
                    {rnd('sum(learning_hours)', 1)} AS total_learning_hours FROM ca),
                (SELECT {rnd('avg(score)', 1)} AS avg_engagement_score,
                    count(*) FILTER (WHERE category = 'At-Risk') AS at_risk_count FROM eng)""",
        ),
    )
    r.add(
        "hst_1_progress_histogram",
        lambda t: charts.histogram(t.course_activity(), "progress_pct", 20),
        with_tables("ca", _histogram_sql("ca", "progress_pct", 20)),
    )
    r.add(
        "hst_1_hours_per_learner_histogram",
        lambda t: charts.histogram(learners.learning_velocity(t.course_activity()), "total_hours", 30),
        with_tables(
            "ca",
            _histogram_sql("w", "v", 30),
            w="SELECT coalesce(sum(learning_hours), 0) AS v FROM ca GROUP BY email",
        ),
    )
    r.add(
        "hst_1_score_histogram",
        lambda t: charts.histogram(t.engagement(), "score", 20),
        with_tables("eng", _histogram_sql("eng", "score", 20)),
    )
    years = range(1995, 2002)
    r.add(
        "pvt_1_cohort_pivot",
        lambda t: charts.cohort_pivot(
            t.course_activity(wide=True).withColumn("year", F.year("enrollment_ts")),
            "business_unit", "year", "progress_pct",
        ),
        with_tables(
            "caw",
            "SELECT business_unit, "
            + ", ".join(f"""{rnd(f'avg(progress_pct) FILTER (WHERE year(enrollment_ts) = {y})')} AS "{y}\"""" for y in years)
            + " FROM caw GROUP BY business_unit",
        ),
    )
    r.add(
        "tsr_1_time_series",
        lambda t: charts.time_series(t.video_activity(), "last_watch_ts", ["watch_count", "completion_pct"], [ROW_ID])
        .withColumnRenamed(ROW_ID, "rid"),
        with_tables(
            "va", f"SELECT last_watch_ts, rid, watch_count, {rnd('completion_pct')} AS completion_pct FROM va ORDER BY 1, 2"
        ),
    )
    r.add(
        "cnt_1_category_counts",
        lambda t: charts.category_counts(t.engagement(), "category"),
        with_tables("eng", "SELECT category, count(*) AS n FROM eng GROUP BY category"),
    )
    r.add(
        "flt_1_by_email",
        lambda t: charts.by_email(t.course_activity(), ONE_LEARNER).select("email", "course_id", "progress_pct"),
        with_tables("ca", f"SELECT email, course_id, progress_pct FROM ca WHERE email = '{ONE_LEARNER}'"),
    )
    r.add(
        "flt_2_engagement_listing",
        lambda t: charts.engagement_listing(t.engagement(), "Medium", 50).select("email", "score", "category"),
        with_tables(
            "eng",
            "SELECT email, score, category FROM eng WHERE category = 'Medium' ORDER BY score DESC, email LIMIT 50",
        ),
    )
    r.add(
        "flt_5_preview",
        lambda t: charts.preview(t.video_activity(), [ROW_ID]).select("email", "video_id", F.col(ROW_ID).alias("rid")),
        with_tables("va", "SELECT email, video_id, rid FROM va ORDER BY rid LIMIT 100"),
    )
    r.add(
        "set_1_tagged_union",
        lambda t: as_doubles(
            charts.tagged_union(
                {
                    "course": t.course_activity().select("email", "course_id", "progress_pct"),
                    "video": t.video_activity().select("email", "course_id", "watch_count"),
                    "program": t.program_activity().select("email", "program_id", "progress_pct"),
                }
            ),
            ["watch_count"],
        ),
        with_tables(
            "ca va pa",
            """SELECT email, course_id, progress_pct, NULL::DOUBLE AS watch_count, NULL::VARCHAR AS program_id, 'course' AS _source FROM ca
            UNION ALL SELECT email, course_id, NULL, watch_count, NULL, 'video' FROM va
            UNION ALL SELECT email, NULL, progress_pct, NULL, program_id, 'program' FROM pa""",
        ),
    )
    r.add(
        "set_3_distinct_courses",
        lambda t: t.course_activity().select("course_id", "course_name").distinct(),
        with_tables("ca", "SELECT DISTINCT course_id, course_name FROM ca"),
    )


def register(r: Registry) -> None:
    for part in (_learners, _courses, _programs, _videos, _charts):
        part(r)
