"""Queries on cleaning, transformation, integration and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.exprs import number, timestamp, whole_days, yes_no
from lectern.operators import charts, cleaning, features, integration, transformation
from lectern.operators.learners import moment
from lectern.plans.registry import Registry, as_doubles
from lectern.plans.sql import PROBE_WEIGHTS, REF, days, rnd, with_tables
from lectern.plans.tables import REFERENCE_DATE, ROW_ID, Tables

ORDER = (ROW_ID,)


def _scalars(r: Registry) -> None:
    r.add(
        "scl_1_yes_no",
        lambda t: t.course_export().groupBy("Completed", yes_no("Completed").alias("flag")).agg(F.count(F.lit(1)).alias("n"))
        .withColumnRenamed("Completed", "answer"),
        with_tables(
            "ca",
            "SELECT CASE WHEN is_completed THEN 'Yes' ELSE 'No' END AS answer, is_completed AS flag, count(*) AS n FROM ca GROUP BY ALL",
        ),
    )
    r.add(
        "scl_2_numeric_coercion",
        lambda t: t.dirty_orders().select(
            F.col(ROW_ID).alias("rid"), number("amount_text").alias("amount"), number("amount_text", 0.0).alias("amount_or_zero")
        ),
        with_tables(
            "dirty",
            """SELECT rid, TRY_CAST(amount_text AS DOUBLE) AS amount, coalesce(TRY_CAST(amount_text AS DOUBLE), 0) AS amount_or_zero
            FROM dirty""",
        ),
    )
    times = """coalesce(try_strptime(order_date, '%Y-%m-%d'), try_strptime(order_date, '%m/%d/%Y %I:%M %p'))"""
    for name in ("scl_3_timestamp_coercion", "cln_9_timestamp_normalisation"):
        r.add(
            name,
            lambda t: cleaning.normalise_timestamps(t.dirty_orders(), ["order_date"]).select(
                F.col(ROW_ID).alias("rid"), "order_date"
            ),
            with_tables("dirty", f"SELECT rid, {times} AS order_date FROM dirty"),
        )
    for name in ("scl_4_clip", "cln_10_percentage_clip"):
        r.add(
            name,
            lambda t: cleaning.clip_percentages(t.dirty_orders()).select(F.col(ROW_ID).alias("rid"), "share_pct"),
            with_tables("dirty", f"SELECT rid, {rnd('least(greatest(share_pct, 0), 100)')} AS share_pct FROM dirty"),
        )
    r.add(
        "scl_5_whole_days",
        lambda t: t.video_activity().select(
            F.col(ROW_ID).alias("rid"), whole_days("last_watch_ts", moment(REFERENCE_DATE)).alias("days")
        ),
        with_tables("va", f"SELECT rid, {days('last_watch_ts', REF)} AS days FROM va"),
    )
    for name in ("trf_6_video_activity", "scl_6_fallback_id", "scl_8_hours_to_seconds"):
        r.add(
            name,
            lambda t: transformation.video_activity(t.video_export()).withColumnRenamed(ROW_ID, "rid"),
            with_tables(
                "va",
                f"""SELECT rid, email, course_id AS course_name, video_name, course_id, video_name AS video_id, completion_pct,
                    CAST(watch_count AS DOUBLE) AS watch_count, {rnd('watch_seconds / 3600')} AS learning_hours,
                    0.25::DOUBLE AS estimated_learning_hours, {rnd('watch_seconds / 3600 * 3600', 1)} AS watch_seconds,
                    900.0::DOUBLE AS total_seconds, date_trunc('second', last_watch_ts) AS last_watch_ts
                FROM va""",
            ),
        )
    programs = f"""SELECT rid, email, program_name, program_name AS program_id, CAST(total_courses AS INT) AS total_courses,
            CAST(courses_completed AS INT) AS courses_completed, {rnd('learning_hours')} AS learning_hours, is_completed, progress_pct
        FROM pa"""
    for name in ("trf_4_program_activity", "scl_7_derived_progress"):
        r.add(
            name,
            lambda t: transformation.program_activity(t.program_export()).withColumnRenamed(ROW_ID, "rid"),
            with_tables("pa", programs),
        )
    r.add(
        "scl_9_clean_names",
        lambda t: t.course_export().select(
            *[F.count(f"`{c}`").alias(transformation.clean_name(c)) for c in ("Business Unit", "Progress (%)", "Course Id")]
        ),
        "SELECT count(*) AS business_unit, count(*) AS progress_pct, count(*) AS course_id FROM lineitem",
    )


CLEAN_STATS = {
    "med": "SELECT quantile_cont(amount, 0.5) AS m1, quantile_cont(a, 0.5) AS m2 FROM dd",
    "modes": """SELECT (SELECT priority FROM dd WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mp""",
}
# the dirty table without its copies, with the numbers and times parsed
DEDUP = """SELECT customer, priority, amount, TRY_CAST(amount_text AS DOUBLE) AS a, order_date, share_pct, mostly_missing, rid
    FROM dirty WHERE rid % 2 = 0"""
TIMES = "coalesce(try_strptime(order_date, '%Y-%m-%d'), try_strptime(order_date, '%m/%d/%Y %I:%M %p'))"


def _dirty(t: Tables):
    return t.dirty_orders()


def _cleaning(r: Registry) -> None:
    opts = cleaning.CleanOptions(order_by=ORDER)
    student = cleaning.CleanOptions(
        unknown="unknown", numeric_share=0.8, sequential=False, order_by=ORDER
    )
    r.add(
        "cln_1_clean_export",
        lambda t: cleaning.clean_export(_dirty(t), opts).withColumnRenamed(ROW_ID, "rid"),
        with_tables(
            "dirty",
            f"""SELECT rid, CAST(customer AS BIGINT) AS customer, coalesce(priority, mp) AS priority,
                {rnd('coalesce(amount, m1)')} AS amount, {rnd('coalesce(a, m2)')} AS amount_text,
                {TIMES} AS order_date, {rnd('least(greatest(share_pct, 0), 100)')} AS share_pct FROM dd, med, modes""",
            dd=DEDUP,
            **CLEAN_STATS,
        ),
    )
    r.add(
        "cln_2_clean_student_source",
        lambda t: cleaning.clean_student_source(_dirty(t), student).withColumnRenamed(ROW_ID, "rid"),
        with_tables(
            "dirty",
            f"""SELECT rid, CAST(customer AS BIGINT) AS customer, coalesce(priority, mp) AS priority,
                {rnd('coalesce(amount, m1)')} AS amount, {rnd('coalesce(a, m2)')} AS amount_text,
                {TIMES} AS order_date, {rnd('share_pct')} AS share_pct FROM dd, med, modes""",
            dd=DEDUP,
            **CLEAN_STATS,
        ),
    )
    shares = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {rnd(f'1 - count({c}) / count(*)')} AS null_share FROM dirty"
        for c in ("customer", "priority", "amount", "amount_text", "mostly_missing", "order_date", "share_pct")
    )
    r.add(
        "cln_3_null_shares",
        lambda t: cleaning.null_shares(_dirty(t).drop(ROW_ID)),
        with_tables("dirty", shares),
    )
    r.add(
        "cln_3_drop_sparse_columns",
        lambda t: cleaning.drop_sparse_columns(_dirty(t), 0.5, ORDER).select(
            F.col(ROW_ID).alias("rid"), "*"
        ).drop(ROW_ID),
        with_tables("dirty", "SELECT * EXCLUDE (mostly_missing) REPLACE (round_even(share_pct * 1e6, 0) / 1e6 AS share_pct) FROM dirty"),
    )
    r.add(
        "cln_4_type_inference",
        lambda t: cleaning.infer_numbers(_dirty(t), 0.5, ORDER).select(
            F.col(ROW_ID).alias("rid"), "customer", "amount_text", "priority"
        ),
        with_tables(
            "dirty",
            """SELECT rid, CAST(customer AS BIGINT) AS customer, TRY_CAST(amount_text AS DOUBLE) AS amount_text, priority
            FROM dirty""",
        ),
    )
    plain = ["customer", "priority", "order_date"]
    for keep, name, rank in (("first", "win_5_first_row", "ASC"), ("last", "win_5_last_row", "DESC")):
        r.add(
            name,
            lambda t, keep=keep: cleaning.remove_duplicates(_dirty(t), keep, ["customer", "priority"], ORDER).select(
                F.col(ROW_ID).alias("rid"), *plain
            ),
            with_tables(
                "dirty",
                f"""SELECT rid, {', '.join(plain)} FROM dirty
                QUALIFY row_number() OVER (PARTITION BY customer, priority ORDER BY rid {rank}) = 1""",
            ),
        )
    r.add(
        "cln_5_drop_duplicates",
        lambda t: cleaning.remove_duplicates(_dirty(t), order_by=ORDER).select(F.col(ROW_ID).alias("rid"), *plain),
        with_tables("dirty", f"SELECT rid, {', '.join(plain)} FROM dirty WHERE rid % 2 = 0"),
    )
    r.add(
        "cln_5_keep_none",
        lambda t: cleaning.remove_duplicates(_dirty(t), "false", order_by=ORDER).select(F.col(ROW_ID).alias("rid"), *plain),
        with_tables("dirty", f"SELECT rid, {', '.join(plain)} FROM dirty WHERE rid % 2 = 0 AND (rid // 2) % 13 <> 0"),
    )
    cells = "rid, priority, round_even({a} * 1e6, 0) / 1e6 AS amount"
    fills = {
        "mean": "coalesce(amount, (SELECT avg(amount) FROM dirty))",
        "median": "coalesce(amount, (SELECT quantile_cont(amount, 0.5) FROM dirty))",
        "zero": "coalesce(amount, 0)",
    }
    for strategy, value in fills.items():
        r.add(
            f"cln_6_fill_{strategy}",
            lambda t, strategy=strategy: cleaning.fill_missing(
                _dirty(t).select("amount", "priority", ROW_ID), strategy, "unknown", order_by=ORDER
            ).select(F.col(ROW_ID).alias("rid"), "priority", "amount"),
            with_tables("dirty", f"SELECT {cells.format(a=value)} FROM dirty").replace(
                "rid, priority,", "rid, coalesce(priority, 'Unknown') AS priority,"
            ),
        )
    r.add(
        "cln_6_drop_then_mode",
        lambda t: cleaning.fill_missing(
            _dirty(t).select("amount", "priority", ROW_ID), "drop", "mode", order_by=ORDER
        ).select(F.col(ROW_ID).alias("rid"), "priority", "amount"),
        with_tables(
            "dirty",
            """SELECT rid, coalesce(priority, (SELECT priority FROM dirty WHERE amount IS NOT NULL AND priority IS NOT NULL
                GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS priority, amount FROM dirty WHERE amount IS NOT NULL""",
        ),
    )
    r.add(
        "cln_7_fill_mode",
        lambda t: cleaning.fill_missing(
            _dirty(t).select("priority", "mostly_missing", ROW_ID), "zero", "mode", order_by=ORDER
        ).select(F.col(ROW_ID).alias("rid"), "priority", "mostly_missing"),
        with_tables(
            "dirty",
            """SELECT rid, coalesce(priority, (SELECT priority FROM dirty WHERE priority IS NOT NULL
                    GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS priority,
                coalesce(mostly_missing, (SELECT mostly_missing FROM dirty WHERE mostly_missing IS NOT NULL
                    GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS mostly_missing FROM dirty""",
        ),
    )
    r.add(
        "cln_7_drop_categorical",
        lambda t: cleaning.fill_missing(
            _dirty(t).select("priority", ROW_ID), "zero", "drop", order_by=ORDER
        ).select(F.col(ROW_ID).alias("rid"), "priority"),
        with_tables("dirty", "SELECT rid, priority FROM dirty WHERE priority IS NOT NULL"),
    )
    r.add(
        "cln_8_timestamp_columns",
        lambda t: _dirty(t).agg(
            *[F.count(c).alias(c) for c in cleaning.detected_timestamp_columns(_dirty(t), order_by=ORDER)],
            F.count(timestamp("order_date")).alias("parsed"),
        ),
        with_tables("dirty", f"SELECT count(*) AS order_date, count({TIMES}) AS parsed FROM dirty"),
    )
    nulls = "CAST(priority IS NULL AS INT) + CAST(amount IS NULL AS INT) + CAST(mostly_missing IS NULL AS INT)"
    after = f"""CAST({TIMES} IS NULL AS INT)"""
    r.add(
        "cln_11_cleaning_report",
        lambda t: cleaning.cleaning_report(_dirty(t), cleaning.clean_export(_dirty(t), opts), ORDER),
        with_tables(
            "dirty",
            f"""SELECT *, rows_before - rows_after AS rows_removed, 7 AS cols_before, 6 AS cols_after, 1 AS cols_removed,
                missing_before - missing_after AS missing_filled
            FROM (SELECT count(*) AS rows_before, CAST(sum({nulls}) AS BIGINT) AS missing_before FROM dirty),
                (SELECT count(*) AS rows_after, CAST(sum({after}) AS BIGINT) AS missing_after FROM dd)""",
            dd=DEDUP,
        ),
    )
    r.add(
        "cln_12_quality_kpis",
        lambda t: cleaning.quality_kpis(_dirty(t), ORDER),
        with_tables(
            "dirty",
            f"""SELECT count(*) AS total_rows, CAST(sum({nulls}) AS BIGINT) AS missing_values,
                count(*) FILTER (WHERE rid % 2 = 1) AS duplicate_rows, 7 AS num_columns FROM dirty""",
        ),
    )


def _model(t: Tables) -> dict:
    return transformation.transform_all(t.exports(), ORDER, REFERENCE_DATE)


VIEW_COUNTS = [
    "courses_enrolled", "courses_completed", "videos_watched", "specs_enrolled", "specs_completed",
    "programs_enrolled", "programs_completed",
]

LEARNERS = f"""SELECT row_number() OVER (ORDER BY first_rid) AS learner_id, email, name, business_unit, role, location,
        enrollment_date, last_activity, last_activity >= {REF} - INTERVAL 90 DAY AS is_active
    FROM (SELECT email, min(rid) AS first_rid, arg_min(name, rid) AS name, arg_min(business_unit, rid) AS business_unit,
            arg_min(role, rid) AS role, arg_min(location, rid) AS location, min(enrollment_ts) AS enrollment_date,
            max(last_activity_ts) AS last_activity FROM cawr GROUP BY email)"""


def _transformation(r: Registry) -> None:
    r.add(
        "trf_1_learner_dimension",
        lambda t: transformation.learners(t.course_export(), ORDER, REFERENCE_DATE),
        with_tables("cawr", LEARNERS),
    )
    r.add(
        "trf_2_course_dimension",
        lambda t: transformation.course_table(t.course_export(), ORDER),
        with_tables(
            "ca",
            f"""SELECT course_id, min(course_name) AS course_name,
                {rnd('quantile_cont(learning_hours, 0.5) FILTER (WHERE is_completed)')} AS estimated_hours FROM ca GROUP BY course_id""",
        ),
    )
    r.add(
        "trf_3_course_activity",
        lambda t: transformation.course_activity(t.course_export()).select("*", f"{ROW_ID}.*").drop(ROW_ID),
        with_tables(
            "caw",
            f"""SELECT name AS "Name", email, business_unit, role, location, course_id, course_name, enrollment_ts, last_activity_ts,
                progress_pct, {rnd('grade')} AS grade, {rnd('learning_hours')} AS learning_hours, is_completed,
                o1 AS l_orderkey, o2 AS l_linenumber, o3 AS l_partkey, o4 AS l_suppkey, o5 AS l_quantity, o6 AS l_extendedprice
            FROM caw""",
        ),
    )
    r.add(
        "trf_5_specialization_activity",
        lambda t: transformation.specialization_activity(t.specialization_export()),
        with_tables(
            "sa",
            f"""SELECT email, spec_name, spec_id, CAST(total_courses AS INT) AS total_courses,
                CAST(courses_completed AS INT) AS courses_completed, {rnd('learning_hours')} AS learning_hours, is_completed,
                progress_pct FROM sa""",
        ),
    )
    counts = " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS n FROM {s}"
        for n, s in {
            "learners": "(SELECT DISTINCT email FROM ca)", "courses": "(SELECT DISTINCT course_id FROM ca)",
            "course_activity": "ca", "program_activity": "pa", "specialization_activity": "sa", "video_activity": "va",
        }.items()
    )

    def all_tables(t: Tables):
        out = None
        for name, df in _model(t).items():
            part = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"))
            out = part if out is None else out.unionByName(part)
        return out

    r.add("trf_7_transform_all", all_tables, with_tables("ca pa sa va", counts))
    view = f"""SELECT * REPLACE ({', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in VIEW_COUNTS)}) FROM (SELECT l.*, courses_enrolled, c.courses_completed, {rnd('avg_progress')} AS avg_progress,
            {rnd('total_learning_hours')} AS total_learning_hours, {rnd('avg_grade')} AS avg_grade,
            {rnd('c.courses_completed / courses_enrolled * 100', 1)} AS completion_rate,
            videos_watched, {rnd('avg_video_completion')} AS avg_video_completion, {rnd('total_watch_seconds')} AS total_watch_seconds,
            {rnd('total_rewatches')} AS total_rewatches, specs_enrolled, specs_completed, {rnd('avg_spec_progress')} AS avg_spec_progress,
            programs_enrolled, programs_completed, {rnd('avg_program_progress')} AS avg_program_progress
        FROM learners l
        LEFT JOIN (SELECT email, count(*) AS courses_enrolled, count(*) FILTER (WHERE is_completed) AS courses_completed,
            avg(progress_pct) AS avg_progress, sum(learning_hours) AS total_learning_hours, avg(grade) AS avg_grade
            FROM caw GROUP BY email) c USING (email)
        LEFT JOIN (SELECT email, count(*) AS videos_watched, avg(completion_pct) AS avg_video_completion,
            sum({rnd('watch_seconds', 1)}) AS total_watch_seconds, sum(watch_count) AS total_rewatches FROM va GROUP BY email) v USING (email)
        LEFT JOIN (SELECT email, count(*) AS specs_enrolled, count(*) FILTER (WHERE is_completed) AS specs_completed,
            avg(progress_pct) AS avg_spec_progress FROM sa GROUP BY email) s USING (email)
        LEFT JOIN (SELECT email, count(*) AS programs_enrolled, count(*) FILTER (WHERE is_completed) AS programs_completed,
            avg(progress_pct) AS avg_program_progress FROM pa GROUP BY email) p USING (email))"""
    for name in ("trf_8_unified_learner_view", "jon_3_left_lookup_joins"):
        r.add(
            name,
            lambda t: as_doubles(transformation.unified_learner_view(_model(t)), VIEW_COUNTS),
            with_tables("cawr va sa pa", view, learners=LEARNERS),
        )


def _integration(r: Registry) -> None:
    r.add(
        "jon_1_id_mapping",
        lambda t: integration.map_ids(t.student_sources()["lms"], t.id_map(), "lms").select(
            F.col(ROW_ID).alias("rid"), "student_id", "course_id"
        ),
        with_tables(
            "s_lms id_map", "SELECT rid, student AS student_id, course_id FROM s_lms JOIN id_map ON student_id = lms_id"
        ),
    )
    r.add(
        "jon_1_unmatched",
        lambda t: integration.unmatched(t.student_sources()["coursera"], t.id_map(), "coursera"),
        with_tables(
            "s_coursera id_map",
            """SELECT 'coursera' AS source, count(*) AS unmatched_records FROM s_coursera
            WHERE student_id NOT IN (SELECT coursera_id FROM id_map)""",
        ),
    )

    def level(t: Tables) -> dict:
        m = t.id_map()
        return {s: integration.map_and_aggregate(df, m, s, ORDER) for s, df in t.student_sources().items()}

    # means of few-digit decimals often end exactly on a tie at six digits, hence nine
    counts = [f"{s}_record_count" for s in ("coursera", "lms", "academic")]

    def replaced(columns: list[str], table: str) -> str:
        parts = [f"{rnd(c, 9)} AS {c}" for c in columns if c not in counts]
        parts += [f"CAST({c} AS DOUBLE) AS {c}" for c in columns if c in counts]
        return f"SELECT * REPLACE ({', '.join(parts)}) FROM {table}"

    numbers = ["duration_minutes", "completion_pct", "page_views", "forum_posts", "gpa", *counts]
    r.add(
        "jon_2_full_outer_join",
        lambda t: as_doubles(integration.join_sources(level(t)), counts),
        with_tables("joined", replaced([*numbers, "score_coursera", "score_lms"], "joined")),
        digits=9,
    )
    r.add(
        "int_1_source_aggregation",
        lambda t: level(t)["coursera"],
        with_tables("a_coursera", replaced(["duration_minutes", "completion_pct", "score"], "a_coursera")),
        digits=9,
    )
    r.add(
        "int_1_source_aggregation_unmapped",
        lambda t: integration.aggregate_source(t.student_sources()["lms"], "lms", ORDER),
        with_tables(
            "s_lms",
            f"""SELECT student_id, course_id, arg_min(session_start, rid) AS session_start,
                arg_min(activity_type, rid) FILTER (WHERE activity_type IS NOT NULL) AS activity_type,
                {rnd('avg(page_views)')} AS page_views, {rnd('avg(forum_posts)')} AS forum_posts, {rnd('avg(score)')} AS score,
                count(*) AS lms_record_count FROM s_lms GROUP BY student_id, course_id""",
        ),
    )
    for name in ("int_2_resolve_latest", "int_3_integrate"):
        r.add(
            name,
            lambda t: as_doubles(
                integration.integrate(t.student_sources(), t.id_map(), dict.fromkeys(t.student_sources(), ORDER)), counts
            ),
            with_tables("integrated", replaced([*numbers, "score"], "integrated")),
            digits=9,
        )
    by_source = """coalesce(activity_type_lms, activity_type_coursera) AS activity_type, coalesce(score_lms, score_coursera) AS score"""
    r.add(
        "int_2_resolve_source_priority",
        lambda t: integration.resolve_conflicts(integration.join_sources(level(t)), "source_priority").select(
            "student_id", "course_id", "activity_type", "score"
        ),
        with_tables(
            "joined", f"SELECT student_id, course_id, activity_type, {rnd('score')} AS score FROM (SELECT *, {by_source} FROM joined)"
        ),
    )
    for name in ("scl_11_source_suffixes", "int_5_integration_report"):
        r.add(
            name,
            lambda t: integration.integration_report(t.student_sources(), t.id_map(), integration.join_sources(level(t))),
            with_tables(
                "joined s_coursera s_lms s_academic id_map",
                """SELECT 3 AS total_sources, (SELECT count(*) FROM joined) AS matched_records,
                (SELECT count(*) FROM s_coursera WHERE student_id NOT IN (SELECT coursera_id FROM id_map))
                + (SELECT count(*) FROM s_lms WHERE student_id NOT IN (SELECT lms_id FROM id_map))
                + (SELECT count(*) FROM s_academic WHERE student_id NOT IN (SELECT academic_id FROM id_map)) AS unmatched_records,
                2 AS conflicts_resolved""",
            ),
        )
    r.add(
        "int_4_integrity_issues",
        lambda t: integration.integrity_issues(t.student_sources()["academic"]),
        with_tables(
            "s_academic",
            """SELECT 0::BIGINT AS null_student_ids, 0::BIGINT AS null_course_ids, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT)
                AS duplicate_student_course_pairs
            FROM (SELECT count(*) AS n FROM s_academic GROUP BY student_id, course_id)""",
        ),
    )


def _integrated(t: Tables):
    """Integrated students, with a numeric order along the ids."""
    out = integration.integrate(t.student_sources(), t.id_map(), dict.fromkeys(t.student_sources(), ORDER))
    number = F.substring("student_id", 5, 20).cast("long") * 100 + F.substring("course_id", 5, 3).cast("long")
    return out.withColumn("_order", number)


KEYED = "SELECT *, CAST(substr(student_id, 5) AS BIGINT) * 100 + CAST(substr(course_id, 5) AS BIGINT) AS k FROM integrated"
FEATURED = f"""SELECT *, completion_pct AS video_completion_pct,
        CASE WHEN completion_pct >= 0.8 THEN 1 ELSE 0 END AS video_completed,
        coalesce(coursera_record_count, 0) + coalesce(lms_record_count, 0) + coalesce(academic_record_count, 0) AS session_frequency,
        coalesce(score - lag(score) OVER (PARTITION BY student_id ORDER BY k), 0) AS assessment_improvement,
        CASE WHEN enrollment_status = 'withdrawn' THEN 1 ELSE 0 END AS dropout, gpa AS final_score
    FROM keyed"""


def _norm(c: str) -> str:
    low, high = f"(SELECT min({c}) FROM f0)", f"(SELECT max({c}) FROM f0)"
    return f"coalesce(CASE WHEN {low} = {high} THEN 0.5 ELSE ({c} - {low}) / ({high} - {low}) END, 0)"


ENGAGED = f"""SELECT *, {rnd(f'''(0.0 + {_norm('session_frequency')} * {PROBE_WEIGHTS['session_frequency']}
        + coalesce(least(greatest(video_completion_pct, 0), 1), 0) * {PROBE_WEIGHTS['video_completion']}
        + {_norm('score')} * {PROBE_WEIGHTS['assessment_score']} + {_norm('forum_posts')} * {PROBE_WEIGHTS['forum_activity']}
        ) / CAST({sum(PROBE_WEIGHTS.values())} AS DOUBLE)''', 4)} AS engagement_score FROM f0"""


def _features(r: Registry) -> None:
    order = ("_order",)
    tables = {"keyed": KEYED, "f0": FEATURED, "f1": ENGAGED}

    def add(name: str, run, body: str) -> None:
        r.add(name, run, with_tables("integrated", body, **tables))

    ids = ["student_id", "course_id"]
    add(
        "fea_1_session_frequency",
        lambda t: features.session_frequency(_integrated(t), order).select(*ids, "session_frequency"),
        "SELECT student_id, course_id, session_frequency FROM f0",
    )
    for name in ("fea_1_running_count", "win_1_running_row_number"):
        r.add(
            name,
            lambda t: features.session_frequency(t.student_sources()["coursera"], ORDER)
            .select("student_id", "course_id", f"{ROW_ID}.l_orderkey", f"{ROW_ID}.l_linenumber", "session_frequency"),
            with_tables(
                "ca",
                """SELECT 'CR-' || email AS student_id, course_id, o1 AS l_orderkey, o2 AS l_linenumber,
                    row_number() OVER (PARTITION BY email ORDER BY o1, o2, o3, o4, o5, o6) AS session_frequency FROM ca""",
            ),
        )
    add(
        "fea_2_video_completion",
        lambda t: features.video_completion(_integrated(t)).select(*ids, "video_completion_pct", "video_completed"),
        f"SELECT student_id, course_id, {rnd('video_completion_pct')} AS video_completion_pct, video_completed FROM f0",
    )
    for name in ("fea_3_assessment_improvement", "win_2_difference"):
        add(
            name,
            lambda t: features.assessment_improvement(_integrated(t), order).select(*ids, "assessment_improvement"),
            f"SELECT student_id, course_id, {rnd('assessment_improvement')} AS assessment_improvement FROM f0",
        )
    change = """coalesce(gpa / nullif(lag(gpa) OVER (PARTITION BY student_id ORDER BY rid), 0) - 1, 0)"""
    for name in ("fea_3_relative_improvement", "win_3_relative_change"):
        r.add(
            name,
            lambda t: features.assessment_improvement(t.student_sources()["academic"], ORDER, "pct_change").select(
                F.col(ROW_ID).alias("rid"), "assessment_improvement"
            ),
            with_tables("s_academic", f"SELECT rid, {rnd(change)} AS assessment_improvement FROM s_academic"),
        )
    add(
        "fea_4_min_max",
        lambda t: features.min_max(_integrated(t), ["gpa", "score"]).select(*ids, "gpa", "score"),
        f"""SELECT student_id, course_id,
            {rnd('(gpa - (SELECT min(gpa) FROM f0)) / ((SELECT max(gpa) FROM f0) - (SELECT min(gpa) FROM f0))')} AS gpa,
            {rnd('(score - (SELECT min(score) FROM f0)) / ((SELECT max(score) FROM f0) - (SELECT min(score) FROM f0))')} AS score
        FROM f0""",
    )
    made = ["session_frequency", "video_completed", "dropout", "engagement_score"]
    add(
        "fea_5_weighted_engagement",
        lambda t: features.generate_features(_integrated(t), order, weights=PROBE_WEIGHTS).select(*ids, "engagement_score"),
        "SELECT student_id, course_id, engagement_score FROM f1",
    )
    add(
        "fea_6_dropout_flag",
        lambda t: features.dropout_flag(_integrated(t)).select(*ids, "dropout"),
        "SELECT student_id, course_id, dropout FROM f0",
    )
    add(
        "fea_7_final_score",
        lambda t: features.final_score(_integrated(t)).select(*ids, "final_score"),
        f"SELECT student_id, course_id, {rnd('final_score')} AS final_score FROM f0",
    )
    add(
        "fea_8_custom_features",
        lambda t: features.custom_features(
            _integrated(t),
            {"posts_per_session": lambda df: F.col("forum_posts") / F.col("lms_record_count"), "broken": lambda df: df["missing"]},
        )[0].select(*ids, "posts_per_session"),
        f"SELECT student_id, course_id, {rnd('forum_posts / lms_record_count')} AS posts_per_session FROM f0",
    )
    summary = " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count({c}) AS count, {rnd(f'avg({c})', 4)} AS mean, {rnd(f'stddev_samp({c})', 4)} AS std,
            {rnd(f'min({c})', 4)} AS min, {rnd(f'max({c})', 4)} AS max FROM f1"""
        for c in features.FEATURE_COLUMNS
    )
    add(
        "fea_9_feature_summary",
        lambda t: features.feature_summary(features.generate_features(_integrated(t), order, weights=PROBE_WEIGHTS)),
        summary,
    )
    add(
        "fea_10_generate_features",
        lambda t: features.generate_features(_integrated(t), order, weights=PROBE_WEIGHTS).select(
            *ids, *made, "assessment_improvement", "final_score"
        ),
        f"""SELECT student_id, course_id, {', '.join(made)}, {rnd('assessment_improvement')} AS assessment_improvement,
            {rnd('final_score')} AS final_score FROM f1""",
    )
    add(
        "kpi_2_student_kpis",
        lambda t: charts.student_kpis(features.generate_features(_integrated(t), order, weights=PROBE_WEIGHTS)),
        f"""SELECT count(DISTINCT student_id) AS total_students, {rnd('avg(engagement_score) * 100', 1)} AS avg_engagement_pct,
            {rnd('avg(dropout) * 100', 1)} AS dropout_rate_pct FROM f1""",
    )
    begin, last = f"{days(REF, 'min(enrollment_ts)')}", f"{days(REF, 'max(last_activity_ts)')}"
    behaviour = f"""SELECT email, count(*) AS courses_enrolled, sum(learning_hours) AS total_hours,
            avg(learning_hours) AS avg_hours_per_course, coalesce(stddev_samp(learning_hours), 0) AS std_hours,
            greatest({last}, 0) AS days_since_last_activity, greatest({begin}, 0) AS account_age_days,
            {days('max(enrollment_ts)', 'min(enrollment_ts)')} AS enrollment_span_days, avg(progress_pct) AS avg_progress,
            max(progress_pct) AS max_progress, count(*) FILTER (WHERE is_completed) AS courses_completed
        FROM ca GROUP BY email"""
    seen = """SELECT email, count(*) AS videos_watched, count(DISTINCT video_id) AS unique_videos,
            avg(completion_pct) AS avg_video_completion, sum(watch_seconds) AS total_watch_seconds,
            CAST(sum(watch_count) AS BIGINT) AS total_rewatches, avg(watch_count) AS avg_rewatch_rate FROM va GROUP BY email"""
    matrix = f"""SELECT email, courses_enrolled, {rnd('total_hours')} AS total_hours, {rnd('avg_hours_per_course')} AS avg_hours_per_course,
            {rnd('std_hours')} AS std_hours, days_since_last_activity, account_age_days, enrollment_span_days,
            {rnd('total_hours / greatest(account_age_days / 7, 1.0)', 3)} AS hours_per_week,
            {rnd('hours_component')} AS hours_component, video_component, recency_component,
            coalesce(videos_watched, 0) AS videos_watched, coalesce(unique_videos, 0) AS unique_videos,
            coalesce({rnd('avg_video_completion')}, 0) AS avg_video_completion,
            coalesce({rnd('total_watch_seconds')}, 0) AS total_watch_seconds, coalesce(total_rewatches, 0) AS total_rewatches,
            coalesce({rnd('avg_rewatch_rate')}, 0) AS avg_rewatch_rate,
            coalesce({rnd('total_rewatches / videos_watched', 3)}, 0) AS rewatch_ratio,
            {rnd('avg_progress')} AS avg_progress, max_progress, courses_completed,
            {rnd('courses_completed / courses_enrolled')} AS completion_rate
        FROM behaviour JOIN eng USING (email) LEFT JOIN seen USING (email)"""
    for name in ("fea_11_learner_matrix", "fea_12_leakage_guard"):
        r.add(
            name,
            (lambda t: features.learner_matrix(t.course_activity(), t.engagement(), t.video_activity(), REFERENCE_DATE))
            if name == "fea_11_learner_matrix"
            else (lambda t: _inputs_only(t)),
            with_tables(
                "ca va eng",
                matrix
                if name == "fea_11_learner_matrix"
                else f"SELECT * EXCLUDE (avg_progress, max_progress, courses_completed, completion_rate) FROM ({matrix})",
                behaviour=behaviour,
                seen=seen,
            ),
        )


def _inputs_only(t: Tables):
    m = features.learner_matrix(t.course_activity(), t.engagement(), t.video_activity(), REFERENCE_DATE)
    return m.select("email", *features.model_inputs(m))


def register(r: Registry) -> None:
    for part in (_scalars, _cleaning, _transformation, _integration, _features):
        part(r)
