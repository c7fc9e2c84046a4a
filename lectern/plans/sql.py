"""The same tables as in `lectern.plans.tables`, as common table expressions for the oracle."""

from __future__ import annotations

from lectern.functions.fixed import COURSE_SKILLS, SKILL_CATEGORIES
from lectern.plans.tables import REFERENCE_DATE

REF = f"TIMESTAMP '{REFERENCE_DATE} 00:00:00'"
ROW_ORDER = "o1, o2, o3, o4, o5, o6"


# irregular weights for comparisons: with round ones, many scores lie exactly on a rounding tie
PROBE_WEIGHTS = {
    "session_frequency": 0.3141593,
    "video_completion": 0.2345671,
    "assessment_score": 0.2567891,
    "forum_activity": 0.1944845,
}


def rnd(expr: str, digits: int = 6) -> str:
    """Half-even rounding of the scaled double."""
    return f"(round_even(CAST({expr} AS DOUBLE) * 1e{digits}, 0) / 1e{digits})"


def days(later: str, earlier: str) -> str:
    """Elapsed whole 24-hour days."""
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0) AS BIGINT)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join(quoted(x) for x in r) + ")" for r in rows)


def _activity(wide: bool) -> str:
    extra = ", c_name AS name, c_mktsegment AS business_unit, n_name AS location, r_name AS location_region"
    joins = """
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey"""
    return f"""
        SELECT CAST(o_custkey AS VARCHAR) AS email,
            'CRS-' || lpad(CAST(l_partkey % 20 + 1 AS VARCHAR), 3, '0') AS course_id,
            'Course ' || CAST(l_partkey % 20 + 1 AS VARCHAR) AS course_name,
            o_orderdate AS enrollment_ts,
            CASE WHEN l_quantity * 2 >= 90 THEN greatest(l_shipdate, o_orderdate) END AS completion_ts,
            greatest(l_shipdate, o_orderdate) AS last_activity_ts,
            l_quantity * 2 AS progress_pct,
            CASE WHEN l_quantity * 2 >= 90 THEN 100 - 300 * l_discount END AS grade,
            l_extendedprice / 10000 AS learning_hours,
            l_quantity * 2 >= 90 AS is_completed,
            o_orderpriority AS role,
            l_orderkey AS o1, l_linenumber AS o2, l_partkey AS o3, l_suppkey AS o4, l_quantity AS o5,
            l_extendedprice AS o6{extra if wide else ''}
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey{joins if wide else ''}"""


VIDEO = """
        SELECT CAST(user_id AS VARCHAR) AS email,
            'CRS-' || lpad(CAST(event_id % 20 + 1 AS VARCHAR), 3, '0') AS course_id,
            event_type || '-' || CAST(event_id % 12 AS VARCHAR) AS video_id,
            'Clip ' || event_type || '-' || CAST(event_id % 12 AS VARCHAR) AS video_name,
            value * 60 AS watch_seconds, least(value, 100.0) AS completion_pct,
            event_id % 4 + 1 AS watch_count, ts AS last_watch_ts, event_id AS rid
        FROM events"""

PROGRAM = f"""
        SELECT CAST(o_custkey AS VARCHAR) AS email, o_orderpriority AS program_id, o_orderpriority AS program_name,
            total_courses, courses_completed,
            {rnd('courses_completed / total_courses * 100', 1)} AS progress_pct,
            o_totalprice / 10000 AS learning_hours, o_orderstatus = 'F' AS is_completed,
            o_orderdate AS enrollment_ts, o_orderkey AS rid
        FROM orders JOIN (
            SELECT l_orderkey, count(*) AS total_courses, count(*) FILTER (WHERE l_quantity >= 45) AS courses_completed
            FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey"""

SPECIALIZATION = f"""
        SELECT CAST(o_custkey AS VARCHAR) AS email, p_type AS spec_id, p_type AS spec_name, total_courses,
            courses_completed, {rnd('courses_completed / total_courses * 100', 1)} AS progress_pct, learning_hours,
            courses_completed / total_courses * 100 >= 50 AS is_completed
        FROM (SELECT o_custkey, p_type, count(*) AS total_courses,
                count(*) FILTER (WHERE l_quantity >= 45) AS courses_completed,
                sum(l_extendedprice) / 10000 AS learning_hours
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
            GROUP BY o_custkey, p_type)"""

PROGRESS = "SELECT email, avg(progress_pct) AS progress_component FROM ca GROUP BY email"
HOURS = """
        SELECT email, total_hours, least(greatest(total_hours / p95 * 100, 0), 100) AS hours_component
        FROM (SELECT email, sum(learning_hours) AS total_hours FROM ca GROUP BY email),
            (SELECT quantile_cont(h, 0.95) AS p95 FROM (SELECT sum(learning_hours) AS h FROM ca GROUP BY email))"""
VIDEO_PART = f"""
        SELECT email, {rnd('c * 0.6 + least(greatest(w / p95 * 100, 0), 100) * 0.4', 2)} AS video_component
        FROM (SELECT email, avg(completion_pct) AS c, sum(watch_count) AS w FROM va GROUP BY email),
            (SELECT quantile_cont(w, 0.95) AS p95 FROM
                (SELECT CAST(sum(watch_count) AS DOUBLE) AS w FROM va GROUP BY email))"""
RECENCY = f"""
        SELECT email, {rnd(f"least(greatest((1 - greatest({days(REF, 'l')}, 0) / 365) * 100, 0), 100)", 2)}
            AS recency_component
        FROM (SELECT email, max(last_activity_ts) AS l FROM ca GROUP BY email)"""
ENGAGEMENT = f"""
        SELECT *, CASE WHEN score >= 75 THEN 'High' WHEN score >= 50 THEN 'Medium' WHEN score >= 25 THEN 'Low'
            ELSE 'At-Risk' END AS category
        FROM (SELECT email, progress_component, hours_component, coalesce(video_component, 0) AS video_component,
                recency_component, {rnd('''progress_component * 0.25 + hours_component * 0.25
                + coalesce(video_component, 0) * 0.25 + recency_component * 0.25''', 1)} AS score
            FROM e_progress JOIN e_hours USING (email) JOIN e_recency USING (email) LEFT JOIN e_video USING (email))"""

SKILL_SCORES = f"""
        SELECT email, skill_name, coalesce(skill_category, 'Other') AS skill_category, avg_progress,
            courses_contributing, courses_completed,
            {rnd('least(greatest(avg_progress * 0.7 + courses_completed / courses_contributing * 30, 0), 100)', 1)}
                AS skill_score
        FROM (SELECT email, skill_name, avg(progress_pct) AS avg_progress, count(*) AS courses_contributing,
                count(*) FILTER (WHERE is_completed) AS courses_completed
            FROM ca JOIN course_skills USING (course_id) GROUP BY email, skill_name)
        LEFT JOIN skill_names USING (skill_name)"""

DIRTY = """
        SELECT CAST(o_custkey AS VARCHAR) AS customer,
            CASE WHEN k % 10 <> 3 THEN o_orderpriority END AS priority,
            CASE WHEN k % 7 <> 2 THEN o_totalprice END AS amount,
            CASE WHEN k % 9 <> 4 THEN CAST(o_totalprice AS VARCHAR) ELSE 'n/a' END AS amount_text,
            CASE WHEN k % 3 = 0 THEN o_orderstatus END AS mostly_missing,
            CASE WHEN k % 11 = 5 THEN 'not a date' WHEN k % 2 = 0 THEN strftime(o_orderdate, '%m/%d/%Y %I:%M %p')
                ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
            o_totalprice / 2000 - 20 AS share_pct, rid
        FROM (SELECT *, o_orderkey AS k, o_orderkey * 2 AS rid FROM orders
            UNION ALL SELECT *, o_orderkey AS k, o_orderkey * 2 + 1 AS rid FROM orders WHERE o_orderkey % 13 = 0)"""

ID_MAP = """
        SELECT 'STU-' || c_custkey AS student, 'CR-' || c_custkey AS coursera_id, 'LMS-' || c_custkey AS lms_id,
            'AC-' || c_custkey AS academic_id
        FROM customer WHERE c_custkey % 20 <> 7"""
S_COURSERA = """
        SELECT 'CR-' || email AS student_id, course_id, last_activity_ts AS timestamp,
            CASE WHEN is_completed THEN 'quiz_attempt' ELSE 'video_watch' END AS activity_type,
            learning_hours * 60 AS duration_minutes, progress_pct / 100 AS completion_pct, grade AS score,
            row_number() OVER (ORDER BY o1, o2, o3, o4, o5, o6) AS rid
        FROM ca"""
S_LMS = """
        SELECT 'LMS-' || user_id AS student_id, 'CRS-' || lpad(CAST(event_id % 20 + 1 AS VARCHAR), 3, '0') AS course_id,
            ts AS session_start, CASE WHEN event_id % 5 <> 0 THEN event_type END AS activity_type,
            value AS page_views, event_id % 7 AS forum_posts, CASE WHEN event_id % 3 = 0 THEN value END AS score,
            event_id AS rid
        FROM events"""
S_ACADEMIC = """
        SELECT 'AC-' || o_custkey AS student_id,
            'CRS-' || lpad(CAST(o_orderkey % 20 + 1 AS VARCHAR), 3, '0') AS course_id,
            substr(o_orderpriority, 1, 1) AS grade, strftime(o_orderdate, '%Y') AS semester,
            o_totalprice / 100000 AS gpa,
            CASE WHEN o_orderstatus = 'F' THEN 'withdrawn' ELSE 'active' END AS enrollment_status, o_orderkey AS rid
        FROM orders"""
A_COURSERA = """
        SELECT student AS student_id, course_id, arg_min(timestamp, rid) AS timestamp,
            arg_min(activity_type, rid) FILTER (WHERE activity_type IS NOT NULL) AS activity_type,
            avg(duration_minutes) AS duration_minutes, avg(completion_pct) AS completion_pct, avg(score) AS score,
            count(*) AS coursera_record_count
        FROM s_coursera JOIN id_map ON student_id = coursera_id GROUP BY student, course_id"""
A_LMS = """
        SELECT student AS student_id, course_id, arg_min(session_start, rid) AS session_start,
            arg_min(activity_type, rid) FILTER (WHERE activity_type IS NOT NULL) AS activity_type,
            avg(page_views) AS page_views, avg(forum_posts) AS forum_posts, avg(score) AS score,
            count(*) AS lms_record_count
        FROM s_lms JOIN id_map ON student_id = lms_id GROUP BY student, course_id"""
A_ACADEMIC = """
        SELECT student AS student_id, course_id, arg_min(grade, rid) AS grade, arg_min(semester, rid) AS semester,
            avg(gpa) AS gpa, arg_min(enrollment_status, rid) AS enrollment_status, count(*) AS academic_record_count
        FROM s_academic JOIN id_map ON student_id = academic_id GROUP BY student, course_id"""
JOINED = """
        SELECT student_id, course_id, c.timestamp, c.activity_type AS activity_type_coursera, c.duration_minutes,
            c.completion_pct, c.score AS score_coursera, c.coursera_record_count, l.session_start,
            l.activity_type AS activity_type_lms, l.page_views, l.forum_posts, l.score AS score_lms,
            l.lms_record_count, a.grade, a.semester, a.gpa, a.enrollment_status, a.academic_record_count
        FROM a_coursera c FULL JOIN a_lms l USING (student_id, course_id)
            FULL JOIN a_academic a USING (student_id, course_id)"""
INTEGRATED = """
        SELECT student_id, course_id, timestamp, duration_minutes, completion_pct, coursera_record_count,
            session_start, page_views, forum_posts, lms_record_count, grade, semester, gpa, enrollment_status,
            academic_record_count, coalesce(activity_type_coursera, activity_type_lms) AS activity_type,
            coalesce(score_coursera, score_lms) AS score
        FROM joined"""

# name -> (body, names it needs)
CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "ca": (_activity(False), ()),
    "caw": (_activity(True), ()),
    "car": (f"SELECT *, row_number() OVER (ORDER BY {ROW_ORDER}) AS rid FROM ca", ("ca",)),
    "cawr": (f"SELECT *, row_number() OVER (ORDER BY {ROW_ORDER}) AS rid FROM caw", ("caw",)),
    "va": (VIDEO, ()),
    "pa": (PROGRAM, ()),
    "sa": (SPECIALIZATION, ()),
    "e_progress": (PROGRESS, ("ca",)),
    "e_hours": (HOURS, ("ca",)),
    "e_video": (VIDEO_PART, ("va",)),
    "e_recency": (RECENCY, ("ca",)),
    "eng": (ENGAGEMENT, ("e_progress", "e_hours", "e_video", "e_recency")),
    "course_skills": (
        f"SELECT * FROM (VALUES {values([(c, s) for c, x in COURSE_SKILLS.items() for s in x])}) t(course_id, skill_name)",
        (),
    ),
    "skill_names": (
        f"SELECT * FROM (VALUES {values([(s, c) for c, x in SKILL_CATEGORIES.items() for s in x])}) t(skill_name, skill_category)",
        (),
    ),
    "scores": (SKILL_SCORES, ("ca", "course_skills", "skill_names")),
    "dirty": (DIRTY, ()),
    "id_map": (ID_MAP, ()),
    "s_coursera": (S_COURSERA, ("ca",)),
    "s_lms": (S_LMS, ()),
    "s_academic": (S_ACADEMIC, ()),
    "a_coursera": (A_COURSERA, ("s_coursera", "id_map")),
    "a_lms": (A_LMS, ("s_lms", "id_map")),
    "a_academic": (A_ACADEMIC, ("s_academic", "id_map")),
    "joined": (JOINED, ("a_coursera", "a_lms", "a_academic")),
    "integrated": (INTEGRATED, ("joined",)),
}


def with_tables(needs: str, body: str, **extra: str) -> str:
    """`body` after the common table expressions it needs; `extra` adds some of its own."""
    order: list[str] = []

    def visit(name: str) -> None:
        for d in CTES[name][1]:
            visit(d)
        if name not in order:
            order.append(name)

    for name in needs.split():
        visit(name)
    parts = [f"{n} AS ({CTES[n][0]})" for n in order] + [f"{n} AS ({b})" for n, b in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
