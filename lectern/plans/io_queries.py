"""Queries on sources and sinks: tables are written to a new folder and read back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.exprs import number
from lectern.operators import engagement, statistics, transformation
from lectern.plans.registry import Registry
from lectern.plans.sql import rnd, with_tables
from lectern.plans.tables import ROW_ID, Tables
from lectern.session import scratch_folder, side_by_side
from lectern.sources import readers, writers


def _written(df: DataFrame, folder: str, name: str, encoding: str = "utf-8") -> str:
    path = f"{folder}/{name}"
    df.write.option("header", True).option("encoding", encoding).csv(path)
    return path


def _course_file(t: Tables, name: str = "course_activity.csv", folder: str | None = None) -> str:
    return _written(t.course_export().drop(ROW_ID), folder or scratch_folder(t.spark), name)


def _named_exports(t: Tables) -> str:
    """A folder with one export per kind, a modified copy and a file of no kind, written side by side."""
    folder = scratch_folder(t.spark)
    files = [
        (t.course_export().drop(ROW_ID), "Course_Activity.csv"),
        (t.course_export().drop(ROW_ID).limit(0), "Course_Activity_Modified.csv"),
        (t.program_export().drop(ROW_ID), "program_activity.csv"),
        (t.specialization_export(), "specialization_activity.csv"),
        (t.video_export().drop(ROW_ID), "video_clip_activity.csv"),
        (t.raw("nation"), "nations.csv"),
    ]
    side_by_side(lambda file: _written(file[0], folder, file[1]), files)
    return folder


def _platform_headers(t: Tables) -> DataFrame:
    """The course export under the other set of headers."""
    names = {
        "Course Name": "Course", "Enrollment Timestamp": "Enrollment Time", "Progress (%)": "Overall Progress",
        "Last Activity Timestamp": "Last Course Activity Time", "Grade (%)": "Course Grade", "Role": "Job Title",
        "Location": "Location City",
    }
    return t.course_export().withColumnsRenamed(names)


def _counts(df: DataFrame) -> DataFrame:
    """Per course: rows, completions and total progress, from text columns."""
    return df.groupBy(F.col("Course Name").alias("course_name")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("Completed") == "Yes").alias("completed"),
        F.sum(number("Progress (%)")).alias("progress"),
        F.countDistinct("Email").alias("learners"),
    )


COUNTS = f"""SELECT course_name, count(*) AS n, count(*) FILTER (WHERE is_completed) AS completed,
    {rnd('sum(progress_pct)')} AS progress, count(DISTINCT email) AS learners FROM ca GROUP BY course_name"""


def _sources(r: Registry) -> None:
    sql = with_tables("ca", COUNTS)
    r.add("src_1_csv_scan", lambda t: _counts(readers.read_csv(t.spark, _course_file(t))), sql)

    def over_lines(t: Tables) -> DataFrame:
        """Texts with line ends, quotes and commas of their own, written as fields."""
        texts = t.raw("documents").select("doc_id", "lang", "text")
        path = f"{scratch_folder(t.spark)}/texts.csv"
        keep = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        texts.write.options(**keep).csv(path)
        back = readers.read_csv_any_encoding(t.spark, path)
        return back.groupBy("lang").agg(
            F.count("doc_id").alias("n"), F.sum(F.length("text")).alias("chars"),
            F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n")))).alias("line_ends"),
        )

    r.add(
        "src_1_records_over_lines",
        over_lines,
        """SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars,
            CAST(sum(length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS line_ends FROM documents GROUP BY 1""",
    )

    def latin(t: Tables) -> DataFrame:
        text = t.raw("customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat("c_mktsegment", F.lit("-Université")).alias("unit"))
        file = _written(text, scratch_folder(t.spark), "units.csv", "ISO-8859-1")
        return readers.read_csv_any_encoding(t.spark, file).groupBy("unit").agg(F.count("id").alias("n"))

    r.add(
        "src_2_encoding_fallback",
        latin,
        "SELECT c_mktsegment || '-Université' AS unit, count(*) AS n FROM customer GROUP BY 1",
    )
    r.add("src_3_validated_ingest", lambda t: _counts(readers.read_export(t.spark, _course_file(t), "course")), sql)

    def directory(t: Tables) -> DataFrame:
        frames, _ = readers.read_directory(t.spark, _named_exports(t), "*activity.csv")
        out = None
        for name, df in frames.items():
            part = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
            out = part if out is None else out.unionByName(part)
        return out

    r.add(
        "src_4_directory_ingest",
        directory,
        with_tables(
            "pa sa",
            """SELECT 'program_activity' AS name, count(*) AS n FROM pa UNION ALL SELECT 'specialization_activity', count(*) FROM sa
            UNION ALL SELECT 'video_clip_activity', count(*) FROM events""",
        ),
    )
    log = """SELECT 'Course_Activity.csv' AS file, 'course' AS source_type, count(*) AS rows, 13 AS columns FROM lineitem
        UNION ALL SELECT 'program_activity.csv', 'program', count(*), 6 FROM pa
        UNION ALL SELECT 'specialization_activity.csv', 'specialization', count(*), 6 FROM sa
        UNION ALL SELECT 'video_clip_activity.csv', 'video', count(*), 8 FROM events"""
    for name in ("src_5_detected_exports", "src_10_load_log"):
        r.add(
            name,
            lambda t: readers.load_log(readers.read_exports(t.spark, _named_exports(t))),
            with_tables("pa sa", log),
        )
    r.add(
        "src_6_normalised_headers",
        lambda t: _counts(readers.normalise_headers(_platform_headers(t), "course")),
        sql,
    )
    r.add(
        "src_7_rename_existing",
        lambda t: readers.rename_existing(t.raw("nation"), {"n_name": "location", "absent": "x"}),
        "SELECT n_nationkey, n_name AS location, n_regionkey FROM nation",
    )

    def required(t: Tables) -> DataFrame:
        sources = t.student_sources()
        out = None
        for name, df in sources.items():
            readers.check_student_source(df.withColumn("session_end", F.lit(None)), name)
            part = df.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n"))
            out = part if out is None else out.unionByName(part)
        return out

    r.add(
        "src_8_required_columns",
        required,
        """SELECT 'coursera' AS source, count(*) AS n FROM lineitem UNION ALL SELECT 'lms', count(*) FROM events
        UNION ALL SELECT 'academic', count(*) FROM orders""",
    )

    def checked(t: Tables) -> DataFrame:
        out = None
        for kind, df in t.exports().items():
            readers.check_export(df, kind)
            part = df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
            out = part if out is None else out.unionByName(part)
        return out

    r.add(
        "src_9_required_export_columns",
        checked,
        with_tables(
            "pa sa",
            """SELECT 'course' AS kind, count(*) AS n FROM lineitem UNION ALL SELECT 'program', count(*) FROM pa
            UNION ALL SELECT 'specialization', count(*) FROM sa UNION ALL SELECT 'video', count(*) FROM events""",
        ),
    )
    r.add(
        "src_11_id_map",
        lambda t: readers.read_id_map(t.spark, _written(t.id_map(), scratch_folder(t.spark), "student_mapping.csv")),
        with_tables("id_map", "SELECT student AS student_id, coursera_id, lms_id, academic_id FROM id_map"),
    )


def _sinks(r: Registry) -> None:
    def exported(t: Tables, fmt: str) -> DataFrame:
        folder = scratch_folder(t.spark)
        path = writers.export_table(t.engagement(), folder, "engagement", fmt, datetime(2002, 1, 1))
        back = t.spark.read.parquet(path) if fmt == "parquet" else readers.read_csv(t.spark, path)
        return back.select("email", number("score").alias("score"), "category")

    eng = with_tables("eng", "SELECT email, score, category FROM eng")
    r.add("snk_1_csv_export", lambda t: exported(t, "csv"), eng)
    r.add("snk_1_parquet_export", lambda t: exported(t, "parquet"), eng)

    def named(t: Tables) -> DataFrame:
        tables = {"course_activity": t.course_activity(), "video_activity": t.video_activity()}
        path = writers.export_named(tables, "video_activity", scratch_folder(t.spark), "parquet")
        return t.spark.read.parquet(path).groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))

    r.add("snk_2_named_table", named, with_tables("va", "SELECT video_id, count(*) AS n FROM va GROUP BY 1"))

    def report(t: Tables) -> DataFrame:
        a = t.course_activity().select("progress_pct", "learning_hours")
        paths = writers.export_report(
            {"distributions": statistics.distributions(a), "correlations": statistics.correlations(a)}, scratch_folder(t.spark)
        )
        dist = readers.read_csv(t.spark, paths["distributions"]).select("feature", number("mean").alias("mean"))
        corr = readers.read_csv(t.spark, paths["correlations"]).select("feature", number("learning_hours").alias("r"))
        return dist.join(corr, "feature")

    r.add(
        "snk_3_report_package",
        report,
        with_tables(
            "ca",
            f"""SELECT 'progress_pct' AS feature, {rnd('avg(progress_pct)')} AS mean, {rnd('corr(progress_pct, learning_hours)')} AS r FROM ca
            UNION ALL SELECT 'learning_hours', {rnd('avg(learning_hours)')}, 1.0 FROM ca""",
        ),
    )

    def workbook(t: Tables) -> DataFrame:
        scores = t.engagement()
        tables = {"program_activity": transformation.program_activity(t.program_export()).drop(ROW_ID)}
        paths = writers.export_workbook(
            tables, scratch_folder(t.spark), kpis=engagement.score_summary(scores), engagement=scores
        )
        out = None
        for name, path in paths.items():
            part = readers.read_csv(t.spark, path).agg(F.lit(name).alias("sheet"), F.count(F.lit(1)).alias("n"))
            out = part if out is None else out.unionByName(part)
        return out

    r.add(
        "snk_4_workbook_tables",
        workbook,
        with_tables(
            "pa ca",
            """SELECT 'program_activity' AS sheet, count(*) AS n FROM pa UNION ALL SELECT 'kpis', 1
            UNION ALL SELECT 'engagement_scores', count(DISTINCT email) FROM ca""",
        ),
    )


def register(r: Registry) -> None:
    for part in (_sources, _sinks):
        part(r)
