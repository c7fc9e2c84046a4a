"""The driver's tables as learner exports and model tables.

Each function has a counterpart of the same name in `lectern.plans.sql`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.exprs import rounded
from lectern.operators.engagement import engagement_scores

REFERENCE_DATE = "2002-01-01"
ROW_ID = "_row_id"


def _hashed(side: DataFrame) -> DataFrame:
    """The smaller side of a join of large tables: each task hashes its share of it, so that the larger side need not be sorted."""
    return side.hint("shuffle_hash")


class Tables:
    """Lazy views of one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def course_activity(self, wide: bool = False) -> DataFrame:
        """Order lines as course enrolments; `wide` adds the customer's unit and place."""
        orders = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
        if wide:
            places = self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            people = self.raw("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
            orders = orders.join(people, F.col("o_custkey") == F.col("c_custkey"))
        lines = self.raw("lineitem")
        done = F.col("l_quantity") * 2 >= 90
        last = F.greatest("l_shipdate", "o_orderdate")
        number = F.col("l_partkey") % 20 + 1
        columns = [
            F.col("o_custkey").cast("string").alias("email"),
            F.concat(F.lit("CRS-"), F.lpad(number.cast("string"), 3, "0")).alias("course_id"),
            F.concat(F.lit("Course "), number.cast("string")).alias("course_name"),
            F.col("o_orderdate").alias("enrollment_ts"),
            F.when(done, last).alias("completion_ts"),
            last.alias("last_activity_ts"),
            (F.col("l_quantity") * 2).alias("progress_pct"),
            F.when(done, 100 - 300 * F.col("l_discount")).alias("grade"),
            (F.col("l_extendedprice") / 10000).alias("learning_hours"),
            done.alias("is_completed"),
            F.col("o_orderpriority").alias("role"),
            F.struct(
                "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
            ).alias(ROW_ID),
        ]
        if wide:
            columns += [
                F.col("c_name").alias("name"),
                F.col("c_mktsegment").alias("business_unit"),
                F.col("n_name").alias("location"),
                F.col("r_name").alias("location_region"),
            ]
        return lines.join(_hashed(orders), F.col("l_orderkey") == F.col("o_orderkey")).select(*columns)

    def video_activity(self) -> DataFrame:
        clip = F.concat("event_type", F.lit("-"), (F.col("event_id") % 12).cast("string"))
        course = F.lpad((F.col("event_id") % 20 + 1).cast("string"), 3, "0")
        return self.raw("events").select(
            F.col("user_id").cast("string").alias("email"),
            F.concat(F.lit("CRS-"), course).alias("course_id"),
            clip.alias("video_id"),
            F.concat(F.lit("Clip "), clip).alias("video_name"),
            (F.col("value") * 60).alias("watch_seconds"),
            F.least("value", F.lit(100.0)).alias("completion_pct"),
            (F.col("event_id") % 4 + 1).alias("watch_count"),
            F.col("ts").alias("last_watch_ts"),
            F.col("event_id").alias(ROW_ID),
        )

    def program_activity(self) -> DataFrame:
        lines = (
            self.raw("lineitem")
            .groupBy("l_orderkey")
            .agg(F.count(F.lit(1)).alias("total_courses"), F.count_if(F.col("l_quantity") >= 45).alias("courses_completed"))
        )
        share = F.col("courses_completed") / F.col("total_courses") * 100
        return (
            self.raw("orders")
            .join(_hashed(lines), F.col("o_orderkey") == F.col("l_orderkey"))
            .select(
                F.col("o_custkey").cast("string").alias("email"),
                F.col("o_orderpriority").alias("program_id"),
                F.col("o_orderpriority").alias("program_name"),
                "total_courses",
                "courses_completed",
                rounded(share, 1).alias("progress_pct"),
                (F.col("o_totalprice") / 10000).alias("learning_hours"),
                (F.col("o_orderstatus") == "F").alias("is_completed"),
                F.col("o_orderdate").alias("enrollment_ts"),
                F.col("o_orderkey").alias(ROW_ID),
            )
        )

    def specialization_activity(self) -> DataFrame:
        orders = self.raw("orders").select("o_orderkey", "o_custkey")
        parts = self.raw("part").select("p_partkey", "p_type")
        rows = (
            self.raw("lineitem")
            .join(_hashed(orders), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        )
        per = rows.groupBy("o_custkey", "p_type").agg(
            F.count(F.lit(1)).alias("total_courses"),
            F.count_if(F.col("l_quantity") >= 45).alias("courses_completed"),
            (F.sum("l_extendedprice") / 10000).alias("learning_hours"),
        )
        share = F.col("courses_completed") / F.col("total_courses") * 100
        return per.select(
            F.col("o_custkey").cast("string").alias("email"),
            F.col("p_type").alias("spec_id"),
            F.col("p_type").alias("spec_name"),
            "total_courses",
            "courses_completed",
            rounded(share, 1).alias("progress_pct"),
            "learning_hours",
            (share >= 50).alias("is_completed"),
        )

    def engagement(self) -> DataFrame:
        return engagement_scores(self.course_activity(), self.video_activity(), REFERENCE_DATE)

    def course_export(self) -> DataFrame:
        """Course activity under the headers of an export, with Yes/No and text times."""
        a = self.course_activity(wide=True)
        text = "yyyy-MM-dd HH:mm:ss"
        return a.select(
            F.col("name").alias("Name"),
            F.col("email").alias("Email"),
            F.col("business_unit").alias("Business Unit"),
            F.col("role").alias("Role"),
            F.col("location").alias("Location"),
            F.col("course_id").alias("Course Id"),
            F.col("course_name").alias("Course Name"),
            F.date_format("enrollment_ts", text).alias("Enrollment Timestamp"),
            F.date_format("last_activity_ts", text).alias("Last Activity Timestamp"),
            F.col("progress_pct").cast("string").alias("Progress (%)"),
            F.col("grade").cast("string").alias("Grade (%)"),
            F.col("learning_hours").alias("Learning Hours"),
            F.when(F.col("is_completed"), "Yes").otherwise("No").alias("Completed"),
            F.col(ROW_ID),
        )

    def program_export(self) -> DataFrame:
        p = self.program_activity()
        return p.select(
            F.col("email").alias("Email"),
            F.col("program_name").alias("Program Name"),
            F.col("total_courses").cast("string").alias("Total Courses in Program"),
            F.col("courses_completed").cast("string").alias("Courses Completed"),
            F.col("learning_hours").alias("Learning Hours"),
            F.when(F.col("is_completed"), "True").otherwise("False").alias("Completed"),
            F.col(ROW_ID),
        )

    def specialization_export(self) -> DataFrame:
        s = self.specialization_activity()
        return s.select(
            F.col("email").alias("Email"),
            F.col("spec_name").alias("Specialization Name"),
            F.col("total_courses").cast("string").alias("Total Courses"),
            F.col("courses_completed").cast("string").alias("Courses Completed"),
            F.col("learning_hours").alias("Learning Hours"),
            F.when(F.col("is_completed"), "yes").otherwise("no").alias("Completed"),
        )

    def video_export(self) -> DataFrame:
        v = self.video_activity()
        return v.select(
            F.col("email").alias("Email"),
            F.col("course_id").alias("Course Name"),
            F.col("video_name").alias("Video Name"),
            F.col("completion_pct").cast("string").alias("Completion (%)"),
            F.col("watch_count").cast("string").alias("Watch Count"),
            (F.col("watch_seconds") / 3600).alias("Learning Hours"),
            F.lit(0.25).alias("Estimated Learning Hours"),
            F.date_format("last_watch_ts", "yyyy-MM-dd HH:mm:ss").alias("Last Watch Timestamp"),
            F.col(ROW_ID),
        )

    def exports(self) -> dict[str, DataFrame]:
        return {
            "course": self.course_export(),
            "program": self.program_export(),
            "specialization": self.specialization_export(),
            "video": self.video_export(),
        }

    def id_map(self) -> DataFrame:
        """Customers as students; every twentieth is missing."""
        key = F.col("c_custkey").cast("string")
        return self.raw("customer").where(F.col("c_custkey") % 20 != 7).select(
            F.concat(F.lit("STU-"), key).alias("student_id"),
            F.concat(F.lit("CR-"), key).alias("coursera_id"),
            F.concat(F.lit("LMS-"), key).alias("lms_id"),
            F.concat(F.lit("AC-"), key).alias("academic_id"),
        )

    def student_sources(self) -> dict[str, DataFrame]:
        a = self.course_activity()
        v = self.raw("events")
        o = self.raw("orders")
        course = F.concat(F.lit("CRS-"), F.lpad((F.col("event_id") % 20 + 1).cast("string"), 3, "0"))
        return {
            "coursera": a.select(
                F.concat(F.lit("CR-"), "email").alias("student_id"),
                "course_id",
                F.col("last_activity_ts").alias("timestamp"),
                F.when(F.col("is_completed"), "quiz_attempt").otherwise("video_watch").alias("activity_type"),
                (F.col("learning_hours") * 60).alias("duration_minutes"),
                (F.col("progress_pct") / 100).alias("completion_pct"),
                F.col("grade").alias("score"),
                ROW_ID,
            ),
            "lms": v.select(
                F.concat(F.lit("LMS-"), F.col("user_id").cast("string")).alias("student_id"),
                course.alias("course_id"),
                F.col("ts").alias("session_start"),
                F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("activity_type"),
                F.col("value").alias("page_views"),
                (F.col("event_id") % 7).alias("forum_posts"),
                F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("score"),
                F.col("event_id").alias(ROW_ID),
            ),
            "academic": o.select(
                F.concat(F.lit("AC-"), F.col("o_custkey").cast("string")).alias("student_id"),
                F.concat(F.lit("CRS-"), F.lpad((F.col("o_orderkey") % 20 + 1).cast("string"), 3, "0")).alias("course_id"),
                F.substring("o_orderpriority", 1, 1).alias("grade"),
                F.date_format("o_orderdate", "yyyy").alias("semester"),
                (F.col("o_totalprice") / 100000).alias("gpa"),
                F.when(F.col("o_orderstatus") == "F", "withdrawn").otherwise("active").alias("enrollment_status"),
                F.col("o_orderkey").alias(ROW_ID),
            ),
        }

    def dirty_orders(self) -> DataFrame:
        """Orders with missing values, mixed time formats, text numbers, out-of-range shares and copies."""
        o = self.raw("orders")
        k = F.col("o_orderkey")
        day = F.date_format("o_orderdate", "yyyy-MM-dd")
        slash = F.date_format("o_orderdate", "MM/dd/yyyy hh:mm a")
        base = o.select(
            F.col("o_custkey").cast("string").alias("customer"),
            F.when(k % 10 != 3, F.col("o_orderpriority")).alias("priority"),
            F.when(k % 7 != 2, F.col("o_totalprice")).alias("amount"),
            F.when(k % 9 != 4, F.col("o_totalprice").cast("string")).otherwise(F.lit("n/a")).alias("amount_text"),
            F.when(k % 3 == 0, F.col("o_orderstatus")).alias("mostly_missing"),
            F.when(k % 11 == 5, "not a date").when(k % 2 == 0, slash).otherwise(day).alias("order_date"),
            (F.col("o_totalprice") / 2000 - 20).alias("share_pct"),
            k.alias("_k"),
        )
        copies = base.where(k % 13 == 0).withColumn(ROW_ID, F.col("_k") * 2 + 1)
        return base.withColumn(ROW_ID, F.col("_k") * 2).unionByName(copies).drop("_k")

    def learner_numbers(self) -> DataFrame:
        """Numeric columns of course activity, with the unit as a group."""
        return self.course_activity(wide=True).select(
            "business_unit", "role", "progress_pct", "learning_hours", "grade", "is_completed"
        )
