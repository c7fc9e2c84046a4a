"""A cross-section of the registered queries against DuckDB on the smallest tables.

`check_oracle.py` compares all of them.
"""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, canon

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "crs_1_completion_rates", "crs_2_drop_off", "crs_3_time_to_completion", "crs_4_engagement_vs_completion", "crs_7_drop_off_totals",
    "lrn_1_active_vs_inactive", "lrn_2_learning_velocity", "lrn_3_completion_summary", "lrn_4_completion_by_role", "lrn_5_top_learners",
    "prg_1_success_rates", "prg_3_progress_by_program", "vid_1_watch_frequency", "vid_3_rewatch_patterns",
    "eng_5_engagement_scores", "skl_3_skill_scores", "skl_5_skill_gaps", "skl_7_skill_timeline", "cln_1_clean_export", "cln_2_clean_student_source",
    "cln_4_type_inference", "cln_5_drop_duplicates", "cln_6_fill_median", "cln_7_fill_mode", "cln_12_quality_kpis", "trf_1_learner_dimension",
    "trf_2_course_dimension", "trf_6_video_activity", "int_3_integrate", "jon_1_id_mapping", "fea_3_assessment_improvement", "fea_10_generate_features",
    "fea_11_learner_matrix", "hst_1_hours_per_learner_histogram", "pvt_1_cohort_pivot", "sta_1_distributions", "sta_3_pearson", "sta_4_spearman",
    "sta_5_kendall", "ins_11_all_insights", "src_3_validated_ingest", "src_5_detected_exports", "snk_1_csv_export",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, con, name):
    got = canon(entry.queries()[name](spark, FOLDER).toPandas())
    assert got == canon(con.execute(entry.oracle_sql()[name]).df()) and got
