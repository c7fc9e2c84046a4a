"""Cleaning on the small literal frame and on hand-made traps."""

import pytest
from pyspark.sql import functions as F

from lectern.functions.exprs import number, right_closed_bins, rounded, timestamp, whole_days, yes_no
from lectern.operators import cleaning

ROWS = [
    ("a@test.com", 85.0, "A", "2024-01-01", 50, 0),
    ("b@test.com", None, "B", "2024-02-15", 110, 1),
    ("a@test.com", 85.0, "A", "2024-01-01", 50, 2),
    ("c@test.com", 92.0, "A", "invalid", -5, 3),
]
SCHEMA = "Email string, score double, category string, timestamp string, `Progress (%)` int, _row_id long"


def test_literal_frame(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    out = cleaning.clean_export(df, cleaning.CleanOptions(order_by=("_row_id",)))
    rows = {r["Email"]: r for r in out.collect()}
    assert len(rows) == 3 and out.count() == 3
    assert rows["b@test.com"]["score"] == 88.5
    assert rows["c@test.com"]["timestamp"] is None
    assert rows["a@test.com"]["timestamp"].year == 2024
    assert (rows["b@test.com"]["Progress (%)"], rows["c@test.com"]["Progress (%)"]) == (100, 0)
    report = cleaning.cleaning_report(df, out, ["_row_id"]).first()
    assert (report["rows_before"], report["rows_removed"], report["missing_before"]) == (4, 1, 1)


def test_drop_strategies_are_sequential(spark):
    df = spark.createDataFrame(
        [(None, "x", 1), (1.0, "y", 2), (2.0, None, 3), (None, "x", 4)], "n double, c string, _row_id long"
    )
    out = cleaning.fill_missing(df, "drop", "mode", order_by=["_row_id"])
    assert sorted((r["n"], r["c"]) for r in out.collect()) == [(1.0, "y"), (2.0, "y")]
    with pytest.raises(ValueError):
        cleaning.fill_missing(df, "other", "mode")


def test_mode_takes_smallest_of_ties(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("a", 4), (None, 5)], "c string, _row_id long")
    out = cleaning.fill_missing(df, order_by=["_row_id"])
    assert {r["_row_id"]: r["c"] for r in out.collect()}[5] == "a"


@pytest.mark.parametrize("keep,ids", [("first", [1, 3]), ("last", [2, 3]), ("false", [3])])
def test_duplicates(spark, keep, ids):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("b", 1, 3)], "k string, v int, _row_id long")
    out = cleaning.remove_duplicates(df, keep, order_by=["_row_id"])
    assert sorted(r["_row_id"] for r in out.collect()) == ids


@pytest.mark.parametrize("keep,ids", [("first", [None, 4]), ("last", [2, 4]), ("false", [4])])
def test_duplicates_without_an_order_come_first(spark, keep, ids):
    rows = [("a", float("nan"), 2), ("a", float("nan"), None), ("a", float("nan"), 1), (None, None, 4)]
    df = spark.createDataFrame(rows, "k string, v double, _row_id long")
    by_hash = cleaning.remove_duplicates(df, keep, order_by=["_row_id"])
    by_row = cleaning.remove_duplicates(df.withColumn("more", F.lit("x")), keep, ["k", "v"], ["_row_id"])
    for out in (by_hash, by_row):
        assert sorted((r["_row_id"] for r in out.collect()), key=str, reverse=True) == sorted(ids, key=str, reverse=True)


@pytest.mark.parametrize("keep,ids", [("first", [1, 3]), ("last", [2, 3]), ("false", [3])])
def test_duplicates_with_clashing_names(spark, keep, ids):
    rows = [("a", 1, 1), ("a", 1, 2), ("b", 5, 3)]
    df = spark.createDataFrame(rows, "_row string, _COPIES int, _row_id long")
    by_hash = cleaning.remove_duplicates(df, keep, order_by=["_row_id"])
    by_row = cleaning.remove_duplicates(df, keep, ["_row"], ["_row_id"])
    for out in (by_hash, by_row):
        assert out.columns == df.columns
        assert sorted(r["_row_id"] for r in out.collect()) == ids


@pytest.mark.parametrize("keep", ["first", "last", "false"])
def test_duplicates_need_no_sort(spark, keep):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 2)], "k string, v int, _row_id long")
    plan = cleaning.remove_duplicates(df, keep, order_by=["_row_id"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_sparse_columns_and_types(spark):
    df = spark.createDataFrame(
        [("1", None, "x"), ("2.5", None, "1"), ("3e1", "v", "y"), ("n/a", "w", None)], "a string, b string, c string"
    )
    assert cleaning.drop_sparse_columns(df, 0.5).columns == ["a", "b", "c"]
    assert cleaning.drop_sparse_columns(df, 0.4).columns == ["a", "c"]
    typed = cleaning.infer_numbers(df, 0.5)
    assert [r["a"] for r in typed.collect()] == [1.0, 2.5, 30.0, None]
    assert dict(typed.dtypes)["c"] == "string"


def test_quality_kpis(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1)], "k string, v int")
    assert tuple(cleaning.quality_kpis(df).first()) == (3, 2, 1, 2)


def test_scalars(spark):
    df = spark.createDataFrame(
        [("Yes", "12", "2024-03-01 10:00:00"), ("no", "x", "03/01/2024 10:00 PM"), (None, " 1.5 ", "?")], "b string, n string, t string"
    )
    got = df.select(yes_no("b").alias("b"), number("n").alias("n"), timestamp("t").alias("t")).collect()
    assert [r["b"] for r in got] == [True, False, False]
    assert [r["n"] for r in got] == [12.0, None, 1.5]
    assert [r["t"] and r["t"].hour for r in got] == [10, 22, None]


def test_rounding_bins_and_days(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (10.1,), (100.0,), (100.1,), (-0.1,)], "v double")
    bins = [r[0] for r in df.select(right_closed_bins("v", [0, 10, 100], ["low", "high"])).collect()]
    assert bins == ["low", "low", "high", "high", None, None]
    assert spark.range(1).select(rounded(F.lit(12.25), 1), rounded(F.lit(2.5), 0)).first()[:] == (12.2, 2.0)
    days = spark.sql("SELECT timestamp'2024-01-02 12:00:00' a, timestamp'2024-01-01 13:00:00' b")
    assert days.select(whole_days("a", "b"), whole_days("b", "a")).first()[:] == (0, -1)


def test_timestamp_forms(spark):
    texts = {"2024-01-02T03:04:05.250Z": "03:04:05.25", "2024-01-02 03:04:05+02:00": "01:04:05", "2024/01/02 03:04:05": "03:04:05", "2024/01/02": "00:00:00", "2024": None, "x": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", timestamp("t").cast("string").alias("v"))
    assert {r.t: r.v for r in df.collect()} == {t: v and f"2024-01-02 {v}" for t, v in texts.items()}


def test_times_in_free_forms(spark):
    """The forms that a reader of mixed dates takes; what is no date stays null."""
    want = {
        "5 Jan 2024": "2024-01-05 00:00:00", "05-Jan-2024 13:45": "2024-01-05 13:45:00", "January 5, 2024": "2024-01-05 00:00:00",
        "Fri, 05 Jan 2024 13:45:10 GMT": "2024-01-05 13:45:10", "sept. 3rd, 2024 at 4 pm": "2024-09-03 16:00:00", "1st of March 2024 12:05 AM": "2024-03-01 00:05:00",
        "20240105": "2024-01-05 00:00:00", "20240105T134510": "2024-01-05 13:45:10", "20240105134510": "2024-01-05 13:45:10",
        "31/12/2024": "2024-12-31 00:00:00", "1/2/2024": "2024-01-02 00:00:00", "31.12.2024 23:59:58.5": "2024-12-31 23:59:58.5", "2024.1.5": "2024-01-05 00:00:00",
        "05-01-2024": "2024-05-01 00:00:00", "1/2/2024 3:04:05 PM": "2024-01-02 15:04:05", "2024/01/05 10:00:00 +0200": "2024-01-05 08:00:00",
        "May 5 2024, 10:00 -05:00": "2024-05-05 15:00:00",
        "invalid": None, "31 Foo 2024": None, "32/13/2024": None, "2024": None, "13/13/2024": None, "30 Feb 2024": None, "Jan 5": None, "1/2/2024 7": None, "12345678": None, "": None,
    }
    df = spark.createDataFrame([(t,) for t in want], "t string").repartition(3)
    got = {r.t: r.v for r in df.select("t", timestamp("t").cast("string").alias("v")).collect()}
    assert got == want
    assert df.select(timestamp("t", ["yyyy"]).alias("v")).where("v is not null").count() == 1
