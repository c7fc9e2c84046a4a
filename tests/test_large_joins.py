"""Large joins of the driver's tables need no sort of the larger side."""

from datetime import datetime

from lectern.plans.tables import Tables


def small_tables(spark, folder):
    day = datetime(2000, 1, 1)
    made = {
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
        "nation": ([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(1, "C", 0, 1.0, "S")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "part": ([(5, "T")], "p_partkey long, p_type string"),
        "orders": (
            [(7, 1, "F", 10.0, day, "1-URGENT"), (8, None, "F", 10.0, day, "2-HIGH"), (None, 1, "F", 10.0, day, "2-HIGH")],
            "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
        ),
        "lineitem": (
            [(7, 5, 1, 1, 50.0, 100.0, 0.1, day), (7, 5, 1, 2, 10.0, 100.0, 0.1, day), (8, 5, 1, 1, 1.0, 1.0, 0.0, day), (None, 5, 1, 1, 1.0, 1.0, 0.0, day)],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp",
        ),
        "events": ([(0, day, 1, "click", 2.0)], "event_id long, ts timestamp, user_id long, event_type string, value double"),
    }
    for name, (rows, shape) in made.items():
        spark.createDataFrame(rows, shape).write.parquet(f"{folder}/{name}.parquet")
    return Tables(spark, str(folder))


def test_order_lines_are_joined_without_a_sort(spark, tmp_path):
    tables = small_tables(spark, tmp_path)
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tables.course_activity()._jdf.queryExecution().executedPlan().toString()
        wide = tables.course_export()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted((r["Email"], r["Progress (%)"]) for r in wide.collect()) == [("1", "100.0"), ("1", "20.0")]
        assert sorted(r["Email"] for r in tables.program_export().collect() if r["Email"]) == ["1"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
