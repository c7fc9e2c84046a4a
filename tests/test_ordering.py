"""Order statistics against numpy and pandas, on skewed data and after repartitioning."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.functions import ordering
from lectern.functions.ordering import exact_quantiles, ordered_window, prefix_counts, value_counts

RNG = np.random.default_rng(5)
N = 3000


@pytest.fixture(scope="module")
def skewed(spark):
    key = np.where(RNG.random(N) < 0.6, "hot", RNG.choice(list("abcdef"), N))
    value = np.where(RNG.random(N) < 0.35, 7.0, RNG.normal(0, 50, N).round(2))
    when = np.where(RNG.random(N) < 0.3, 100, RNG.integers(0, 1000, N))
    pdf = pd.DataFrame({"key": key, "value": value, "when": when, "id": np.arange(N)})
    df = spark.createDataFrame(pdf)
    return pdf, df.withColumn("value", F.when(F.col("id") % 11 != 0, F.col("value")))


@pytest.fixture(scope="module")
def expected(skewed):
    return skewed[0].assign(value=lambda d: d["value"].where(d["id"] % 11 != 0))


@pytest.mark.parametrize("parts", [1, 5])
def test_quantiles_are_exact(skewed, expected, parts):
    df = skewed[1].repartition(parts)
    marks = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = exact_quantiles(df, "value", marks, ["key"]).toPandas().set_index("key")
    for name, p in marks.items():
        want = expected.groupby("key")["value"].quantile(p)
        assert np.allclose(got[name].sort_index(), want.sort_index())
    whole = exact_quantiles(df, "value", marks).toPandas().iloc[0]
    assert np.allclose([whole[m] for m in marks], expected["value"].quantile(list(marks.values())))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "value double")
    assert exact_quantiles(df, "value", {"m": 0.5}).first()["m"] is None


def test_prefix_counts(skewed, expected):
    got = prefix_counts(value_counts(skewed[1], "value", ["key"]), "value", ["key"]).toPandas()
    got = got.rename(columns={"_before": "before", "_cnt": "cnt", "_n": "n"})
    for row in got.sample(100, random_state=1).itertuples():
        group = expected[expected["key"] == row.key]["value"].dropna()
        assert (row.before, row.cnt, row.n) == ((group < row.value).sum(), (group == row.value).sum(), len(group))


@pytest.mark.parametrize("parts", [1, 7])
def test_ordered_window(skewed, expected, parts):
    df = skewed[1].repartition(parts)
    got = ordered_window(
        df, ["key"], ["when", "id"], row_number="rn", lag={"prev": "value"}, running_max={"top": "value"}
    ).toPandas().sort_values("id", ignore_index=True)
    want = expected.sort_values(["when", "id"])
    groups = want.groupby("key")
    want = want.assign(
        rn=groups.cumcount() + 1,
        prev=groups["value"].shift(),
        top=groups["value"].transform(lambda s: s.expanding(min_periods=1).max()),
    ).sort_values("id", ignore_index=True)
    for c in ("rn", "prev", "top"):
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True), c


def test_any_number_of_buckets(spark, skewed, monkeypatch):
    """Twenty thousand buckets along each of five columns: their product needs more than 64 bits, a struct does not."""
    monkeypatch.setattr(ordering, "bucket_count", lambda _: 20_000)
    df = skewed[1].limit(100).coalesce(1).select("key", "when", (F.col("id") % 3).alias("a"), (F.col("id") % 2 == 0).alias("b"), F.col("value"), "id")
    got = ordered_window(df, ["key"], ["when", "a", "b", "value", "id"], row_number="rn").toPandas()
    got["value"] = got["value"].fillna(-np.inf)
    want = got.sort_values(["when", "a", "b", "value", "id"])
    assert (want.groupby("key").cumcount() + 1 == want["rn"]).all()


@pytest.mark.parametrize("parts", [1, 6])
def test_text_orderings_are_cut(spark, parts):
    rng = np.random.default_rng(9)
    words = [None, "", "a", "a\0", "é", "日本", "z" * 30, "z" * 30 + "b", "prefix-of-many-texts-1", "prefix-of-many-texts-2"]
    words += ["".join(rng.choice(list("abcß日"), rng.integers(1, 9))) for _ in range(300)]
    rows = [("hot" if i % 3 else "k", words[int(j)], i) for i, j in enumerate(rng.integers(0, len(words), 900))]
    df = spark.createDataFrame(rows, "key string, word string, id long").repartition(parts)
    cut = [(r["word"], tuple(r["_seg"])) for r in ordering.with_order_bucket(df, ["word"]).collect()]
    assert len({place for _, place in cut}) > 5
    seg = {}
    for word, place in cut:
        assert seg.setdefault(word, place) == place
    along = sorted(seg, key=lambda w: b"" if w is None else b"\1" + w.encode())
    assert [seg[w] for w in along] == sorted(seg.values())
    got = ordered_window(df, ["key"], ["word", "id"], row_number="rn", lag={"prev": "word"}).collect()
    for key in ("hot", "k"):
        mine = sorted((r for r in got if r.key == key), key=lambda r: (b"" if r.word is None else b"\1" + r.word.encode(), r.id))
        assert [r.rn for r in mine] == list(range(1, len(mine) + 1)) and [r.prev for r in mine] == [None, *[r.word for r in mine[:-1]]]
    with pytest.raises(ValueError, match="must start with"):
        ordering.with_order_bucket(df.withColumn("m", F.array("word")), ["m"])


@pytest.mark.parametrize("whole_rows", [0, 50, 1000])
def test_only_large_groups_are_cut(spark, whole_rows):
    rng = np.random.default_rng(4)
    rows = [("hot" if i % 2 else f"k{i % 9}", int(w), None if i % 7 == 0 else float(v), i) for i, (w, v) in enumerate(rng.integers(0, 40, (600, 2)))]
    df = spark.createDataFrame([*rows, (None, 1, 1.0, 600)], "key string, when int, value double, id long").repartition(4)
    out = ordered_window(df, ["key"], ["when", "id"], row_number="rn", lag={"prev": "value"}, running_max={"top": "value"}, whole_rows=whole_rows)
    cut = "percentile_approx" in out._jdf.queryExecution().executedPlan().toString()
    assert cut == (whole_rows < 300)  # half of the rows have one key
    got = out.toPandas().sort_values(["key", "when", "id"], ignore_index=True)
    assert len(got) == 600  # rows without a key are left out
    groups = got.groupby("key")
    assert (groups.cumcount() + 1 == got["rn"]).all()
    assert np.allclose(got["prev"], groups["value"].shift(), equal_nan=True)
    assert np.allclose(got["top"], groups["value"].transform(lambda s: s.ffill().expanding(min_periods=1).max()), equal_nan=True)


def test_small_groups_are_not_cut(spark):
    """The bounds, the joins and the second windows cost more than the rows where every group fits a task."""
    df = spark.range(100).select((F.col("id") % 5).alias("key"), "id")
    plan = ordered_window(df, ["key"], ["id"], row_number="rn")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Window [") == 1
