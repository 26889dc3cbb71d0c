"""Profiles, lookups, joins, unions and samples."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tests.conftest import pairs
from trafficlens.operators import combine, metrics, profile


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_outer_join_of_sets(spark):
    a = frame(spark, [(1, "a"), (2, "b")], "index long, x string")
    b = frame(spark, [(2, 5), (3, 6), (3, 7)], "index long, y int")
    c = frame(spark, [(4, True), (3, False)], "index long, z boolean")
    got = combine.join_sets([a, b, c])
    chain = a.join(b, "index", "outer").join(c, "index", "outer")
    key = lambda r: str(tuple(r))
    assert sorted(got.collect(), key=key) == sorted(chain.collect(), key=key)
    assert combine.join_sets([a, b], how="inner").count() == 1
    with pytest.raises(ValueError, match="key column"):
        combine.join_sets([a, b.drop("index")])
    with pytest.raises(ValueError, match="join type"):
        combine.join_sets([a, b], how="cross")


def test_outer_join_moves_each_set_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = [spark.range(100).select(F.col("id").alias("index"), F.lit(i).alias(f"c{i}")) for i in range(4)]
        plan = combine.join_sets(sets)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 5  # four sets and the united keys


def test_stacked_sets(spark):
    a = frame(spark, [(1, "a")], "index long, x string")
    b = frame(spark, [(2, 5)], "index long, y int")
    assert combine.stack_sets([a, b]).columns == ["index", "x", "y"]
    assert [tuple(r) for r in combine.stack_sets([a, b], drop="index").collect()] == [("a", None), (None, 5)]


def test_top_countries_and_frequency(spark):
    rows = [("uk",)] * 5 + [("de",)] * 3 + [("ca",)] * 3 + [("non_country",)] * 9
    df = frame(spark, rows, "visitor_country string")
    assert [r[0] for r in profile.top_countries(df, n=2).collect()] == ["uk", "ca"]
    topped = profile.add_top_country(df, 2)
    got = {(r.visitor_country, r.is_top_country): r["count"] for r in topped.groupBy("visitor_country", "is_top_country").count().collect()}
    assert got == {("uk", 1): 5, ("ca", 1): 3, ("other_country", 0): 12}
    shares = pairs(profile.add_frequency(topped, "visitor_country", "f").select("visitor_country", "f").distinct())
    assert shares == {"uk": 0.25, "ca": 0.15, "other_country": 0.6}


def test_nulls_have_no_share(spark):
    df = frame(spark, [("a",), ("a",), ("b",), (None,)], "k string")
    assert pairs(profile.shares(profile.counts_by(df, "k")).select("k", "share")) == {"a": 2 / 3, "b": 1 / 3}


def test_correlations_pairwise(spark):
    df = frame(spark, [(1.0, 2.0, 1.0), (2.0, 4.1, 1.0), (3.0, None, 1.0), (4.0, 8.0, 1.0)], "a double, b double, c double")
    got = {(r.col_a, r.col_b): r["corr"] for r in profile.correlations(df, ["a", "b", "c"]).collect()}
    want = df.where("b is not null").select(F.corr("a", "b")).first()[0]
    assert got[("a", "b")] == pytest.approx(want)
    assert got[("a", "c")] is None and got[("b", "c")] is None


def test_correlations_of_complete_columns(spark):
    df = spark.range(50).select("id", (F.col("id") % 7).alias("m"), F.lit(3).alias("c"))
    got = {(r.col_a, r.col_b): r["corr"] for r in profile.correlations(df, ["id", "m", "c"]).collect()}
    assert got[("id", "m")] == pytest.approx(df.select(F.corr("id", "m")).first()[0])
    assert got[("id", "c")] is None


def test_counts_per_column(spark):
    df = frame(spark, [("x", None), ("y", 1), ("x", 1)], "a string, b int")
    assert pairs(profile.null_counts(df)) == {"a": 0, "b": 1}
    assert pairs(profile.distinct_counts(df)) == {"a": 2, "b": 1}


def test_pivot(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 03:00:00' timestamp union all select timestamp_ntz'2024-01-02 03:59:00' union all select null")
    got = profile.hour_by_date(profile.counts_by_day_hour(df)).collect()
    assert [r.asDict() for r in got] == [{"hour": 3, "2024-01-01": 1, "2024-01-02": 1}]


@pytest.mark.parametrize("n", [0, 1, 257, 4000, 9999])
def test_sample_equals_full_sort(spark, n):
    df = spark.range(5000)
    got = [r.id for r in profile.fixed_sample(df, "id", n).collect()] if n else []
    want = sorted(range(5000), key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())[:n]
    assert sorted(got) == sorted(want)


def test_trend(spark):
    df = frame(spark, [(float(x), 3.0 * x + 1) for x in range(10)], "x double, y double")
    r = profile.trend(df, "x", "y").first()
    assert (r.slope, r.intercept, r.n) == (pytest.approx(3), pytest.approx(1), 10)


def test_fence_and_action(spark):
    df = frame(spark, [("s", float(v)) for v in (0, 1, 2, 3, 4, 100)], "split string, bytes double")
    r = profile.outlier_fence(df).first()
    assert (r.q1, r.q3, r.fence) == (2.0, 4.0, 7.0)


def test_metrics(spark):
    df = frame(spark, [(0.0, 1.0), (1.0, 3.0), (2.0, 1.0)], "actual double, predicted double")
    r = metrics.score(df).first()
    assert (r.MSE, r.RMSE, r.MAE, r.MAPE) == (2.0, pytest.approx(2 ** 0.5), pytest.approx(4 / 3), 0.5)
    assert metrics.score(df.where("actual <= 1")).first().MAPE == 0.0
    assert metrics.score(df, masked=False).first().MAPE == pytest.approx((1 / 2.220446049250313e-16 + 2 + 0.5) / 3)
