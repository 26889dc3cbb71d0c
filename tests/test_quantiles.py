"""Exact quantiles against numpy."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from trafficlens.operators import profile, quantiles
from trafficlens.operators.quantiles import (
    exact_quantiles, merged_sketches, quantile_sketches, quantiles_of_counts, sketched_quantiles, value_counts,
)
from trafficlens.session import written

PROBS = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}


def check(got, values):
    want = np.quantile(values, list(PROBS.values()))
    assert got["n"] == len(values)
    np.testing.assert_allclose([got[k] for k in PROBS], want, rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("seed", range(3))
def test_groups_of_all_sizes(spark, seed):
    rng = np.random.default_rng(seed)
    groups = {
        "hot": rng.integers(0, 5, 6000) * 1.5, "wide": rng.lognormal(0, 5, 2000),
        "one": np.array([3.25]), "signs": rng.normal(0, 100, 501), "same": np.full(99, 7.0),
        "zero": np.zeros(10),
    }
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double")
    got = {r.k: r.asDict() for r in exact_quantiles(df, "v", PROBS, ["k"]).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        check(got[k], vs)


def test_nulls_and_no_keys(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", None), ("a", 2.0), ("a", 4.0)], "k string, v double")
    assert [tuple(r) for r in exact_quantiles(df, "v", {"m": 0.5}, ["k"]).collect()] == [("a", 2, 3.0)]
    assert tuple(exact_quantiles(df, "v", {"m": 0.5}).first()) == (3, 2.0)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e9, 1e9, allow_nan=False).map(lambda v: round(v, 3)), min_size=1, max_size=40))
def test_any_values(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = exact_quantiles(df, "v", PROBS).first().asDict()
    want = np.quantile(values, list(PROBS.values()))
    np.testing.assert_allclose([got[k] for k in PROBS], want, rtol=1e-9, atol=1e-9)


def test_counts_are_read_once(spark):
    df = spark.range(1000).select((F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 3).alias("k"))
    q = exact_quantiles(df, "v", {"m": 0.5}, ["k"])
    q.collect()
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan or plan.count("Range (0, 1000") <= 2


def test_summary_mode_prefers_smallest(spark):
    df = spark.createDataFrame([("s", v) for v in (1.0, 2.0, 2.0, 1.0, 9.0)], "split string, bytes double")
    r = profile.summary(df).first()
    assert (r["mean"], r["median"], r["mode"], r["max"]) == (3.0, 2.0, 1.0, 9.0)


def test_box_summary_whiskers(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([("c", v) for v in values], "k string, v double")
    r = profile.box_summary(df, "k", "v").first()
    assert (r.n, r.q1, r["median"], r.q3, r.whisker_low, r.whisker_high) == (5, 2.0, 3.0, 4.0, 1.0, 4.0)


def test_histogram_last_bin_holds_maximum(spark):
    df = spark.createDataFrame([("s", float(v)) for v in range(101)], "split string, bytes double")
    got = {r["bin"]: r["count"] for r in profile.histogram(df).collect()}
    assert got[99] == 2 and sum(got.values()) == 101
    flat = spark.createDataFrame([("s", 5.0)] * 3, "split string, bytes double")
    assert [tuple(r) for r in profile.histogram(flat).collect()] == [("s", 0, 3)]


def test_every_value_its_own_in_one_hot_group(spark):
    """Values next to each other, one far off, small limits: several rounds of cutting."""
    rng = np.random.default_rng(5)
    groups = {
        "hot": 1.0 + rng.permutation(6000) * 2.0 ** -52, "outlier": np.append(1.0 + np.arange(900) * 2.0 ** -50, 1.01),
        "negative": -rng.uniform(3.0, 3.01, 1500), "few": rng.normal(0, 1, 5),
        "huge": np.append(rng.uniform(1e307, 1.7e308, 200), 5e-324),
    }
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double")
    counts = value_counts(df, "v", ["k"])
    got = {r.k: r.asDict() for r in quantiles_of_counts(counts, ["k"], PROBS, most=8, pieces=4).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k]["n"] == len(values)
        # Neighbours differ in the last bits only, so the comparison is by rank.
        ordered = np.sort(values)
        for name, p in PROBS.items():
            at = (len(values) - 1) * p
            assert ordered[int(np.floor(at))] <= got[k][name] <= ordered[int(np.ceil(at))]


def test_no_task_orders_more_than_the_limit(spark):
    """What a walk puts in order is bounded, however many values a bin has."""
    df = spark.range(50_000).select((1.0 + F.col("id") / 1e7).alias("v"))
    counts = written(value_counts(df, "v"), "values")
    seen = []
    real = quantiles.lookup

    def watched(table, name):
        out = real(table, name)
        seen.append(max((r["_values"] for r in out.collect()), default=0))
        return out

    quantiles.lookup = watched
    try:
        got = quantiles_of_counts(counts, (), {"m": 0.5}, most=100).first()
    finally:
        quantiles.lookup = real
    assert got["m"] == pytest.approx(1.0 + 24_999.5 / 1e7, rel=1e-12)
    assert seen[0] > 100 and seen[-1] <= 100


def test_infinite_values_and_empty_input(spark):
    df = spark.createDataFrame([(v,) for v in (float("-inf"), 1.0, 2.0, 3.0, float("inf"))], "v double")
    got = exact_quantiles(df, "v", {"m": 0.5, "q": 0.25, "top": 1.0}).first()
    assert (got["n"], got["m"], got["q"], got["top"]) == (5, 2.0, 1.0, float("inf"))
    assert exact_quantiles(df.where("v > 9e9 and v < 0"), "v", {"m": 0.5}).count() == 0


def test_sketches_of_parts_merge(spark):
    rng = np.random.default_rng(2)
    values = rng.lognormal(3, 2, 40_000)
    df = spark.createDataFrame([(int(i % 4), float(v)) for i, v in enumerate(values)], "day int, v double")
    df = df.withColumn("k", F.lit("a"))
    parts = quantile_sketches(df, "v", ["k", "day"])
    assert parts.count() == 4
    got = sketched_quantiles(merged_sketches(parts, ["k"]), {"q1": 0.25, "m": 0.5, "top": 0.99}, ["k"]).first()
    assert got["n"] == len(values)
    for name, p in (("q1", 0.25), ("m", 0.5), ("top", 0.99)):
        assert abs(np.mean(values <= got[name]) - p) < 0.03
