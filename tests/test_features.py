"""Feature tables: history, targets, gaps, block windows, folds."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W, functions as F

from trafficlens import fixed_values as V
from trafficlens.operators import features, folds, series as S


def traffic(spark, n, gaps, freq="1m", seed=0, split="train"):
    rng = np.random.default_rng(seed)
    times = pd.date_range("2024-01-01", periods=n, freq=freq.replace("m", "min"))
    empty = rng.random(n) < gaps
    empty[[0, -1]] = False
    data = {"split": split, "timestamp": times, "y_req": np.where(empty, 0, rng.integers(1, 9, n))}
    doubles = [c for c in V.FEATURE_COLUMNS if c.endswith(("_rate", "_share", "_entropy")) or c == "y_bytes_imp"]
    for c in doubles:
        data[c] = np.where(empty, 0.0, rng.random(n).round(3))
    for c in ("bytes_all_missing", "country_nunique", "dir_nunique", "method_nunique"):
        data[c] = np.where(empty, 0, rng.integers(0, 2, n))
    data |= {"hour": times.hour, "weekday": times.weekday, "is_weekend": (times.weekday >= 5).astype(int)}
    data["avg_path_depth"] = [None if e else float(v) for e, v in zip(empty, rng.integers(1, 4, n))]
    frame = pd.DataFrame(data)
    kinds = {"split": "string", "timestamp": "string", "y_req": "long"}
    schema = ", ".join(f"{c} {kinds.get(c, 'double' if c in doubles or c == 'avg_path_depth' else 'int')}" for c in frame.columns)
    plain = [[str(v) if c == "timestamp" else v for c, v in zip(frame.columns, row)]
             for row in zip(*(frame[c].tolist() if c != "avg_path_depth" else data[c] for c in frame.columns))]
    df = spark.createDataFrame(plain, schema).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    return df, frame.assign(gap=empty)


@pytest.mark.parametrize("freq,columns", [("1m", 106), ("5m", 100), ("15m", 94)])
def test_feature_table_columns(spark, freq, columns):
    df, frame = traffic(spark, 120, 0.3, freq)
    made = features.feature_table(df, freq)
    assert len(made.columns) - 1 == columns
    assert made.columns[1:28] == V.FEATURE_COLUMNS and made.columns[28] == "avg_payload"
    assert made.count() == int((~frame.gap).sum()) - 1
    whole = features.feature_table(df, freq, complete=True)
    assert "bytes_missing_rate" not in whole.columns and 0 < whole.count() < made.count()


def test_history_by_hand(spark):
    """Requests 4, 6, gap, 1, 9, 5 per minute; history leaves gaps out."""
    df, _ = traffic(spark, 6, 0.0)
    counts = F.element_at(F.array(*map(F.lit, (4, 6, 0, 1, 9, 5))), F.minute("timestamp") + 1)
    gap = F.minute("timestamp") == 2
    df = df.withColumns({"y_req": counts.cast("long"), "avg_path_depth": F.when(~gap, F.col("avg_path_depth"))})
    got = {r.timestamp.minute: r for r in features.feature_table(df, "1m").collect()}
    assert sorted(got) == [0, 1, 3, 4]                       # no gap, and no target for the last
    assert [got[m].y_req_t1 for m in (0, 1, 3, 4)] == [6, 0, 9, 5]
    assert [got[m].y_req_lag1 for m in (0, 1, 3, 4)] == [None, 4, None, 1]
    assert got[4].y_req_lag2 is None and got[4].y_req_lag3 == 6
    assert got[3].y_req_rmean5 == 5 and got[3].y_req_rstd5 == pytest.approx(2 ** 0.5)
    assert got[4].y_req_rmean5 == pytest.approx(11 / 3) and got[1].y_req_rstd5 is None
    assert got[4].y_req_vel is None and got[1].y_req_vel is None


@pytest.mark.parametrize("block", [30, 64, 1000])
def test_blocks_equal_one_window(spark, block):
    df, _ = traffic(spark, 500, 0.4, seed=3)
    df = df.unionByName(traffic(spark, 150, 0.2, seed=4, split="test")[0])

    def columns(frame):
        return {
            "m": F.avg("y_req").over(S.before(30, frame)), "s": F.stddev_samp("y_bytes_imp").over(S.before(5, frame)),
            "l": S.lag("y_req", 15, frame), "t": S.lead("y_req", 1, frame),
            "r": F.count(F.lit(1)).over(S.trailing(5, frame)),
        }

    blocked = S.over_blocks(df, features.place("1m"), ("split",), 30, 1, columns, block)
    whole = df.withColumns(columns(W.partitionBy("split").orderBy("timestamp")))
    names = ["split", "timestamp", "m", "s", "l", "t"]
    assert sorted(map(tuple, blocked.select(names).collect()), key=str) == sorted(map(tuple, whole.select(names).collect()), key=str)
    with pytest.raises(ValueError):
        S.over_blocks(df, features.place("1m"), ("split",), 30, 1, columns, 20)


def test_target_before_a_gap_is_zero_and_kept(spark):
    df, _ = traffic(spark, 5, 0)
    df = df.withColumns({
        "avg_path_depth": F.when(F.minute("timestamp") != 2, F.col("avg_path_depth")),
        "y_req": F.when(F.minute("timestamp") != 2, F.col("y_req")).otherwise(F.lit(0)),
    })
    rows = {r.timestamp.minute: r for r in features.feature_table(df, "1m").collect()}
    assert sorted(rows) == [0, 1, 3] and rows[1].y_req_t1 == 0
    assert rows[3].y_req_lag1 is None and rows[3].y_req_rmean5 is not None


def test_no_look_ahead(spark):
    """Changing the last bucket changes no history of earlier rows."""
    df, _ = traffic(spark, 60, 0.2)
    last = df.agg(F.max("timestamp")).first()[0]
    bumped = df.withColumn("y_req", F.when(F.col("timestamp") == F.lit(last), 99).otherwise(F.col("y_req")))
    names = [c for c in features.feature_table(df, "5m").columns if "_lag" in c or "_r" in c and "_rate" not in c]
    both = [features.feature_table(x, "1m").select("timestamp", "y_req_lag1", "y_req_rmean30").collect() for x in (df, bumped)]
    assert names and sorted(both[0]) == sorted(both[1])


def test_short_history_needs_three_rows(spark):
    df, frame = traffic(spark, 30, 0)
    got = features.short_history(features.prepared(df), "1m").orderBy("timestamp").toPandas()
    want = frame.y_req.shift(1).rolling(3).mean()[3:]
    assert len(got) == 27
    np.testing.assert_allclose(got.y_req_rolling_mean_3, want)


def test_window_stage_has_one_exchange_and_no_single_partition(spark, tmp_path):
    df, _ = traffic(spark, 200, 0.3)
    df.write.parquet(str(tmp_path / "t"))
    plan = features.feature_table(spark.read.parquet(str(tmp_path / "t")), "1m")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in plan


def test_folds(spark):
    df = spark.range(20).select((F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int"))).alias("timestamp"))
    rows = {r.rn: r.fold for r in folds.add_fold(df).collect()}
    want = {rn: -1 if rn < 5 else (rn - 5) // 3 for rn in range(20)}
    assert rows == want
    part = folds.fold_rows(folds.add_fold(df), 1).groupBy("is_test").agg(F.min("rn"), F.max("rn")).collect()
    assert {r[0]: (r[1], r[2]) for r in part} == {False: (0, 7), True: (8, 10)}


def test_numbering_over_days(spark):
    rng = np.random.default_rng(5)
    minutes = rng.permutation(5000)[:700]
    df = spark.createDataFrame([(int(i % 2), int(m)) for i, m in enumerate(minutes)], "k int, m int").select(
        "k", F.timestamp_add("MINUTE", "m", F.lit("2024-01-01").cast("timestamp_ntz")).alias("timestamp"))
    got = S.numbered_by_time(df, ["k"]).withColumn("want", F.row_number().over(W.partitionBy("k").orderBy("timestamp")) - 1)
    assert got.where("rn <> want or n <> 350").count() == 0 and got.count() == 700


def test_hold_out(spark):
    df, _ = traffic(spark, 10, 0)
    train, valid = folds.hold_out(df, "2024-01-01 00:04:00")
    assert (train.count(), valid.count()) == (4, 6)
