"""Text to feature tables to forecasts, and some registered queries."""

import threading
from functools import partial

import duckdb
import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
from queries import base as B
from trafficlens import fixed_values as V
from trafficlens.operators import folds, forecast
from trafficlens.plans import traffic, training
from trafficlens.session import side_by_side

SF = "/root/testdata/sf0.001"
SMALL = forecast.Budget(rounds=6, rate=0.3, depth=2, name="small")


@pytest.fixture(scope="module")
def feature_path(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("plan")
    for split in ("train", "test"):
        B.lines(spark, SF).where(F.col("split") == split).select("value").write.text(str(folder / split))
    made = traffic.traffic_features(spark, str(folder / "train"), str(folder / "test"), str(folder / "out"), ("5m", "15m"))
    assert set(made) == {"5m", "15m"}
    return str(folder / "out")


def test_feature_tables_on_disk(spark, feature_path):
    from trafficlens.sources.tables import read_table
    table = read_table(spark, feature_path, "15m", "train")
    assert len(table.columns) == 94 + 2 and table.where("split <> 'train'").count() == 0
    direct = B.ml(spark, SF, "15m").where("split = 'train'")
    assert table.count() == direct.count()
    both = [df.agg(F.sum("y_req_t1"), F.round(F.sum("y_bytes_imp_rmean12"), 6)).first() for df in (table, direct)]
    assert both[0] == both[1]


def test_training_grid(spark, feature_path, tmp_path):
    report = training.train_grid(
        spark, feature_path, str(tmp_path / "out"), "2024-01-17 00:00:00", ("15m", "1m"), budget=SMALL,
    ).collect()
    # The one-minute table does not exist: its cells are left out.
    assert [(r.Target, r.Timeframe) for r in report] == [(t, "15m") for t in V.TARGETS]
    assert all(r.RMSE >= 0 and r.RMSE == pytest.approx(r.MSE ** 0.5) for r in report)
    model = PipelineModel.load(str(tmp_path / "out/models/small_y_req_t1_15m"))
    assert model.stages[-1].getNumTrees <= 7
    back = spark.read.option("header", True).csv(str(tmp_path / "out/forecasts/small_y_req_t1_15m"))
    assert {"timestamp", "actual", "predicted"} <= set(back.columns) and back.where("cast(predicted as double) < 0").count() == 0
    with pytest.raises(RuntimeError):
        training.train_grid(spark, feature_path, freqs=("1m",), budget=SMALL)


def test_features_hold_no_target(spark, feature_path):
    from trafficlens.sources.tables import read_table
    table = read_table(spark, feature_path, "15m")
    chosen = forecast.all_features(table)
    assert not set(chosen) & {*V.TARGETS, "timestamp", "split", "freq"} and len(chosen) == 91
    assert forecast.short_features(table) == V.SHORT_FEATURE_LIST


def test_trees_grow_past_the_first_and_beat_the_mean(spark):
    """A slow wave: one tree cannot follow it."""
    rows = spark.range(400).select(
        F.timestamp_add("MINUTE", F.col("id").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("timestamp"),
        F.when(F.col("id") % 10 > 0, F.sin(F.col("id") / 9)).alias("y_req_lag1"), (F.col("id") % 7).cast("double").alias("hour"),
        (50 + 40 * F.sin(F.col("id") / 9) + 3 * (F.col("id") % 7)).alias("y_req_t1"))
    budget = forecast.Budget(rounds=30, rate=0.2, depth=3, patience=5)
    numbered = folds.add_fold(rows)
    model = forecast.fit_fold(numbered, "y_req_t1", ["y_req_lag1", "hour"], V.FOLDS - 1, budget)
    assert 1 < model.stages[-1].getNumTrees <= 30
    test = forecast.forecast(model, numbered.where(F.col("fold") == V.FOLDS - 1), "y_req_t1", ["y_req_lag1", "hour"], budget)
    mean = numbered.where(F.col("fold") < V.FOLDS - 1).agg(F.avg("y_req_t1")).first()[0]
    ours, flat = test.agg(F.avg(F.pow(F.col("actual") - F.col("predicted"), 2)), F.avg(F.pow(F.col("actual") - mean, 2))).first()
    assert ours < 0.5 * flat
    # The imputer has seen the training rows only.
    want = numbered.where(F.col("fold") < V.FOLDS - 1).agg(F.avg("y_req_lag1")).first()[0]
    assert model.stages[0].surrogateDF.first()[0] == pytest.approx(want)


def test_rounds_continue_without_a_second_fit(spark, monkeypatch):
    """The model is the mean and shrunk trees, each fitted once to what was left over."""
    monkeypatch.setattr(forecast, "STORED_ROUNDS", 3)
    rows = spark.range(60).select(
        F.col("id").cast("double").alias("x"), (F.col("id") % 5 * 10 + F.col("id") / 7).alias("label"), (F.col("id") % 4 == 3).alias("is_test"))
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows).cache()
    fits = []
    real = forecast.DecisionTreeRegressor.fit
    monkeypatch.setattr(forecast.DecisionTreeRegressor, "fit", lambda self, data: fits.append(data.collect()) or real(self, data))
    budget = forecast.Budget(rounds=40, rate=0.3, depth=2, patience=4)
    model = forecast.grow(rows, budget)
    # By hand: the sums after every round, from the model's own trees.
    errors, trees, total = [], model.trees, None
    frame = rows.select("features", "label", "is_test").collect()
    assert model.treeWeights == [1.0] + [0.3] * (len(trees) - 1) and trees[0].depth == 0
    total = [trees[0].predict(r.features) for r in frame]
    mean = np.mean([r.label for r in frame if not r.is_test])
    assert total[0] == pytest.approx(mean)
    for i, tree in enumerate(trees[1:], 1):
        assert sorted(r._left for r in fits[i]) == pytest.approx(sorted(r.label - t for r, t in zip(frame, total) if not r.is_test))
        total = [t + 0.3 * tree.predict(r.features) for r, t in zip(frame, total)]
        errors.append(np.mean([(r.label - t) ** 2 for r, t in zip(frame, total) if r.is_test]))
    assert [model.predict(r.features) for r in frame] == pytest.approx(total)
    assert errors[-1] == min(errors)
    # One fit for the mean and one a round, in steps of three.
    assert len(trees) - 1 + 4 <= len(fits) - 1 <= len(trees) - 1 + 4 + 2 or len(fits) == 41


def test_without_validation_rows_all_rounds_are_made(spark):
    rows = spark.range(30).select(F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("label"), F.lit(False).alias("is_test"))
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    assert forecast.grow(rows, forecast.Budget(rounds=7, depth=1, patience=1)).getNumTrees == 8


def test_a_failing_cell_is_left_out(spark, feature_path, monkeypatch, caplog):
    real = forecast.hold_out_forecast

    def some(table, target, *rest):
        if target == V.TARGETS[0]:
            raise ValueError("cannot fit this one")
        return real(table, target, *rest)

    monkeypatch.setattr(forecast, "hold_out_forecast", some)
    report = training.train_grid(spark, feature_path, cut="2024-01-17 00:00:00", freqs=("15m",), budget=SMALL).collect()
    assert [r.Target for r in report] == list(V.TARGETS[1:]) and "cannot fit this one" in caplog.text


def test_side_by_side(spark):
    meet = threading.Barrier(3, timeout=60)

    def job(i):
        meet.wait()  # all three at once
        assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") == str(i)
        return spark.range(i).count()

    def bad():
        raise KeyError("x")

    assert side_by_side({i: partial(job, i) for i in (1, 2, 3)}) == {1: 1, 2: 2, 3: 3}
    got = side_by_side({"a": bad, "b": lambda: 1})
    assert isinstance(got["a"], KeyError) and got["b"] == 1
    assert side_by_side({}) == {}


def test_errors_beside_the_mean(spark):
    result = spark.createDataFrame([(1.0, 2.0), (5.0, 5.0)], "actual double, predicted double")
    train = spark.createDataFrame([(2.0,), (4.0,), (None,)], "y double")
    row = forecast.with_errors(result, train, "y").first()
    assert (row.RMSE, row.mean_RMSE, row.beats_mean) == (pytest.approx(0.5 ** 0.5), 2.0, True)


def test_patience():
    assert forecast.best_round([5, 4, 3, 4, 4, 2], 2) == (3, True)
    assert forecast.best_round([5, 4, 3, 4, 2], 2) == (5, False)
    assert forecast.best_round([5], 2) == (1, False)


NAMES = [
    "p1_parse_lines", "f10_directory_and_resource", "f20_bytes_imputed", "d13_table_5m", "t6_next_targets",
    "t17_expanding_folds", "d18_outlier_fence", "d22_row_correlations", "j5_top_membership", "s10_dense_index",
    "c3_decisions", "x1_live_traffic",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    check.views(con, SF)
    good, message = check.compare(spark, con, name, SF)
    assert good, message


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
