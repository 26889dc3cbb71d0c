"""Forecast models, their errors, and capacity decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import base as B
from queries.base import query
from trafficlens import fixed_values as V
from trafficlens.operators import capacity as C, combine, folds, forecast, metrics
from trafficlens.plans import capacity as capacity_plan, training
from trafficlens.session import written

# The driver tables cover January 2024, train rows end at 2024-01-21. The hold-out forecast
# (m6) has the library's whole budget, 1000 rounds that end 50 after the best; the others
# end after 20 rounds, as they show one part of it each.
CUT = "2024-01-17 00:00:00"
LOG_BUDGET = forecast.Budget(rounds=20, rate=0.15, depth=4)
RAW_BUDGET = forecast.Budget(rounds=20, rate=0.15, depth=4, log_target=False, name="GBT_raw")


def _train(spark, d, freq="15m"):
    return written(B.ml(spark, d, freq).where(F.col("split") == "train"), "features")


_MISSING = ["y_req_lag1", "y_req_rmean12", "y_req_rstd12", "y_req_acc", "error_rate_lag3"]


@query("m1_all_features", "split:s features:l n:l error_rate:d " + " ".join(f"{c}_missing:d" for c in _MISSING),
       (B.ml_sql(), "SELECT split, 91 AS features, count(*) AS n, sum(error_rate) AS error_rate, "
        + ", ".join(f"sum(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS {c}_missing" for c in _MISSING)
        + " FROM ml GROUP BY split"))
def _(spark, d):
    table = B.ml(spark, d)
    chosen = forecast.all_features(table)
    return forecast.with_inputs(table, chosen).groupBy("split").agg(
        F.lit(len(chosen)).alias("features"), F.count("*").alias("n"), F.sum("error_rate").alias("error_rate"),
        *(F.sum(f"{c}_missing").alias(f"{c}_missing") for c in _MISSING),
    )


@query("m2_short_features", "split:s timestamp:t " + " ".join(f"{c}:d" for c in V.SHORT_FEATURE_LIST),
       (B.ml_sql(columns=("y_req",)), "SELECT * FROM ml"))
def _(spark, d):
    table = B.ml(spark, d)
    return forecast.with_inputs(table, forecast.short_features(table))


# A forecast is usable if it is there, finite and not negative; it is sound if its error
# is at most a quarter above that of the training rows' mean, which the driver tables, being
# drawn by chance, leave little room to beat. SQL knows both must hold.
FORECAST = "split:s timestamp:t actual:d usable:b sound:b"
_TRAIN = B.ml_sql() + """, train AS (SELECT *, row_number() OVER (ORDER BY "timestamp") - 1 AS rn, count(*) OVER () AS n
  FROM ml WHERE split = 'train')"""
_LAST = (_TRAIN, "SELECT *, y_req_t1 AS actual, true AS usable, true AS sound FROM train WHERE rn >= n - n // 6")


def _checked(result, train, target, budget):
    p = F.col("predicted")
    result = forecast.with_errors(result, train, target, budget.log_target)
    return result.withColumn("usable", F.coalesce((p >= 0) & (p < float("inf")), F.lit(False))).withColumn(
        "sound", F.col("RMSE") <= 1.25 * F.col("mean_RMSE"))


def _last_fold(spark, d, target, budget, short):
    table = written(folds.add_fold(_train(spark, d)), "folded")
    chosen = forecast.short_features(table) if short else forecast.all_features(table)
    model = forecast.fit_fold(table, target, chosen, V.FOLDS - 1, budget)
    test = table.where(F.col("fold") == V.FOLDS - 1)
    train = table.where(F.col("fold") < V.FOLDS - 1)
    return _checked(forecast.forecast(model, test, target, chosen, budget), train, target, budget)


@query("m3_trees_on_log_target", FORECAST, _LAST)
def _(spark, d):
    return _last_fold(spark, d, "y_req_t1", LOG_BUDGET, False)


@query("m4_trees_on_raw_target", FORECAST, _LAST)
def _(spark, d):
    return _last_fold(spark, d, "y_req_t1", RAW_BUDGET, True)


@query("m5_fold_scores", "fold:i scored:b sound:b",
       (_TRAIN, "SELECT DISTINCT CAST((rn - (n - 5 * (n // 6))) // (n // 6) AS INTEGER) AS fold, true AS scored, true AS sound FROM train WHERE rn >= n - 5 * (n // 6)"))
def _(spark, d):
    table = _train(spark, d)
    report, _model = forecast.fold_scores(table, "y_req_t1", forecast.short_features(table), RAW_BUDGET)
    # The spread of each fold's own rows is the least error of any constant.
    spread = folds.add_fold(table).groupBy("fold").agg(F.stddev_pop("y_req_t1").alias("spread"))
    return report.join(spread, "fold").withColumns({
        "scored": (F.col("RMSE") > 0) & (F.abs(F.col("RMSE") * F.col("RMSE") / F.col("MSE") - 1) < 1e-9),
        "sound": F.col("RMSE") <= 1.5 * F.col("spread")})


def _hold_out(spark, d):
    """The whole budget: all features, a thousand rounds at most."""
    table, target, budget = _train(spark, d), "y_bytes_imp_t1", forecast.Budget()
    result, model = forecast.hold_out_forecast(table, target, forecast.all_features(table), CUT, budget)
    return _checked(written(result, "forecast"), folds.hold_out(table, CUT)[0], target, budget), model


@query("m6_hold_out_forecast", FORECAST,
       (B.ml_sql(), f"SELECT *, y_bytes_imp_t1 AS actual, true AS usable, true AS sound FROM ml WHERE split = 'train' AND \"timestamp\" >= TIMESTAMP '{CUT}'"))
def _(spark, d):
    return _hold_out(spark, d)[0]


@query("m6_forecast_values", "split:s timestamp:t actual:d predicted:d RMSE:d MAE:d MAPE:d mean_RMSE:d beats_mean:b trees:l")
def _(spark, d):
    result, model = _hold_out(spark, d)
    return result.withColumn("trees", F.lit(model.stages[-1].getNumTrees))


REPORT = "Model_Type:s Target:s Timeframe:s RMSE:d MSE:d MAE:d MAPE:d"


@query("m7_model_grid", "Model_Type:s Target:s Timeframe:s scored:b",
       ("", "SELECT 'GBT_log' AS \"Model_Type\", t AS \"Target\", f AS \"Timeframe\", count(*) > 0 AS scored FROM events, "
        + f"(SELECT unnest({list(V.TARGETS)!r}) AS t), (SELECT unnest({list(V.FREQ_MINUTES)!r}) AS f) GROUP BY ALL"))
def _(spark, d):
    def read(spark_, path, freq, split):
        return written(B.ml(spark_, path, freq).where(F.col("split") == split), "features")

    report = training.train_grid(spark, d, cut=CUT, budget=LOG_BUDGET, read=read)
    return report.withColumn("scored", F.col("RMSE") > 0)


_PAIRS = B.prepared_sql() + """, pairs AS (SELECT split, CAST(y_req_t1 AS DOUBLE) AS actual, CAST(y_req AS DOUBLE) AS predicted
  FROM prepared WHERE flag_data_gap = 0 AND y_req_t1 IS NOT NULL)"""
_ERRORS = ("sqrt(avg((actual - predicted) ** 2)) AS \"RMSE\", avg((actual - predicted) ** 2) AS \"MSE\", "
           "avg(abs(actual - predicted)) AS \"MAE\"")
_MASKED = "coalesce(avg(CASE WHEN actual > 1 THEN abs((actual - predicted) / actual) END), 0) AS \"MAPE\""


@query("d30_errors", "split:s RMSE:d MSE:d MAE:d", (_PAIRS, f"SELECT split, {_ERRORS} FROM pairs GROUP BY split"))
def _(spark, d):
    return metrics.score(B.split_forecasts(spark, d), "split")


@query("d31_masked_mape", "split:s MAPE:d", (_PAIRS, f"SELECT split, {_MASKED} FROM pairs GROUP BY split"))
def _(spark, d):
    return metrics.score(B.split_forecasts(spark, d), "split")


@query("d32_mape", "split:s mape_above_zero:d huge:b",
       (_PAIRS, "SELECT split, avg(abs(actual - predicted) / greatest(abs(actual), 2.220446049250313e-16)) FILTER (actual > 0) AS mape_above_zero, "
        "avg(abs(actual - predicted) / greatest(abs(actual), 2.220446049250313e-16)) > 1e12 AS huge FROM pairs GROUP BY split"))
def _(spark, d):
    pairs = B.split_forecasts(spark, d)
    above = metrics.score(pairs.where(F.col("actual") > 0), "split", masked=False)
    every = metrics.score(pairs, "split", masked=False).select("split", (F.col("MAPE") > 1e12).alias("huge"))
    return above.withColumnRenamed("MAPE", "mape_above_zero").join(every, "split")


@query("u2_metric_report", REPORT,
       (_PAIRS, " UNION ALL ".join(
           f"SELECT 'last_value' AS \"Model_Type\", 'y_req_t1' AS \"Target\", '{split}' AS \"Timeframe\", {_ERRORS}, {_MASKED} FROM pairs WHERE split = '{split}'"
           for split in ("train", "test"))))
def _(spark, d):
    pairs = B.split_forecasts(spark, d)
    budget = forecast.Budget(name="last_value")
    return combine.metric_report([
        forecast.metric_row(pairs.where(F.col("split") == split), "y_req_t1", split, budget)
        for split in ("train", "test")
    ])


# --- capacity ---------------------------------------------------------------

@query("c1_unit_capacity", "series:s cap_req:l cap_bytes:l", (B.CAPACITY, "SELECT * FROM caps"))
def _(spark, d):
    return C.unit_capacity(B.joined_forecasts(spark, d))


@query("d28_peak_load", "series:s peak_req:d peak_bytes:d cap_req:l cap_bytes:l",
       (B.CAPACITY, "SELECT series, max(actual_req) AS peak_req, max(actual_bytes) AS peak_bytes, any_value(cap_req) AS cap_req, "
        "any_value(cap_bytes) AS cap_bytes FROM stepped GROUP BY series"))
def _(spark, d):
    joined = B.joined_forecasts(spark, d)
    peaks = joined.groupBy("series").agg(
        F.max("actual_req").alias("peak_req"), F.max("actual_bytes").alias("peak_bytes")
    )
    return peaks.join(C.unit_capacity(joined), "series")


@query("c2_server_needs", "series:s timestamp:t step:l need:l stable_need:d", (B.CAPACITY, "SELECT * FROM needs"))
def _(spark, d):
    joined = B.joined_forecasts(spark, d)
    return C.server_needs(joined, C.unit_capacity(joined))


@query("c3_decisions", "series:s timestamp:t step:l servers:l", (B.DECISIONS, "SELECT * FROM decided"))
def _(spark, d):
    return capacity_plan.decisions(*B.service_forecasts(spark, d), step="15 minutes")


@query("c4_overloads", "series:s step:l actual_req:d servers:l overload:b", (B.DECISIONS, "SELECT * FROM decided"))
def _(spark, d):
    return capacity_plan.decisions(*B.service_forecasts(spark, d), step="15 minutes")


COSTS = "series:s minutes:l max_servers:l cost:l fixed_cost:l saving:l saving_percent:d overload_minutes:l stability_percent:d"


def _costs_sql(freq):
    return (B.decisions_sql(freq) + """, sums AS (SELECT series, count(*) AS minutes, max(servers) AS max_servers,
          sum(servers) * 100 + count(*) FILTER (overload) * 1000 AS cost, count(*) * max(servers) * 100 AS fixed_cost,
          count(*) FILTER (overload) AS overload_minutes FROM decided GROUP BY series)""",
        "SELECT *, fixed_cost - cost AS saving, (fixed_cost - cost) / fixed_cost * 100 AS saving_percent, "
        "(1 - overload_minutes / minutes) * 100 AS stability_percent FROM sums")


# Costs are per minute, so the report by 15 minutes counts steps; the queries by the
# minute bill what the rates mean.
@query("d29_cost_report", COSTS, _costs_sql("15m"))
def _(spark, d):
    return capacity_plan.report(*B.service_forecasts(spark, d), step="15 minutes")


@query("c2_needs_by_minute", "series:s timestamp:t step:l need:l stable_need:d", (B.capacity_sql("1m"), "SELECT * FROM needs"))
def _(spark, d):
    joined = written(B.joined_forecasts(spark, d, "1m"), "forecasts")
    return C.server_needs(joined, C.unit_capacity(joined))


@query("c4_overloads_by_minute", "series:s timestamp:t actual_req:d servers:l overload:b", (B.decisions_sql("1m"), "SELECT * FROM decided"))
def _(spark, d):
    return capacity_plan.decisions(*B.service_forecasts(spark, d, "1m"))


@query("d29_cost_by_minute", COSTS, _costs_sql("1m"))
def _(spark, d):
    return capacity_plan.report(*B.service_forecasts(spark, d, "1m"))
