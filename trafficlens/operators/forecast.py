"""Boosted-tree forecasts on feature tables with Spark ML."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import partial

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import DataFrame, functions as F

from trafficlens import fixed_values as V
from trafficlens.functions import scaling
from trafficlens.operators import folds, metrics
from trafficlens.session import Scratch, side_by_side, written

LABELS = ("split", "freq", "series", "timestamp", "rn", "n", "fold", "is_test")


@dataclass(frozen=True)
class Budget:
    """Rounds, learning rate and depth; ``log_target`` fits ln(1 + y). Rounds end
    ``patience`` rounds after the one with the least error on the validation rows."""

    rounds: int = V.LOG_TARGET_TREES["rounds"]
    rate: float = V.LOG_TARGET_TREES["rate"]
    depth: int = V.LOG_TARGET_TREES["depth"]
    log_target: bool = True
    name: str = "GBT_log"
    patience: int = V.LOG_TARGET_TREES["patience"]


RAW_BUDGET = Budget(
    V.RAW_TARGET_TREES["rounds"], V.RAW_TARGET_TREES["rate"], V.RAW_TARGET_TREES["depth"],
    log_target=False, name="GBT_raw", patience=V.RAW_TARGET_TREES["patience"],
)


def all_features(table: DataFrame) -> list[str]:
    """Every column but labels and both next-step targets."""
    return [c for c in table.columns if c not in LABELS and c not in V.TARGETS]


def short_features(table: DataFrame) -> list[str]:
    return [c for c in V.SHORT_FEATURE_LIST if c in table.columns]


def can_be_missing(column: str) -> bool:
    return any(mark in column for mark in ("_lag", "_rmean", "_rstd", "_vel", "_acc", "rolling"))


def with_inputs(table: DataFrame, features) -> DataFrame:
    """Features as doubles plus a 0/1 column for each that may be missing."""
    marks = {f"{c}_missing": F.col(c).isNull().cast("double") for c in features if can_be_missing(c)}
    return table.withColumns({c: F.col(c).cast("double") for c in features} | marks)


def input_stages(features) -> Pipeline:
    """Missing history takes the training mean, the 0/1 columns keep the fact."""
    gappy = [c for c in features if can_be_missing(c)]
    filled = [f"{c}_filled" for c in gappy]
    inputs = [c for c in features if c not in gappy] + filled + [f"{c}_missing" for c in gappy]
    stages = [Imputer(inputCols=gappy, outputCols=filled)] if gappy else []
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return Pipeline(stages=stages)


def best_round(errors, patience: int) -> tuple[int, bool]:
    """The round with the least error before ``patience`` rounds brought nothing better,
    counted from 1, and whether the rounds ended that way."""
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        if i - best >= patience:
            return best + 1, True
    return best + 1, False


#: Rounds after which predictions are stored and the validation errors read.
STORED_ROUNDS = 10


def _ensemble(spark, base, trees, rate: float) -> GBTRegressionModel:
    """One model of a constant and the shrunk trees."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    found = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees) + 1)
    weights = gateway.new_array(jvm.double, len(trees) + 1)
    found[0], weights[0] = base._java_obj, 1.0
    for i, tree in enumerate(trees, 1):
        found[i], weights[i] = tree._java_obj, rate
    uid = f"GBTRegressor_{uuid.uuid4().hex[:12]}"
    return GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(uid, found, weights))


def grow(rows: DataFrame, budget: Budget) -> GBTRegressionModel:
    """Trees up to the best round, over ``features``, ``label`` and ``is_test``.

    Boosting that continues, from the training rows' mean: each round fits one tree to
    what the mean and the trees before it leave over. Their sums are stored every few
    rounds, so no round reads all earlier trees; in the same pass the errors of these
    rounds on the validation rows are read. Rounds end when the patience is used up, and
    the trees up to the best round are kept as they are, nothing is fitted twice. Without
    validation rows all rounds are made.
    """
    def fit(frame: DataFrame, label, depth: int, name: str):
        train = frame.where(~F.col("is_test")).select("features", label.alias("_left"))
        return DecisionTreeRegressor(
            labelCol="_left", predictionCol=name, maxDepth=depth, seed=V.SAMPLE_SEED).fit(train)

    base = fit(rows, F.col("label"), 0, "_total")
    state = base.transform(rows.select("features", "label", "is_test"))
    trees, errors, done, scratch = [], [], False, Scratch()
    while not done and len(trees) < budget.rounds:
        grown, names = state, []
        for _ in range(min(STORED_ROUNDS, budget.rounds - len(trees))):
            names.append(f"_tree{len(names)}")
            trees.append(fit(grown, F.col("label") - F.col("_total"), budget.depth, names[-1]))
            grown = trees[-1].transform(grown).withColumn(names[-1], F.col(names[-1]) * budget.rate)
            grown = grown.withColumn("_total", F.col("_total") + F.col(names[-1]))
        before, scratch = scratch, Scratch()
        stored = scratch.written(grown, "boosting")
        before.clear()
        # The sums after each of these rounds, from the last one backwards.
        sums = [F.col("_total")]
        for name in names[:0:-1]:
            sums.insert(0, sums[0] - F.col(name))
        found = stored.where("is_test").agg(*[F.avg(F.pow(F.col("label") - c, 2)).alias(n) for c, n in zip(sums, names)]).first()
        if found[0] is not None:
            errors += found
            done = best_round(errors, budget.patience)[1]
        state = stored.drop(*names)
    scratch.clear()
    kept = best_round(errors, budget.patience)[0] if errors else len(trees)
    return _ensemble(rows.sparkSession, base, trees[:kept], budget.rate)


def fit_fold(table: DataFrame, target: str, features, fold: int, budget: Budget) -> PipelineModel:
    """Fit on the rows before a fold; the fold itself only decides when to stop."""
    y = F.col(target).cast("double")
    rows = folds.fold_rows(table, fold).where(y.isNotNull())
    rows = with_inputs(rows, features).withColumn("label", scaling.to_log(y) if budget.log_target else y)
    inputs = input_stages(features).fit(rows.where(~F.col("is_test")))
    # Every round reads the rows again.
    scratch = Scratch()
    rows = scratch.written(inputs.transform(rows).select("features", "label", "is_test"), "inputs")
    trees = grow(rows, budget)
    scratch.clear()
    return PipelineModel([*inputs.stages, trees])


def forecast(model: PipelineModel, table: DataFrame, target: str, features, budget: Budget) -> DataFrame:
    """Labels, ``actual`` and ``predicted`` of every row, on the target's own scale."""
    scored = model.transform(with_inputs(table, features))
    predicted = F.col("prediction")
    kept = [c for c in ("series", "split", "freq", "fold", "timestamp") if c in table.columns]
    return scored.select(
        *kept, F.col(target).cast("double").alias("actual"),
        (scaling.from_log(predicted) if budget.log_target else predicted).alias("predicted"),
    )


def fold_scores(table: DataFrame, target: str, features, budget: Budget, n: int = V.FOLDS, keys=()):
    """Fit every fold and score its test rows; also the model of the last fold.

    The folds are fitted side by side from one stored table. With ``keys`` the folds are
    those of each series.
    """
    numbered = written(folds.add_fold(table, n, keys), "folded")
    models = side_by_side({
        fold: partial(fit_fold, numbered, target, features, fold, budget) for fold in range(n)})
    for model in models.values():
        if isinstance(model, Exception):
            raise model
    scores = [
        metrics.score(forecast(models[fold], numbered.where(F.col("fold") == fold), target, features, budget), "fold", masked=budget.log_target)
        for fold in range(n)]
    report = scores[0]
    for one in scores[1:]:
        report = report.unionByName(one)
    return report, models[n - 1]


def hold_out_forecast(table: DataFrame, target: str, features, cut: str, budget: Budget, keys=()):
    """Forecast the rows from the cut on with the model of the last fold before it."""
    train, valid = folds.hold_out(table, cut)
    model = fit_fold(folds.add_fold(train, keys=keys), target, features, V.FOLDS - 1, budget)
    return forecast(model, valid, target, features, budget), model


def with_errors(result: DataFrame, train: DataFrame, target: str, masked: bool = True) -> DataFrame:
    """A forecast with its errors and that of the training rows' mean in every row, and
    whether it beats that mean."""
    flat = train.agg(F.avg(F.col(target).cast("double")).alias("_mean"))
    off = F.col("actual") - F.col("_mean")
    base = result.crossJoin(F.broadcast(flat)).agg(F.sqrt(F.avg(off * off)).alias("mean_RMSE"))
    errors = metrics.score(result, masked=masked).crossJoin(F.broadcast(base))
    return result.crossJoin(F.broadcast(errors)).withColumn("beats_mean", F.col("RMSE") < F.col("mean_RMSE"))


def metric_row(result: DataFrame, target: str, freq: str, budget: Budget) -> DataFrame:
    """One line of the report."""
    return metrics.score(result, masked=budget.log_target).select(
        F.lit(budget.name).alias("Model_Type"), F.lit(target).alias("Target"),
        F.lit(freq).alias("Timeframe"), "RMSE", "MSE", "MAE", "MAPE",
    )
