"""Forecast errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trafficlens import fixed_values as V


def _error() -> Column:
    return F.col("actual") - F.col("predicted")


def mean_errors() -> list[Column]:
    mse = F.avg(_error() * _error())
    return [F.sqrt(mse).alias("RMSE"), mse.alias("MSE"), F.avg(F.abs(_error())).alias("MAE")]


def mape_above_one() -> Column:
    """Mean relative error over the rows whose actual value exceeds 1; 0 if none does."""
    actual = F.col("actual")
    return F.coalesce(F.avg(F.when(actual > 1, F.abs(_error() / actual))), F.lit(0.0)).alias("MAPE")


def mape() -> Column:
    """Mean relative error over all rows, the divisor kept above machine epsilon."""
    divisor = F.greatest(F.abs("actual"), F.lit(V.MACHINE_EPSILON))
    return F.avg(F.abs(_error()) / divisor).alias("MAPE")


def score(forecasts: DataFrame, *keys: str, masked: bool = True) -> DataFrame:
    """RMSE, MSE, MAE and MAPE of ``actual`` against ``predicted``, in one pass."""
    return forecasts.groupBy(*keys).agg(*mean_errors(), mape_above_one() if masked else mape())
