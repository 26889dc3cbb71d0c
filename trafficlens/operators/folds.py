"""Time-ordered splits of a feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trafficlens import fixed_values as V
from trafficlens.operators.series import numbered_by_time


def hold_out(df: DataFrame, cut: str = V.HOLD_OUT_DATE) -> tuple[DataFrame, DataFrame]:
    """Rows before the cut for training, the rest for validation."""
    at = F.lit(cut).cast("timestamp_ntz")
    return df.where(F.col("timestamp") < at), df.where(F.col("timestamp") >= at)


def add_fold(df: DataFrame, folds: int = V.FOLDS, keys=()) -> DataFrame:
    """The fold that tests a row: 0..folds-1, or -1 for the first rows, which only train.

    Every fold tests n // (folds + 1) rows and trains on all rows before them.
    """
    numbered = numbered_by_time(df, list(keys))
    size = F.floor(F.col("n") / (folds + 1))
    first = F.col("n") - folds * size
    fold = F.when(F.col("rn") >= first, F.floor((F.col("rn") - first) / size)).otherwise(F.lit(-1))
    return numbered.withColumn("fold", fold.cast("int"))


def fold_rows(df: DataFrame, fold: int) -> DataFrame:
    """Training and test rows of one fold, told apart by ``is_test``."""
    return df.where(F.col("fold") <= fold).withColumn("is_test", F.col("fold") == fold)
