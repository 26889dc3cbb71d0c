"""Traffic tables to forecasting features.

All functions work on gap-free tables (one row per bucket, empty ones included)
of one frequency. The order of the steps matters: next-step targets come from the
unmasked table, history comes from the masked one, gap rows leave at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from trafficlens import fixed_values as V
from trafficlens.functions import times
from trafficlens.operators import series as S


def place(freq: str) -> Column:
    """Number of the bucket on the grid."""
    return times.bucket_number(F.col("timestamp"), V.FREQ_MINUTES[freq])


def flag_gaps(df: DataFrame) -> DataFrame:
    """An empty bucket shows as a missing path depth."""
    return df.withColumn(V.GAP_FLAG, F.col("avg_path_depth").isNull().cast("byte"))


def fill_depth(df: DataFrame) -> DataFrame:
    return df.withColumn("avg_path_depth", F.coalesce("avg_path_depth", F.lit(0.0)))


def add_cyclical_time(df: DataFrame) -> DataFrame:
    sin_hour, cos_hour = times.cycle(F.col("hour"), 24)
    sin_day, cos_day = times.cycle(F.col("weekday"), 7)
    return df.withColumns({
        "sin_hour": sin_hour, "cos_hour": cos_hour,
        "sin_weekday": sin_day, "cos_weekday": cos_day,
    })


def payload() -> Column:
    return F.col("y_bytes_imp") / (F.col("y_req") + F.lit(V.PAYLOAD_EPSILON))


def add_payload(df: DataFrame) -> DataFrame:
    return df.withColumn("avg_payload", payload())


def mask_gaps(df: DataFrame, columns=tuple(V.HISTORY_COLUMNS)) -> DataFrame:
    """Null in gap rows, so that history skips them."""
    known = F.col(V.GAP_FLAG) == 0
    return df.withColumns({c: F.when(known, F.col(c)) for c in columns})


def target_columns(frame: WindowSpec) -> dict[str, Column]:
    return {
        "y_req_t1": S.lead("y_req", 1, frame),
        "y_bytes_imp_t1": S.lead("y_bytes_imp", 1, frame),
    }


def drop_without_target(df: DataFrame) -> DataFrame:
    """Only the last bucket has no next one."""
    return df.dropna(subset=V.TARGETS)


def add_targets(df: DataFrame, freq: str, keys=("split",)) -> DataFrame:
    """Requests and size of the next bucket, which may be an empty one."""
    return drop_without_target(S.over_blocks(df, place(freq), keys, 0, 1, target_columns))


def lag_columns(c: str, lags, frame: WindowSpec) -> dict[str, Column]:
    return {f"{c}_lag{n}": S.lag(c, n, frame) for n in lags}


def rolling_columns(c: str, windows, frame: WindowSpec) -> dict[str, Column]:
    """Mean and sample deviation of the rows before the current one. Nulls are
    skipped; a mean needs one value, a deviation two."""
    out = {}
    for rows in windows:
        out[f"{c}_rmean{rows}"] = F.avg(c).over(S.before(rows, frame))
        out[f"{c}_rstd{rows}"] = F.stddev_samp(c).over(S.before(rows, frame))
    return out


def change_columns(c: str, frame: WindowSpec) -> dict[str, Column]:
    """Change and change of change, both up to the previous row."""
    one, two, three = (S.lag(c, n, frame) for n in (1, 2, 3))
    return {f"{c}_vel": one - two, f"{c}_acc": (one - two) - (two - three)}


def history_columns(freq: str, frame: WindowSpec, columns=tuple(V.HISTORY_COLUMNS)) -> dict[str, Column]:
    out = {}
    for c in columns:
        out |= lag_columns(c, V.LAGS[freq], frame)
    for c in columns:
        out |= rolling_columns(c, V.WINDOWS[freq], frame)
    for c in columns:
        out |= change_columns(c, frame)
    return out


def reach(freq: str) -> int:
    return max(*V.LAGS[freq], *V.WINDOWS[freq])


def select_features(df: DataFrame, keys=("split",)) -> DataFrame:
    return df.select(*keys, *V.FEATURE_COLUMNS)


def prepared(table: DataFrame) -> DataFrame:
    """Gap flag, filled path depth and cyclical time."""
    return add_cyclical_time(fill_depth(flag_gaps(table)))


def sequence_table(table: DataFrame, freq: str, keys=("split",)) -> DataFrame:
    """The compact table for sequence models: gaps stay."""
    return add_payload(select_features(add_targets(prepared(table), freq, keys), keys))


def feature_table(table: DataFrame, freq: str, keys=("split",), complete: bool = False) -> DataFrame:
    """Targets, features and history of one frequency, in a single exchange.

    The unmasked requests and sizes travel beside the masked ones, so targets and
    history share one window. ``complete`` gives the variant without the
    missing-size rate and without rows that hold a null.
    """
    ready = add_payload(prepared(table))
    raw = {f"_{c}": F.col(c) for c in ("y_req", "y_bytes_imp")}
    masked = mask_gaps(ready.withColumns(raw))

    def columns(frame):
        targets = {
            "y_req_t1": S.lead("_y_req", 1, frame),
            "y_bytes_imp_t1": S.lead("_y_bytes_imp", 1, frame),
        }
        return targets | history_columns(freq, frame)

    full = S.over_blocks(masked, place(freq), keys, reach(freq), 1, columns)
    history = [
        c for c in full.columns
        if c.rsplit("_", 1)[-1].startswith(("lag", "rmean", "rstd", "vel", "acc"))
    ]
    kept = drop_without_target(full).where(F.col(V.GAP_FLAG) == 0)
    out = kept.select(*keys, *V.FEATURE_COLUMNS, "avg_payload", *history)
    return out.drop("bytes_missing_rate").dropna("any") if complete else out


def short_history(table: DataFrame, freq: str, target: str = "y_req", keys=("split",)) -> DataFrame:
    """The alternative last pass: three lags, a mean of three full values, complete rows."""
    def columns(frame):
        three = S.before(3, frame)
        out = {f"{target}_lag_{n}": S.lag(target, n, frame) for n in (1, 2, 3)}
        out[f"{target}_rolling_mean_3"] = F.when(
            F.count(target).over(three) == 3, F.avg(target).over(three)
        )
        return out

    added = S.over_blocks(table, place(freq), keys, 3, 0, columns)
    if V.GAP_FLAG in added.columns:
        added = added.withColumn(V.GAP_FLAG, F.col(V.GAP_FLAG).cast("byte"))
    return added.dropna("any")
