"""Live server counts: the batch rule on a stream of forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trafficlens import fixed_values as V
from trafficlens.functions import scaling, times
from trafficlens.operators import capacity as C


def live_servers(
    forecasts: DataFrame, hold: str, step: str, delay: str = "10 minutes",
    utilisation: float = V.REPLAY_UTILISATION, keys=C.KEYS,
) -> DataFrame:
    """Rows ``series, timestamp, predicted_req, predicted_bytes, cap_req, cap_bytes`` to
    (series, timestamp, servers) for every step; a count is final once the watermark has
    passed the end of its step. Only the windows that are still open are kept."""
    need = scaling.required_servers(
        F.col("predicted_req"), F.col("predicted_bytes"), F.col("cap_req"), F.col("cap_bytes"), utilisation)
    needs = forecasts.select(*keys, times.as_zoned(F.col("timestamp")).alias("timestamp"), need.alias("need"))
    return C.largest_needs(needs.withWatermark("timestamp", delay), hold, step, keys)
