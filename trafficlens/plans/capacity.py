"""Forecasts to server counts and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from trafficlens import fixed_values as V
from trafficlens.operators import capacity as C, combine
from trafficlens.session import written


def decisions(
    requests: DataFrame, sizes: DataFrame, step: str = "1 minute", hold: str | None = None,
    utilisation: float = V.REPLAY_UTILISATION, keys=C.KEYS,
) -> DataFrame:
    """Join both forecasts, size a server from the peak, and hold the need.

    Rows are ``step`` apart; without ``hold`` servers are held for the cooldown.
    """
    if hold is None:
        count, unit = step.split()
        hold = f"{V.COOLDOWN * int(count)} {unit}"
    joined = written(combine.join_forecasts(requests, sizes, (*keys, "timestamp")), "forecasts")
    needs = C.server_needs(joined, C.unit_capacity(joined, keys), utilisation, keys)
    return C.add_overload(C.held_needs(written(needs, "needs"), hold, step, keys))


def report(requests: DataFrame, sizes: DataFrame, keys=C.KEYS, **policy) -> DataFrame:
    return C.cost_report(decisions(requests, sizes, keys=keys, **policy), keys=keys)
