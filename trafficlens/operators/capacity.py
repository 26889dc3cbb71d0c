"""Forecasts to server counts, overloads and costs, per series.

Input rows hold ``series, timestamp, actual_req, actual_bytes, predicted_req,
predicted_bytes``: one row per minute and series, so a series is as long as its
time span and does not grow with the traffic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trafficlens import fixed_values as V
from trafficlens.functions import scaling, times
from trafficlens.operators import series as S

KEYS = ("series",)


def unit_capacity(forecasts: DataFrame, keys=KEYS) -> DataFrame:
    """Peak load over 3.5 servers, rounded up."""
    def cap(c):
        return F.ceil(F.max(F.col(c).cast("double")) / F.lit(V.PEAK_SERVERS)).cast("long")

    return forecasts.groupBy(*keys).agg(
        cap("actual_req").alias("cap_req"), cap("actual_bytes").alias("cap_bytes")
    )


def server_needs(
    forecasts: DataFrame, capacity: DataFrame, utilisation: float = V.REPLAY_UTILISATION, keys=KEYS
) -> DataFrame:
    """Servers needed now and for the mean of the last five forecasts.

    Rows are numbered by place, not by clock: gap buckets are not in the input.
    The stable need is null in the first four rows.
    """
    numbered = S.numbered_by_time(forecasts, keys, name="step").drop("n")

    def recent(frame):
        last = S.trailing(V.STABLE_ROWS, frame)
        full = F.count(F.lit(1)).over(last) == V.STABLE_ROWS
        return {
            "recent_req": F.when(full, F.avg("predicted_req").over(last)),
            "recent_bytes": F.when(full, F.avg("predicted_bytes").over(last)),
        }

    smoothed = S.over_blocks(numbered, F.col("step"), keys, V.STABLE_ROWS - 1, 0, recent)
    sized = smoothed.join(capacity, list(keys))

    def need(req, size):
        return scaling.required_servers(
            F.col(req), F.col(size), F.col("cap_req"), F.col("cap_bytes"), utilisation
        )

    return sized.withColumns({
        "need": need("predicted_req", "predicted_bytes"),
        "stable_need": F.when(F.col("recent_req").isNotNull(), need("recent_req", "recent_bytes")),
    }).drop("recent_req", "recent_bytes")


def held_needs(needs: DataFrame, hold: str, step: str, keys=KEYS) -> DataFrame:
    """``servers``: the largest need of the last ``hold``, the row's own included.

    More servers come at once, fewer only after the whole time has needed fewer. Each row
    counts in the sliding windows that it falls into, so a long series is spread over
    tasks, and a stream can keep the same rule.
    """
    # Windows need a zoned time; seconds since 1970 bring no zone into it.
    return needs.join(largest_needs(needs, hold, step, keys), [*keys, "timestamp"])


def largest_needs(needs: DataFrame, hold: str, step: str, keys=KEYS) -> DataFrame:
    """(keys, timestamp, servers): the largest need of the ``hold`` that ends with each step."""
    at = F.col("timestamp") if dict(needs.dtypes)["timestamp"] == "timestamp" else times.as_zoned(F.col("timestamp"))
    sliding = needs.withColumn("timestamp", at).groupBy(*keys, F.window("timestamp", hold, step)).agg(F.max("need").alias("servers"))
    last = F.col("window.end") - F.expr(f"INTERVAL {step}")
    return sliding.select(*keys, times.as_zone_free(last).alias("timestamp"), "servers")


def add_overload(decisions: DataFrame) -> DataFrame:
    return decisions.withColumn("overload", scaling.overload(
        F.col("actual_req"), F.col("actual_bytes"), F.col("servers"),
        F.col("cap_req"), F.col("cap_bytes"),
    ))


def cost_report(
    decisions: DataFrame, unit_cost: int = V.UNIT_COST, penalty: int = V.OVERLOAD_PENALTY, keys=KEYS
) -> DataFrame:
    """Cost of the decisions against always renting the largest count used."""
    sums = decisions.groupBy(*keys).agg(
        F.count("*").alias("minutes"),
        F.max("servers").alias("max_servers"),
        F.sum("servers").alias("_servers"),
        F.count_if("overload").alias("overload_minutes"),
    )
    costs = sums.withColumns({
        "cost": F.col("_servers") * unit_cost + F.col("overload_minutes") * penalty,
        "fixed_cost": F.col("minutes") * F.col("max_servers") * unit_cost,
    })
    saving = F.col("fixed_cost") - F.col("cost")
    return costs.select(
        *keys, "minutes", "max_servers", "cost", "fixed_cost", saving.alias("saving"),
        (saving / F.col("fixed_cost") * 100).alias("saving_percent"),
        "overload_minutes",
        ((1 - F.col("overload_minutes") / F.col("minutes")) * 100).alias("stability_percent"),
    )
