"""Joins and unions of whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from trafficlens import fixed_values as V


def join_sets(sets: list[DataFrame], key: str = "index", how: str = "outer", keys: DataFrame | None = None) -> DataFrame:
    """Join feature sets on one key.

    A chain of full outer joins would move every intermediate result again. The
    outer case therefore first unites the keys and then joins each set to them:
    left joins keep the partitioning, so each set moves once. With ``keys``, the
    distinct keys of all sets as ``tables.write_bucketed_sets`` stores them, nothing has
    to be united, and sets stored that way are read once and do not move at all.
    """
    for i, df in enumerate(sets):
        if key not in df.columns:
            raise ValueError(f"feature set {i} has no key column {key!r}")
    if how not in ("outer", "inner", "left"):
        raise ValueError(f"unknown join type {how!r}")
    if how != "outer":
        return reduce(lambda a, b: a.join(b, key, how), sets)
    known = [df.where(F.col(key).isNotNull()) for df in sets]
    if keys is None:
        keys = reduce(lambda a, b: a.union(b), [df.select(key) for df in known]).distinct()
    joined = reduce(lambda a, b: a.join(b, key, "left"), known, keys)
    # A null key equals no other, so such rows stand alone, as in a full outer join.
    lone = [df.where(F.col(key).isNull()) for df in sets]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lone, joined)


def stack_sets(sets: list[DataFrame], drop: str | None = None) -> DataFrame:
    """All rows one below the other, columns matched by name, missing ones null."""
    parts = [df.drop(drop) if drop else df for df in sets]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def metric_report(rows: list[DataFrame]) -> DataFrame:
    """The metric rows of all models in one table with a fixed column order."""
    return stack_sets(rows).select(*V.METRIC_COLUMNS)


def join_forecasts(requests: DataFrame, sizes: DataFrame, keys=("series", "timestamp")) -> DataFrame:
    """Request and size forecasts of the same moments."""
    def renamed(df, what):
        return df.withColumnRenamed("actual", f"actual_{what}").withColumnRenamed(
            "predicted", f"predicted_{what}"
        )

    return renamed(requests, "req").join(renamed(sizes, "bytes"), list(keys), "inner")
