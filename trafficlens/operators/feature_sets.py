"""One feature set per column of the log: narrow tables with a common key.

Each takes enriched rows and names the key column ``index``; rows are all kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trafficlens import fixed_values as V
from trafficlens.functions import host as H, times
from trafficlens.operators import profile


def host_features(rows: DataFrame, key: str = "index", top: int = V.TOP_COUNTRIES) -> DataFrame:
    """Visitor type and country with their relative frequencies; countries beyond the
    ``top`` most frequent ones share one name."""
    named = rows.select(
        F.col(key).alias("index"), H.visitor_type(F.col("visitor_category")).alias("visitor_type"),
        F.col("is_commercial").cast("int").alias("is_commercial"), F.col("is_unknown").cast("int").alias("is_unknown"),
        H.visitor_country(F.col("visitor_category"), F.col("tld"), V.NON_COUNTRY).alias("visitor_country"))
    counted = profile.add_frequency(profile.add_top_country(named, top), "visitor_type", "visitor_type_freq")
    return profile.add_frequency(counted, "visitor_country", "country_freq").select(
        "index", "visitor_type", "is_commercial", "is_unknown", "visitor_type_freq", "visitor_country",
        "country_freq", "is_top_country")


def time_features(rows: DataFrame, key: str = "index") -> DataFrame:
    calendar = times.row_calendar(F.col("timestamp"))
    return rows.select(F.col(key).alias("index"), "timestamp", *(c.alias(n) for n, c in calendar.items()))


def request_features(rows: DataFrame, key: str = "index") -> DataFrame:
    return rows.select(
        F.col(key).alias("index"), "reqmethod", "reqdirectory", "reqresourcetype", "reqpathdepth",
        F.col("is_dynamic").cast("int").alias("is_dynamic"), "requrllength")


def response_features(rows: DataFrame, key: str = "index") -> DataFrame:
    return rows.select(F.col(key).alias("index"), "response", "response_class")


def bytes_features(rows: DataFrame, key: str = "index") -> DataFrame:
    return rows.select(F.col(key).alias("index"), "bytes")


SETS = {
    "host": host_features, "time": time_features, "request": request_features,
    "response": response_features, "bytes": bytes_features,
}


def feature_sets(rows: DataFrame, key: str = "index") -> dict[str, DataFrame]:
    return {name: make(rows, key) for name, make in SETS.items()}
