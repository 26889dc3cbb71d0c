"""Typed rows to enriched rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trafficlens.functions import host as H, request as R, response as P, sizes as S
from trafficlens.operators.quantiles import exact_quantiles
from trafficlens.session import lookup


def add_host_features(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("tld", H.tld(F.col("host")))
        .withColumn("visitor_category", H.visitor_category(F.col("tld")))
        .withColumns({
            "visitor_country": H.visitor_country(F.col("visitor_category"), F.col("tld")),
            "is_commercial": H.flag(F.col("visitor_category") == "commercial"),
            "is_unknown": H.flag(F.col("visitor_category") == "unknown"),
        })
    )


def add_request_features(df: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("request"), F.lit(""))
    return (
        df.withColumns({"reqmethod": R.request_method(text), "requrl": R.request_url(text)})
        .withColumns({
            "reqdirectory": R.url_directory(F.col("requrl")),
            "reqresource": R.url_resource(F.col("requrl")),
        })
        .withColumns({
            "reqresourcetype": R.resource_type(F.col("reqresource")),
            "reqpathdepth": R.path_depth(F.col("reqdirectory")),
            "is_dynamic": R.is_dynamic(F.col("reqresource")),
            "requrllength": R.url_length(F.col("requrl")),
        })
        .withColumns({
            "is_heavy": R.is_heavy(F.col("reqresourcetype")),
            "is_image": R.is_image(F.col("reqresourcetype")),
            "is_get": H.flag(F.col("reqmethod") == "GET"),
            "is_post": H.flag(F.col("reqmethod") == "POST"),
        })
    )


def add_response_features(df: DataFrame) -> DataFrame:
    return df.withColumn("response_class", P.response_class(F.col("response")))


def enrich_rows(typed: DataFrame) -> DataFrame:
    """Host, request and status columns and the missing-size flag: one narrow stage."""
    rows = add_response_features(add_request_features(add_host_features(typed)))
    return rows.withColumn("bytes_missing", S.bytes_missing(F.col("bytes")))


def code_medians(rows: DataFrame, keys=("split",)) -> DataFrame:
    """Median known size per status code, over all rows of a split, also those
    without a readable time."""
    return exact_quantiles(
        rows, "bytes", {"median_bytes": 0.5}, [*keys, "response"]
    ).drop("n")


def add_bytes_imputed(rows: DataFrame, keys=("split",), keep_null: bool = False) -> DataFrame:
    """Fill missing sizes by the median of their code."""
    medians = lookup(code_medians(rows, keys), "medians")
    filled = S.imputed(F.col("bytes"), F.col("response"), F.col("median_bytes"), keep_null)
    return (
        rows.join(medians, [*keys, "response"], "left")
        .withColumn("bytes_imputed", filled)
        .select(*rows.columns, "bytes_imputed")
    )
