"""Log text to CSV, CSV to typed CSV, and the alternative last pass over traffic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trafficlens import fixed_values as V
from trafficlens.functions import sizes, times
from trafficlens.operators import features, parse
from trafficlens.schemas import PARSED, TYPED_WHOLE_BYTES
from trafficlens.sources import logs, tables


def log_to_csv(spark: SparkSession, text: str, out: str) -> DataFrame:
    """The records of log text as they stand there, one CSV folder."""
    tables.write_csv(parse.parse_lines(logs.read_log_text(spark, text)), out)
    return tables.read_csv(spark, out, PARSED)


def typed_csv(spark: SparkSession, source: str, out: str) -> DataFrame:
    """The same with a time and whole bytes; the status stays text. What cannot be read
    is null."""
    raw = tables.read_csv(spark, source, PARSED)
    typed = raw.select(
        "host", times.parse_log_time(F.trim("timestamp")).alias("timestamp"), "request",
        F.col("response").cast("string").alias("response"), sizes.parse_size(F.col("bytes").cast("string")).alias("bytes"))
    tables.write_csv(typed, out)
    return tables.read_csv(spark, out, TYPED_WHOLE_BYTES)


def short_history_tables(
    spark: SparkSession, path: str, out: str, freqs=tuple(V.FREQ_MINUTES), split: str | None = "train",
) -> dict[str, DataFrame]:
    """Read the traffic table of each frequency, add the short history, write it."""
    for freq in freqs:
        table = tables.read_table(spark, path, freq, split)
        tables.write_features(features.short_history(features.prepared(table), freq), out, freq)
    return {freq: tables.read_table(spark, out, freq) for freq in freqs}
