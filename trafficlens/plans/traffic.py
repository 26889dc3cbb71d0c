"""Raw log text to feature tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trafficlens import fixed_values as V
from trafficlens.operators import buckets, enrich, features, parse
from trafficlens.session import written
from trafficlens.sources import logs, tables


def rows_of(lines: DataFrame) -> DataFrame:
    """Lines to enriched rows, one narrow stage."""
    return enrich.enrich_rows(parse.apply_types(parse.parse_lines(lines)))


def traffic_features(
    spark: SparkSession, train, test, out: str, freqs=tuple(V.FREQ_MINUTES), keys=("split",),
    complete: bool = False,
) -> dict[str, DataFrame]:
    """Read both splits once and write the feature table of every frequency."""
    return features_of_lines(logs.read_train_test(spark, train, test), out, freqs, keys, complete)


def traffic_features_from_zip(
    spark: SparkSession, archive: str, out: str, freqs=tuple(V.FREQ_MINUTES), keys=("split",), complete: bool = False,
    train: str = logs.TRAIN_MEMBER, test: str = logs.TEST_MEMBER,
) -> dict[str, DataFrame]:
    """The same from the two members of a zip container. Two members are two tasks, so
    the lines are stored before the parsing, which then runs on all cores."""
    lines = logs.read_train_test_zip(spark, archive, train, test)
    return features_of_lines(written(lines, "zip-lines"), out, freqs, keys, complete)


def features_of_lines(
    lines: DataFrame, out: str, freqs=tuple(V.FREQ_MINUTES), keys=("split",), complete: bool = False,
) -> dict[str, DataFrame]:
    """Lines with their split to feature tables on disk."""
    spark, rows = lines.sparkSession, rows_of(lines)
    traffic = written(buckets.bucket_tables(rows, freqs, keys), "traffic")
    for freq in freqs:
        table = traffic.where(F.col("freq") == freq).drop("freq")
        tables.write_features(features.feature_table(table, freq, keys, complete), out, freq)
    return {freq: tables.read_table(spark, out, freq) for freq in freqs}
