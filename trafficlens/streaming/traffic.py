"""Live traffic tables: the additive bucket columns over a stream of log lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from trafficlens.functions import times
from trafficlens.operators.buckets import MOST_EMPTY_DAYS
from trafficlens.plans.traffic import rows_of
from trafficlens.sources.logs import log_line


def read_log_stream(spark: SparkSession, path, files_per_batch: int | None = None) -> DataFrame:
    """New text files of a folder, line by line, by the rule of the batch reader."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path).select(log_line())


def live_traffic(lines: DataFrame, minutes: int, delay: str = "10 minutes", keys=()) -> DataFrame:
    """Counts, known sizes and rates per bucket; a bucket is final once the watermark
    has passed its end, later rows are dropped. Empty buckets, medians, distinct
    counts and entropy need the whole table and stay in batch."""
    # A watermark needs a zoned time.
    zoned = rows_of(lines).withColumn("timestamp", times.as_zoned(F.col("timestamp")))
    rows = zoned.withWatermark("timestamp", delay)
    code = F.col("response")

    def rate(condition):
        return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))

    return rows.groupBy(*keys, F.window("timestamp", f"{minutes} minutes")).agg(
        F.count("*").alias("y_req"),
        F.coalesce(F.sum("bytes"), F.lit(0.0)).alias("known_kilobytes"),
        F.avg("bytes_missing").alias("bytes_missing_rate"),
        rate(code >= 400).alias("error_rate"),
        rate(code >= 500).alias("server_error_rate"),
        rate((code >= 300) & (code < 400)).alias("redirection_rate"),
        F.avg("is_dynamic").alias("dynamic_rate"),
        F.avg("is_commercial").alias("commercial_rate"),
        F.avg("is_unknown").alias("unknown_rate"),
        F.avg("reqpathdepth").alias("avg_path_depth"),
    ).select(*keys, times.as_zone_free(F.col("window.start")).alias("timestamp"), *[
        "y_req", "known_kilobytes", "bytes_missing_rate", "error_rate", "server_error_rate",
        "redirection_rate", "dynamic_rate", "commercial_rate", "unknown_rate", "avg_path_depth",
    ])


# Columns of a live table that are 0 in an empty bucket; the path depth stays null there.
ZERO_WHEN_EMPTY = [
    "y_req", "known_kilobytes", "bytes_missing_rate", "error_rate", "server_error_rate",
    "redirection_rate", "dynamic_rate", "commercial_rate", "unknown_rate",
]
# Buckets handed on at once.
PIECE = 10_000


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class GapFiller(StatefulProcessor):
    """Puts the empty buckets between the closed buckets of one series."""

    def __init__(self, names: list[str], group: list[str], step: pd.Timedelta, most: pd.Timedelta):
        self.names, self.group, self.step, self.most = names, group, step, most

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "seconds long")

    def handleInputRows(self, key, rows, timerValues):
        # A constant key may have been taken out of the rows.
        found = pd.concat(list(rows)).sort_values("timestamp").assign(**dict(zip(self.group, key)))[self.names]
        before = pd.Timestamp(self.last.get()[0], unit="s") if self.last.exists() else None
        for at in range(0, len(found), PIECE):
            piece = found.iloc[at:at + PIECE]
            gaps = []
            for now in piece["timestamp"]:
                if before is not None and self.step < now - before <= self.most:
                    first = before + self.step
                    while first < now:  # a long gap goes out in pieces
                        until = min(now, first + PIECE * self.step)
                        gaps.append(pd.date_range(first, until, freq=self.step, inclusive="left"))
                        first = until
                        if sum(map(len, gaps)) >= PIECE:
                            yield self.empty(key, gaps)
                            gaps = []
                before = now
            if gaps:
                yield self.empty(key, gaps)
            yield piece
        self.last.update((int(before.timestamp()),))

    def empty(self, key, gaps) -> pd.DataFrame:
        frame = pd.DataFrame({"timestamp": np.concatenate([g.values for g in gaps])})
        for name in self.names:
            if name in self.group:
                frame[name] = key[self.group.index(name)]
            elif name != "timestamp":
                frame[name] = 0 if name in ZERO_WHEN_EMPTY else np.nan
        return frame[self.names]

    def close(self) -> None:
        pass


def gap_free(live: DataFrame, minutes: int, keys=(), most_empty_days: int = MOST_EMPTY_DAYS) -> DataFrame:
    """Live buckets (``keys, timestamp, ...``, each final when it comes) with the empty
    ones between them: the grid of the batch tables as far as the stream has come.

    All that is kept of a series is its last bucket. Empty buckets are handed on when the
    next non-empty one closes, as only then are they inside the series; after more than
    ``most_empty_days`` empty days a series starts anew instead. A batch's closed buckets
    of one series are ordered by one task; their number follows the time that the batch
    covers, not the traffic. The stream needs the state store ``ROCKSDB``.
    """
    group = list(keys) or ["_series"]
    rows = live if keys else live.withColumn("_series", F.lit(0))
    filler = GapFiller(rows.columns, group, pd.Timedelta(minutes=minutes), pd.Timedelta(days=most_empty_days))
    filled = rows.groupBy(*group).transformWithStateInPandas(
        statefulProcessor=filler, outputStructType=rows.schema, outputMode="Append", timeMode="None")
    return filled if keys else filled.drop("_series")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", store: str | None = None) -> None:
    """Process what is there now into Parquet and stop. ``store`` names the state store of
    this one stream, where it is not the session's."""
    conf, setting = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(setting)
    conf.set(setting, store or before)
    try:
        query = (
            stream.writeStream.format("parquet").outputMode(mode)
            .option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        conf.set(setting, before)
