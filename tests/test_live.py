"""Live tables with their empty buckets, over restarts of the stream."""

import pandas as pd

from trafficlens.operators import buckets
from trafficlens.plans.traffic import rows_of
from trafficlens.streaming import traffic


def line(when, code=200):
    stamp = pd.Timestamp(when).strftime("%d/%b/%Y:%H:%M:%S -0400")
    return f'a.com - - [{stamp}] "GET /x/y HTTP/1.0" {code} 1000'


def test_gaps_across_restarts_equal_the_batch_grid(spark, tmp_path):
    """Three runs over a growing folder: the state carries the last bucket of each series."""
    runs = [
        [("a", "00:00:10"), ("a", "00:03:00"), ("b", "00:01:00"), ("b", "00:20:00")],
        [("a", "00:21:00"), ("a", "00:40:00"), ("b", "00:40:10")],
        [("a", "01:30:00"), ("b", "01:00:00"), ("b", "01:31:00")],
    ]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    every = []
    for run in runs:
        lines = [(split, line(f"1995-07-01 {at}")) for split, at in run]
        every += lines
        spark.createDataFrame(lines, "split string, value string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("split string, value string").parquet(source)
        live = traffic.gap_free(traffic.live_traffic(stream, 1, keys=("split",)), 1, ("split",))
        traffic.run_available(live, out, state, store=traffic.ROCKSDB)
    got = spark.read.schema(live.schema).parquet(out).toPandas()
    table = buckets.bucket_table(rows_of(spark.createDataFrame(every, "split string, value string")), "1m").toPandas()
    assert not got.duplicated(["split", "timestamp"]).any()
    for split in "ab":
        mine = got[got.split == split].sort_values("timestamp")
        # What the watermark has closed is the start of the batch's grid, without a hole.
        want = table[table.split == split].sort_values("timestamp").head(len(mine))
        assert len(mine) >= 40 and list(mine.timestamp) == list(want.timestamp)
        assert list(mine.y_req) == list(want.y_req) and list(mine.error_rate) == list(want.error_rate)
        assert list(mine.avg_path_depth.isna()) == list(mine.y_req == 0)


def test_a_series_starts_anew_after_years(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    lines = [(line(at),) for at in ("1995-07-01 00:00:00", "1995-07-01 00:02:00", "2040-01-01 00:00:00", "2040-01-01 00:01:00", "2040-01-02 00:00:00")]
    spark.createDataFrame(lines, "value string").write.parquet(source)
    stream = spark.readStream.schema("value string").parquet(source)
    live = traffic.gap_free(traffic.live_traffic(stream, 1), 1)
    traffic.run_available(live, out, str(tmp_path / "state"), store=traffic.ROCKSDB)
    got = [(str(r.timestamp), r.y_req) for r in spark.read.schema(live.schema).parquet(out).orderBy("timestamp").collect()]
    assert got == [("1995-07-01 00:00:00", 1), ("1995-07-01 00:01:00", 0), ("1995-07-01 00:02:00", 1),
                   ("2040-01-01 00:00:00", 1), ("2040-01-01 00:01:00", 1)]
