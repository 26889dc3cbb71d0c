"""Streams run to the end of their input, against the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import base as B
from queries.base import query
from trafficlens.operators import capacity as C
from trafficlens.session import work_path
from trafficlens.streaming import scaling, traffic

LIVE = ("timestamp:t y_req:l known_kilobytes:d bytes_missing_rate:d error_rate:d server_error_rate:d "
        "redirection_rate:d dynamic_rate:d commercial_rate:d unknown_rate:d avg_path_depth:d")


@query("x1_live_traffic", LIVE,
       (B.ROWS, """SELECT time_bucket(INTERVAL '15 minutes', "timestamp") AS "timestamp", count(*) AS y_req,
          coalesce(sum(bytes), 0) AS known_kilobytes, avg(bytes_missing) AS bytes_missing_rate,
          avg(CASE WHEN response >= 400 THEN 1.0 ELSE 0.0 END) AS error_rate,
          avg(CASE WHEN response >= 500 THEN 1.0 ELSE 0.0 END) AS server_error_rate,
          avg(CASE WHEN response >= 300 AND response < 400 THEN 1.0 ELSE 0.0 END) AS redirection_rate,
          avg(is_dynamic) AS dynamic_rate, avg(is_commercial) AS commercial_rate,
          avg(is_unknown) AS unknown_rate, avg(reqpathdepth) AS avg_path_depth
          FROM rows_ GROUP BY 1 HAVING time_bucket(INTERVAL '15 minutes', "timestamp") + INTERVAL '15 minutes'
            <= (SELECT max("timestamp") FROM rows_) - INTERVAL '10 minutes'"""))
def _(spark, d):
    source, out = work_path(spark, "live-log"), work_path(spark, "live-traffic")
    B.lines(spark, d).select("value").write.text(source)
    stream = traffic.live_traffic(traffic.read_log_stream(spark, source), 15)
    traffic.run_available(stream, out, work_path(spark, "live-state"))
    return spark.read.schema(stream.schema).parquet(out)


@query("x1_live_grid", "split:s timestamp:t y_req:l known_kilobytes:d error_rate:d avg_path_depth:d",
       (B.ROWS + """, live AS (SELECT split, time_bucket(INTERVAL '2 minutes', "timestamp") AS "timestamp", count(*) AS y_req,
          coalesce(sum(bytes), 0) AS known_kilobytes, avg(CASE WHEN response >= 400 THEN 1.0 ELSE 0.0 END) AS error_rate,
          avg(reqpathdepth) AS avg_path_depth FROM rows_ GROUP BY 1, 2),
        final AS (SELECT * FROM live WHERE "timestamp" + INTERVAL '2 minutes' <= (SELECT max("timestamp") FROM rows_) - INTERVAL '10 minutes'),
        grid AS (SELECT split, unnest(generate_series(min("timestamp"), max("timestamp"), INTERVAL '2 minutes')) AS "timestamp" FROM final GROUP BY split)""",
        """SELECT grid.*, coalesce(y_req, 0) AS y_req, coalesce(known_kilobytes, 0) AS known_kilobytes,
          coalesce(error_rate, 0) AS error_rate, avg_path_depth FROM grid LEFT JOIN final USING (split, "timestamp")"""))
def _(spark, d):
    """A live table with its empty buckets, which equals the grid of the batch."""
    source, out = work_path(spark, "live-log"), work_path(spark, "live-grid")
    lines = B.lines(spark, d).select("split", "value")
    lines.write.parquet(source)
    stream = spark.readStream.schema(lines.schema).parquet(source)
    live = traffic.gap_free(traffic.live_traffic(stream, 2, keys=("split",)), 2, ("split",))
    traffic.run_available(live, out, work_path(spark, "live-state"), store=traffic.ROCKSDB)
    return spark.read.schema(live.schema).parquet(out)


# The last step is still open when the stream ends, as are those within the delay.
@query("x2_live_decisions", "series:s timestamp:t servers:l",
       (B.DECISIONS, """SELECT d.series, s AS "timestamp", max(need) AS servers FROM
          (SELECT series, need, unnest(generate_series("timestamp", "timestamp" + INTERVAL 60 MINUTE, INTERVAL 15 MINUTE)) AS s FROM needs) d
          WHERE s + INTERVAL 15 MINUTE <= (SELECT max("timestamp") FROM needs) - INTERVAL 10 MINUTE GROUP BY d.series, s"""))
def _(spark, d):
    source, out = work_path(spark, "live-forecasts"), work_path(spark, "live-decisions")
    joined = B.joined_forecasts(spark, d)
    sized = joined.join(C.unit_capacity(joined), "series").select(
        "series", "timestamp", "predicted_req", "predicted_bytes", "cap_req", "cap_bytes"
    )
    sized.write.parquet(source)
    stream = scaling.live_servers(spark.readStream.schema(sized.schema).parquet(source), "75 minutes", "15 minutes")
    traffic.run_available(stream, out, work_path(spark, "live-state"))
    return spark.read.schema(stream.schema).parquet(out)
