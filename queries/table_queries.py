"""Scans and sinks: each query writes below the shared folder and reads back."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F, types as T

from queries import base as B
from queries.base import query
from queries.profile_queries import ALL_SETS, JOINED, SETS
from trafficlens import fixed_values as V
from trafficlens.operators import buckets, combine, enrich, feature_sets, forecast, parse
from trafficlens.plans.traffic import rows_of
from trafficlens.schemas import PARSED
from trafficlens.session import work_path, written
from trafficlens.sources import logs, tables


def _written_logs(spark, d):
    """The log text of both splits, in event order over several files."""
    paths = {}
    for split in ("train", "test"):
        paths[split] = work_path(spark, f"log-{split}")
        (
            B.lines(spark, d).where(F.col("split") == split)
            .repartitionByRange(4, "event_id").sortWithinPartitions("event_id")
            .select("value").write.text(paths[split])
        )
    return paths["train"], paths["test"]


@query("s1_log_text", "value:s", (B.LINES, "SELECT value FROM lines"))
def _(spark, d):
    path = work_path(spark, "log")
    B.lines(spark, d).select("value").write.text(path)
    return logs.read_log_text(spark, path)


@query("s2_train_and_test", "split:s value:s", (B.LINES, "SELECT * FROM lines"))
def _(spark, d):
    return logs.read_train_test(spark, *_written_logs(spark, d))


def _zipped_logs(spark, d):
    """Both splits as two members each of a few zip containers."""
    path = work_path(spark, "log-zips")
    member = F.when(F.col("split") == "train", logs.TRAIN_MEMBER).otherwise(logs.TEST_MEMBER)
    logs.write_log_zip(
        B.lines(spark, d).withColumn("member", member).repartitionByRange(4, "event_id")
        .sortWithinPartitions("member", "event_id"), path)
    return path


@query("s1_log_zip", "value:s", (B.LINES, "SELECT value FROM lines WHERE split = 'train'"))
def _(spark, d):
    return logs.read_log_zip(spark, _zipped_logs(spark, d), logs.TRAIN_MEMBER)


@query("s2_train_and_test_zip", "split:s value:s", (B.LINES, "SELECT * FROM lines"))
def _(spark, d):
    return logs.read_train_test_zip(spark, _zipped_logs(spark, d))


def _parsed_csv(spark, d):
    path = work_path(spark, "parsed-csv")
    frame = B.parsed(spark, d).select("event_id", *V.RAW_COLUMNS).withColumnRenamed("event_id", "index")
    tables.write_csv(frame, path)
    return path


@query("s3_csv_scan", "host:s timestamp:t request:s response:s bytes:d",
       (B.PARSED, f"SELECT * REPLACE (try_strptime(regexp_extract(\"timestamp\", '{V.LOG_TIME_PATTERN}', 1), "
        "'%d/%b/%Y:%H:%M:%S') AS \"timestamp\") FROM parsed"))
def _(spark, d):
    frame = tables.read_csv(spark, _parsed_csv(spark, d), PARSED, index="index")
    typed = parse.apply_types(frame)
    return typed.withColumn("bytes", F.round(F.col("bytes") * 1000))


@query("s4_csv_columns", "index:l request:s", (B.PARSED, 'SELECT event_id AS "index", request FROM parsed'))
def _(spark, d):
    schema = T.StructType([T.StructField("index", T.LongType()), *PARSED.fields])
    return tables.read_csv(spark, _parsed_csv(spark, d), schema, columns=["index", "request"])


def _traffic_folder(spark, d):
    path = work_path(spark, "tables")
    tables.write_tables(buckets.bucket_tables(B.rows(spark, d)), path)
    return path


@query("s5_table_scan", "freq:s split:s timestamp:t y_req:l error_rate:d",
       (B.traffic_sql("5m"), "SELECT '5m' AS freq, * FROM traffic"))
def _(spark, d):
    return tables.read_table(spark, _traffic_folder(spark, d), "5m")


@query("s6_parquet_folder", "event_id:l response:i response_class:s", (B.ROWS, "SELECT * FROM rows_"))
def _(spark, d):
    path = work_path(spark, "sets")
    rows = B.rows(spark, d).select("event_id", "split", "response", "response_class")
    for split in ("train", "test"):
        tables.write_parquet(rows.where(F.col("split") == split).drop("split"), f"{path}/{split}")
    return tables.read_parquet_folder(spark, path)


@query("s7_table_sink", "freq:s split:s buckets:l y_req:l",
       ("", " UNION ALL ".join(
           f"SELECT '{freq}' AS freq, * FROM (WITH {B.traffic_sql(freq)} SELECT split, count(*) AS buckets, sum(y_req) AS y_req FROM traffic GROUP BY split)"
           for freq in V.FREQ_MINUTES)))
def _(spark, d):
    stored = spark.read.parquet(_traffic_folder(spark, d))
    return stored.groupBy("freq", "split").agg(F.count("*").alias("buckets"), F.sum("y_req").alias("y_req"))


@query("s8_feature_set_sink", ALL_SETS,
       (SETS.replace("WHERE reqmethod <> 'UNKNOWN'", "").replace("WHERE bytes IS NOT NULL", ""), JOINED))
def _(spark, d):
    folder = work_path(spark, "feature-sets")
    paths = []
    for name, made in feature_sets.feature_sets(written(B.rows(spark, d), "rows"), "event_id").items():
        paths.append(f"{folder}/{name}")
        tables.write_parquet(made, paths[-1])
    return combine.join_sets(tables.read_parquet_sets(spark, paths))


@query("s9_csv_sink", "split:s timestamp:t actual:d predicted:d",
       (B.prepared_sql(), "SELECT *, y_req_t1 AS actual, y_req AS predicted FROM prepared WHERE y_req_t1 IS NOT NULL AND flag_data_gap = 0"))
def _(spark, d):
    path = work_path(spark, "forecast-csv")
    frame = B.split_forecasts(spark, d)
    tables.write_csv(frame, path)
    return tables.read_csv(spark, path, frame.schema)


@query("s10_dense_index", "split:s index:l request:s",
       (B.PARSED, 'SELECT split, row_number() OVER (PARTITION BY split ORDER BY event_id) - 1 AS "index", request FROM parsed'))
def _(spark, d):
    scan = logs.read_train_test(spark, *_written_logs(spark, d), positions=True)
    return logs.dense_index(parse.parse_lines(scan))


@query("s10_dense_index_zip", "split:s index:l request:s",
       (B.PARSED, 'SELECT split, row_number() OVER (PARTITION BY split ORDER BY event_id) - 1 AS "index", request FROM parsed'))
def _(spark, d):
    scan = logs.read_train_test_zip(spark, _zipped_logs(spark, d), positions=True)
    return logs.dense_index(parse.parse_lines(scan))


@query("s11_saved_model", "split:s timestamp:t actual:d same:b",
       (B.ml_sql(), "SELECT *, y_req_t1 AS actual, true AS same FROM ml"))
def _(spark, d):
    """The forecast of the loaded model is that of the fitted one, and no constant."""
    table = written(B.ml(spark, d), "features")
    budget = forecast.Budget(rounds=20, depth=4, rate=0.15)
    chosen = forecast.short_features(table)
    _, model = forecast.hold_out_forecast(table, "y_req_t1", chosen, "2024-01-19", budget)
    path = work_path(spark, "model")
    tables.save_model(model, path)
    fitted, loaded = (
        forecast.forecast(m, table, "y_req_t1", chosen, budget) for m in (model, PipelineModel.load(path)))
    varied = loaded.agg((F.count_distinct("predicted") > 1).alias("varied"))
    return loaded.join(fitted.select("split", "timestamp", F.col("predicted").alias("before")), ["split", "timestamp"]).join(
        F.broadcast(varied)).withColumn("same", (F.col("predicted") == F.col("before")) & F.col("varied"))
