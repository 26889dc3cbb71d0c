"""Parsing, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from queries import base as B
from queries.base import query
from trafficlens import fixed_values as V
from trafficlens.functions import host as H, response as P, scaling, sizes as S, times
from trafficlens.operators import buckets, feature_sets, features, folds, parse, profile
from trafficlens.schemas import require_columns
from trafficlens.session import work_path

ROW = "event_id:l split:s "


@query("p1_parse_lines", ROW + "host:s timestamp:s request:s response:s bytes:d",
       (B.PARSED, "SELECT * FROM parsed"))
def _(spark, d):
    return B.parsed(spark, d)


@query("p2_unmatched_lines", "split:s lines:l parsed:l dropped:l",
       (B.PARSED, "SELECT split, count(*) AS lines, count(p.event_id) AS parsed, "
        "count(*) - count(p.event_id) AS dropped FROM lines LEFT JOIN parsed p USING (event_id, split) GROUP BY split"))
def _(spark, d):
    every = B.lines(spark, d).groupBy("split").agg(F.count("*").alias("lines"))
    good = B.parsed(spark, d).groupBy("split").agg(F.count("*").alias("parsed"))
    return every.join(good, "split", "left").withColumn("dropped", F.col("lines") - F.col("parsed"))


# Some lines with a year that is none, some with a size beyond 64 bits.
_HURT = B.LINES + f""",
hurt AS (SELECT event_id, split, CASE WHEN event_id % 97 = 0 THEN replace(value, '/2024:', '/20x4:')
  WHEN event_id % 89 = 0 THEN value || '99999999999999999999' ELSE value END AS value FROM lines),
cut AS (SELECT *, regexp_matches(value, '{V.LOG_PATTERN}') AS matched,
  regexp_extract(value, '{V.LOG_PATTERN}', ['host', 'ts', 'request', 'response', 'size']) AS m FROM hurt),
read AS (SELECT event_id, split, value, matched, m.host AS host, TRY_CAST(m.response AS INTEGER) AS response,
  try_strptime(regexp_extract(m.ts, '{V.LOG_TIME_PATTERN}', 1), '%d/%b/%Y:%H:%M:%S') AS "timestamp",
  TRY_CAST(m.size AS BIGINT) AS bytes, m.size AS size FROM cut),
judged AS (SELECT *, concat_ws(',', CASE WHEN NOT matched THEN 'unmatched' END,
  CASE WHEN matched AND "timestamp" IS NULL THEN 'bad_time' END,
  CASE WHEN matched AND bytes IS NULL AND size <> '-' THEN 'bad_size' END) AS faults FROM read)"""


def _hurt(spark, d):
    value, number = F.col("value"), F.col("event_id")
    hurt = F.when(number % 97 == 0, F.replace(value, F.lit("/2024:"), F.lit("/20x4:"))).when(
        number % 89 == 0, F.concat(value, F.lit("9" * 20))).otherwise(value)
    return B.lines(spark, d).select("event_id", "split", hurt.alias("value"))


@query("p2_reject_counts", "what:s n:l",
       (_HURT, """SELECT unnest(['lines', 'unmatched', 'bad_time', 'bad_size', 'known_size', 'no_size']) AS what,
          unnest([count(*), count(*) FILTER (NOT matched), count(*) FILTER (faults = 'bad_time' OR faults = 'bad_time,bad_size'),
          count(*) FILTER (faults LIKE '%bad_size'), count(*) FILTER (matched AND bytes IS NOT NULL),
          count(*) FILTER (matched AND bytes IS NULL)]) AS n FROM judged"""))
def _(spark, d):
    counts = parse.store_checked(_hurt(spark, d), work_path(spark, "checked-lines"))
    return spark.createDataFrame(list(counts.items()), "what string, n bigint")


@query("p2_quarantine", ROW + "value:s faults:s", (_HURT, "SELECT event_id, split, value, faults FROM judged WHERE faults <> ''"))
def _(spark, d):
    lines, path = _hurt(spark, d), work_path(spark, "checked-lines")
    parse.store_checked(lines, path)
    return parse.quarantine(lines, path).withColumn("faults", F.concat_ws(",", "faults"))


@query("p2_checked_rows", ROW + "host:s timestamp:t response:i bytes:d",
       (_HURT, "SELECT event_id, split, host, \"timestamp\", response, bytes / 1000.0 AS bytes FROM judged WHERE matched"))
def _(spark, d):
    lines, path = _hurt(spark, d), work_path(spark, "checked-lines")
    parse.store_checked(lines, path)
    return parse.checked_rows(lines, path)


@query("p3_dash_size", "split:s known:l missing:l total:l",
       (B.PARSED, "SELECT split, count(bytes) AS known, count(*) - count(bytes) AS missing, "
        "sum(bytes) AS total FROM parsed GROUP BY split"))
def _(spark, d):
    return B.parsed(spark, d).groupBy("split").agg(
        F.count("bytes").alias("known"), F.count_if(F.col("bytes").isNull()).alias("missing"),
        F.sum("bytes").alias("total"),
    )


@query("p4_required_columns", "split:s n:l", (B.PARSED, "SELECT split, count(*) AS n FROM parsed GROUP BY split"))
def _(spark, d):
    frame = B.parsed(spark, d)
    require_columns(frame, V.RAW_COLUMNS)
    return frame.groupBy("split").agg(F.count("*").alias("n"))


@query("p5_log_time", ROW + "timestamp:t", (B.TYPED, "SELECT * FROM typed"))
def _(spark, d):
    return B.typed(spark, d)


_ISO = "CASE WHEN event_id % 7 = 0 THEN 'no time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END"


@query("p6_iso_time", "event_id:l timestamp:t",
       ("", f"SELECT event_id, try_strptime({_ISO}, '%Y-%m-%d %H:%M:%S') AS timestamp FROM events"))
def _(spark, d):
    text = F.when(F.col("event_id") % 7 == 0, "no time").otherwise(F.substring(F.col("ts").cast("string"), 1, 19))
    return B.table(spark, d, "events").select("event_id", times.parse_iso_time(text).alias("timestamp"))


@query("p7_coerce_number", "event_id:l number:d",
       (B.PARSED, "SELECT event_id, TRY_CAST(size_text AS DOUBLE) AS number FROM parsed"))
def _(spark, d):
    text = F.substring_index("value", " ", -1)
    good = B.lines(spark, d).where(F.col("value").rlike(V.LOG_PATTERN))
    return good.select("event_id", parse.coerce_number(text).alias("number"))


@query("p8_kilobytes", ROW + "bytes:d", (B.TYPED, "SELECT * FROM typed"))
def _(spark, d):
    return B.typed(spark, d)


FEATURE_TYPES = "split:s timestamp:t " + " ".join(
    f"{c}:{'l' if c in ('y_req_t1', 'y_req', 'country_nunique', 'dir_nunique', 'method_nunique') else 'i' if c in ('bytes_all_missing', 'hour', 'weekday', 'is_weekend', 'flag_data_gap') else 'd'}"
    for c in V.FEATURE_COLUMNS[1:]
)


@query("p9_select_features", FEATURE_TYPES,
       (B.prepared_sql(), "SELECT * FROM prepared WHERE y_req_t1 IS NOT NULL"))
def _(spark, d):
    return features.select_features(features.add_targets(features.prepared(B.traffic(spark, d)), "15m"))


@query("p10_request_columns", "event_id:l reqmethod:s reqdirectory:s reqresourcetype:s reqpathdepth:i is_dynamic:i requrllength:i",
       (B.ROWS, "SELECT * FROM rows_"))
def _(spark, d):
    return feature_sets.request_features(B.rows(spark, d), "event_id").withColumnRenamed("index", "event_id")


@query("p11_timed_rows", "split:s timed:l rows:l",
       (B.TYPED, 'SELECT split, count("timestamp") AS timed, count(*) AS rows FROM typed GROUP BY split'))
def _(spark, d):
    typed = B.typed(spark, d)
    timed = typed.where(F.col("timestamp").isNotNull()).groupBy("split").agg(F.count("*").alias("timed"))
    return timed.join(typed.groupBy("split").agg(F.count("*").alias("rows")), "split")


@query("p12_rows_with_target", "split:s timestamp:t y_req_t1:l y_bytes_imp_t1:d",
       (B.prepared_sql(), "SELECT * FROM prepared WHERE y_req_t1 IS NOT NULL AND y_bytes_imp_t1 IS NOT NULL"))
def _(spark, d):
    return features.add_targets(B.traffic(spark, d), "15m")


_ALL_KNOWN = " AND ".join(f"{c} IS NOT NULL" for c in B.history_names("15m"))


@query("p13_complete_rows", "split:s timestamp:t y_req:l y_req_lag3:d",
       (B.ml_sql(), f"SELECT * FROM ml WHERE {_ALL_KNOWN}"))
def _(spark, d):
    return B.ml(spark, d, complete=True)


@query("p14_rows_without_gaps", "split:s timestamp:t y_req:l error_rate:d",
       (B.prepared_sql(), "SELECT * FROM prepared WHERE flag_data_gap = 0"))
def _(spark, d):
    return features.prepared(B.traffic(spark, d)).where(F.col(V.GAP_FLAG) == 0)


@query("p15_dropped_column", "split:s columns:l has_missing_rate:b",
       ("", "SELECT * FROM (SELECT unnest(['train', 'test']) AS split, 94 AS columns, false AS has_missing_rate) "
        "WHERE split IN (SELECT CASE WHEN ts < TIMESTAMP '2024-01-22' THEN 'train' ELSE 'test' END FROM events)"))
def _(spark, d):
    table = B.ml(spark, d, complete=True)
    return table.groupBy("split").agg(
        F.lit(len(table.columns)).alias("columns"),
        F.lit("bytes_missing_rate" in table.columns).alias("has_missing_rate"),
    )


@query("p16_date_range", ROW + "timestamp:t",
       (B.TYPED, "SELECT * FROM typed WHERE \"timestamp\" BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07'"))
def _(spark, d):
    day = lambda text: F.lit(text).cast("timestamp_ntz")
    return B.typed(spark, d).where(F.col("timestamp").between(day("2024-01-05"), day("2024-01-07")))


CUT = "2024-01-15 00:00:00"


@query("p17_hold_out", "split:s part:s n:l y_req:l",
       (B.traffic_sql(), f"SELECT split, CASE WHEN \"timestamp\" < TIMESTAMP '{CUT}' THEN 'train' ELSE 'valid' END AS part, "
        "count(*) AS n, sum(y_req) AS y_req FROM traffic GROUP BY ALL"))
def _(spark, d):
    train, valid = folds.hold_out(B.traffic(spark, d), CUT)
    both = train.withColumn("part", F.lit("train")).unionByName(valid.withColumn("part", F.lit("valid")))
    return both.groupBy("split", "part").agg(F.count("*").alias("n"), F.sum("y_req").alias("y_req"))


@query("p18_positive_sizes", ROW + "bytes:d", (B.TYPED, "SELECT * FROM typed WHERE bytes > 0"))
def _(spark, d):
    return B.typed(spark, d).where(F.col("bytes") > 0)


@query("p19_suspect_buckets", "split:s timestamp:t flag_data_gap:i bytes_missing_rate:d",
       (B.prepared_sql(), "SELECT * FROM prepared WHERE flag_data_gap = 1 OR bytes_missing_rate > 0.2"))
def _(spark, d):
    suspect = (F.col(V.GAP_FLAG) == 1) | (F.col("bytes_missing_rate") > V.SUSPECT_MISSING_RATE)
    return features.flag_gaps(B.traffic(spark, d)).where(suspect)


@query("p20_other_resources", ROW + "requrl:s reqresourcetype:s",
       (B.ROWS, "SELECT * FROM rows_ WHERE reqresourcetype <> 'Image' AND reqresourcetype <> 'Directory'"))
def _(spark, d):
    return B.rows(spark, d).where(~F.col("reqresourcetype").isin("Image", "Directory"))


@query("p21_fixed_sample", ROW + "host:s",
       (B.TYPED, f"SELECT * FROM typed ORDER BY md5(event_id || ':{V.SAMPLE_SEED}'), event_id LIMIT 5000"))
def _(spark, d):
    return profile.fixed_sample(B.typed(spark, d), "event_id", 5000)


@query("p22_renamed_forecast", "series:s timestamp:t actual_req:d forecast_req:d",
       (B.FORECASTS, "SELECT *, predicted_req AS forecast_req FROM joined"))
def _(spark, d):
    requests, _ = B.service_forecasts(spark, d)
    return requests.withColumnRenamed("actual", "actual_req").withColumnRenamed("predicted", "forecast_req")


@query("p23_distinct_values", "response:i", (B.ROWS, "SELECT DISTINCT response FROM rows_"))
def _(spark, d):
    return profile.distinct_values(B.rows(spark, d), "response")


@query("p24_first_and_last", "part:s event_id:l timestamp:t",
       (B.TYPED, "(SELECT 'first' AS part, * FROM typed ORDER BY \"timestamp\", event_id LIMIT 5) UNION ALL "
        "(SELECT 'last' AS part, * FROM typed ORDER BY \"timestamp\" DESC, event_id DESC LIMIT 5)"))
def _(spark, d):
    typed = B.typed(spark, d).where(F.col("timestamp").isNotNull())
    first = typed.orderBy("timestamp", "event_id").limit(5).withColumn("part", F.lit("first"))
    last = typed.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(5).withColumn("part", F.lit("last"))
    return first.unionByName(last)


@query("p25_missing_by_response", "response:i count:l",
       (B.ROWS, "SELECT response, count(*) AS count FROM rows_ WHERE bytes IS NULL GROUP BY response"))
def _(spark, d):
    return profile.counts_by(B.rows(spark, d).where(F.col("bytes").isNull()), "response")


@query("p26_cast_columns", "event_id:l response:i bytes:d",
       (B.PARSED, "SELECT event_id, TRY_CAST(response AS INTEGER) AS response, TRY_CAST(size_text AS DOUBLE) AS bytes FROM parsed"))
def _(spark, d):
    text = B.parsed(spark, d).withColumn("bytes", F.col("bytes").cast("string"))
    schema = T.StructType([T.StructField("response", T.IntegerType()), T.StructField("bytes", T.DoubleType())])
    return parse.cast_columns(text, schema)


# --- scalar functions -------------------------------------------------------

@query("f1_tld", "event_id:l tld:s", (B.ROWS, "SELECT * FROM rows_"))
def _(spark, d):
    return B.rows(spark, d)


_DOMAIN = """CASE WHEN contains(host, '.') AND NOT regexp_matches(regexp_extract(host, '([^.]*)$', 1), '^[0-9]+$')
  THEN regexp_extract(host, '([^.]*)$', 1) ELSE 'None' END"""


@query("f2_domain", "event_id:l domain:s", (B.TYPED, f"SELECT event_id, {_DOMAIN} AS domain FROM typed"))
def _(spark, d):
    return B.typed(spark, d).withColumn("domain", H.domain(F.col("host")))


@query("f3_visitor_category", "event_id:l visitor_category:s", (B.ROWS, "SELECT * FROM rows_"))
def _(spark, d):
    return B.rows(spark, d)


@query("f4_visitor_country", "event_id:l visitor_country:s", (B.ROWS, "SELECT * FROM rows_"))
def _(spark, d):
    return B.rows(spark, d)


@query("f5_top_visitor_country", "event_id:l visitor_country:s is_top_country:i",
       (B.ROWS + """, named AS (SELECT event_id, CASE WHEN visitor_category = 'country' THEN tld ELSE 'non_country' END AS c FROM rows_),
        kept AS (SELECT c FROM named WHERE c <> 'non_country' GROUP BY c ORDER BY count(*) DESC, c LIMIT 2)""",
        "SELECT event_id, CASE WHEN c IN (SELECT c FROM kept) THEN c ELSE 'other_country' END AS visitor_country, "
        "CAST(c IN (SELECT c FROM kept) AS INTEGER) AS is_top_country FROM named"))
def _(spark, d):
    named = H.visitor_country(F.col("visitor_category"), F.col("tld"), V.NON_COUNTRY)
    return profile.add_top_country(B.rows(spark, d).withColumn("visitor_country", named), 2)


_TYPE = f"CASE WHEN visitor_category IN ({B.quoted(V.MAIN_VISITOR_TYPES)}) THEN visitor_category ELSE 'other' END"


@query("f6_visitor_type", "event_id:l visitor_type:s",
       (B.ROWS, f"SELECT event_id, {_TYPE} AS visitor_type FROM rows_"))
def _(spark, d):
    return B.rows(spark, d).withColumn("visitor_type", H.visitor_type(F.col("visitor_category")))


@query("f7_visitor_flags", "event_id:l is_commercial:i is_unknown:i", (B.ROWS, "SELECT * FROM rows_"))
def _(spark, d):
    return B.rows(spark, d)


@query("f8_method", "event_id:l reqmethod:s", (B.ROWS, "SELECT * FROM rows_"))
def _(spark, d):
    return B.rows(spark, d)


@query("f9_url", "event_id:l requrl:s", (B.ROWS, "SELECT * FROM rows_"))
def _(spark, d):
    return B.rows(spark, d)


PAGES = "requested AS (SELECT page_id, 'GET ' || url || ' HTTP/1.0' AS request FROM pages)" + B.request_sql("requested", "asked")


def _page_query(name, types):
    @query(name, "page_id:l " + types, (PAGES, "SELECT * FROM asked"))
    def _(spark, d):
        return B.page_requests(spark, d)


_page_query("f10_directory_and_resource", "reqdirectory:s reqresource:s")
_page_query("f11_resource_type", "reqresourcetype:s")
_page_query("f12_path_depth", "reqpathdepth:i")
_page_query("f14_url_length", "requrllength:i")


@query("f13_is_dynamic", "event_id:l is_dynamic:i", (B.ROWS, "SELECT * FROM rows_"))
def _(spark, d):
    return B.rows(spark, d)


@query("f15_request_flags", "event_id:l is_heavy:i is_image:i is_get:i is_post:i", (B.ROWS, "SELECT * FROM rows_"))
def _(spark, d):
    return B.rows(spark, d)


@query("f16_response_class", "event_id:l response_class:s", (B.ROWS, "SELECT * FROM rows_"))
def _(spark, d):
    return B.rows(spark, d)


_PHRASE = "CASE response " + " ".join(
    f"WHEN {k} THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in V.STATUS_PHRASES.items()
) + f" ELSE '{V.UNKNOWN_STATUS_PHRASE}' END"


@query("f17_response_status", "event_id:l response_status:s",
       (B.ROWS, f"SELECT event_id, {_PHRASE} AS response_status FROM rows_"))
def _(spark, d):
    return B.rows(spark, d).withColumn("response_status", P.response_status(F.col("response")))


_RESULT = "CASE WHEN left(CAST(response AS VARCHAR), 1) IN ('1', '2', '3') THEN 'success' ELSE 'fail' END"


@query("f18_response_result", "event_id:l response_result:s",
       (B.ROWS, f"SELECT event_id, {_RESULT} AS response_result FROM rows_"))
def _(spark, d):
    return B.rows(spark, d).withColumn("response_result", P.response_result(F.col("response")))


@query("f19_bytes_missing", "event_id:l bytes_missing:i", (B.ROWS, "SELECT * FROM rows_"))
def _(spark, d):
    return B.rows(spark, d)


@query("f20_bytes_imputed", "event_id:l bytes_imputed:d", (B.FILLED, "SELECT * FROM filled"))
def _(spark, d):
    return B.filled(spark, d)


FENCE = B.TYPED + """,
fences AS (SELECT split, q1, q3, q3 + 1.5 * (q3 - q1) AS fence FROM (SELECT split,
  quantile_cont(bytes, 0.25) AS q1, quantile_cont(bytes, 0.75) AS q3 FROM typed WHERE bytes > 0 GROUP BY split))"""


@query("f21_bytes_action", "event_id:l bytesaction:s",
       (FENCE, "SELECT event_id, CASE WHEN bytes <= fence THEN 'normal' ELSE 'for observation' END AS bytesaction "
        "FROM typed JOIN fences USING (split)"))
def _(spark, d):
    return profile.with_fence(B.typed(spark, d)).withColumn(
        "bytesaction", S.bytes_action(F.col("bytes"), F.col("fence"))
    )


@query("f22_log_target", "split:s timestamp:t log_y:d back:d clipped:d",
       (B.traffic_sql(), "SELECT split, \"timestamp\", ln(1 + y_req) AS log_y, "
        "greatest(exp(ln(1 + y_req)) - 1, 0) AS back, greatest(exp(ln(1 + y_req) - 1) - 1, 0) AS clipped FROM traffic"))
def _(spark, d):
    log_y = scaling.to_log(F.col("y_req"))
    return B.traffic(spark, d).select(
        "split", "timestamp", log_y.alias("log_y"), scaling.from_log(log_y).alias("back"),
        scaling.from_log(log_y - 1).alias("clipped"),
    )


@query("f23_required_servers", "split:s timestamp:t servers:l",
       (B.traffic_sql(), "SELECT split, \"timestamp\", greatest(ceil(y_req / (5 * 0.7)), ceil(y_bytes_imp / (200 * 0.7)), 1) AS servers FROM traffic"))
def _(spark, d):
    need = scaling.required_servers(F.col("y_req"), F.col("y_bytes_imp"), F.lit(5), F.lit(200))
    return B.traffic(spark, d).withColumn("servers", need)


@query("f24_overload", "split:s timestamp:t overload:b",
       (B.traffic_sql(), "SELECT split, \"timestamp\", y_req > 2 * 3 OR y_bytes_imp > 2 * 150 AS overload FROM traffic"))
def _(spark, d):
    return B.traffic(spark, d).withColumn("overload", scaling.overload(
        F.col("y_req"), F.col("y_bytes_imp"), F.lit(2), F.lit(3), F.lit(150)
    ))
