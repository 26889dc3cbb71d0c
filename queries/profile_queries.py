"""Lookups, joins, unions and column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import base as B
from queries.base import query
from queries.row_queries import _PHRASE, _RESULT, _TYPE, FENCE, PAGES
from trafficlens import fixed_values as V
from trafficlens.functions import host as H, response as P, times
from trafficlens.operators import combine, enrich, feature_sets, features, profile
from trafficlens.session import work_path, written
from trafficlens.sources import tables


def _feature_sets(spark, d):
    """The five sets of the library, two of them without the rows that tell nothing."""
    made = feature_sets.feature_sets(written(B.rows(spark, d), "rows"), "event_id")
    made["request"] = made["request"].where(F.col("reqmethod") != "UNKNOWN")
    made["bytes"] = made["bytes"].where(F.col("bytes").isNotNull())
    return list(made.values())


SETS = B.ROWS + f""",
named AS (SELECT *, {_TYPE} AS visitor_type, CASE WHEN visitor_category = 'country' THEN tld ELSE 'non_country' END AS c FROM rows_),
kept AS (SELECT c FROM named WHERE c <> 'non_country' GROUP BY c ORDER BY count(*) DESC, c LIMIT 15),
topped AS (SELECT * EXCLUDE (visitor_country), CASE WHEN c IN (SELECT c FROM kept) THEN c ELSE 'other_country' END AS visitor_country,
  CAST(c IN (SELECT c FROM kept) AS INTEGER) AS is_top_country FROM named),
h AS (SELECT event_id AS "index", visitor_type, is_commercial, is_unknown, visitor_country, is_top_country,
  count(*) OVER (PARTITION BY visitor_type) / count(*) OVER () AS visitor_type_freq,
  count(*) OVER (PARTITION BY visitor_country) / count(*) OVER () AS country_freq FROM topped),
t AS (SELECT event_id AS "index", "timestamp", hour("timestamp") AS hour, day("timestamp") AS day, isodow("timestamp") - 1 AS weekday,
  month("timestamp") AS month, coalesce(CAST(isodow("timestamp") >= 6 AS INTEGER), 0) AS is_weekend FROM rows_),
q AS (SELECT event_id AS "index", reqmethod, reqdirectory, reqresourcetype, reqpathdepth, is_dynamic, requrllength
  FROM rows_ WHERE reqmethod <> 'UNKNOWN'),
r AS (SELECT event_id AS "index", response, response_class FROM rows_),
z AS (SELECT event_id AS "index", bytes FROM rows_ WHERE bytes IS NOT NULL)"""
ALL_SETS = ("index:l visitor_type:s is_commercial:i is_unknown:i visitor_type_freq:d visitor_country:s country_freq:d is_top_country:i "
            "timestamp:t hour:i day:i weekday:i month:i is_weekend:i reqmethod:s reqdirectory:s reqresourcetype:s reqpathdepth:d "
            "is_dynamic:d requrllength:d response:i response_class:s bytes:d")
JOINED = ('SELECT * FROM h FULL JOIN t USING ("index") FULL JOIN q USING ("index") FULL JOIN r USING ("index") '
          'FULL JOIN z USING ("index")')


@query("j1_outer_join", ALL_SETS, (SETS, JOINED))
def _(spark, d):
    return combine.join_sets(_feature_sets(spark, d))


@query("j1_bucketed_join", ALL_SETS, (SETS, JOINED))
def _(spark, d):
    """The same over sets that are stored by key: the join moves no row."""
    sets = dict(zip(feature_sets.SETS, _feature_sets(spark, d)))
    keys, stored = tables.write_bucketed_sets(sets, work_path(spark, "bucketed-sets"), buckets=8)
    return combine.join_sets(stored, keys=keys)


@query("j1_inner_join", ALL_SETS, (SETS, JOINED.replace("FULL JOIN", "JOIN")))
def _(spark, d):
    return combine.join_sets(_feature_sets(spark, d), how="inner")


@query("p10_host_columns", "event_id:l visitor_type:s is_commercial:i is_unknown:i visitor_type_freq:d",
       (B.ROWS, f"SELECT event_id, {_TYPE} AS visitor_type, is_commercial, is_unknown, "
        f"count(*) OVER (PARTITION BY {_TYPE}) / count(*) OVER () AS visitor_type_freq FROM rows_"))
def _(spark, d):
    return feature_sets.host_features(written(B.rows(spark, d), "rows"), "event_id").withColumnRenamed("index", "event_id")


@query("j2_forecast_join", "series:s timestamp:t actual_req:d predicted_req:d actual_bytes:d predicted_bytes:d",
       (B.FORECASTS, "SELECT * FROM joined"))
def _(spark, d):
    return B.joined_forecasts(spark, d)


@query("j3_median_lookup", "response:i n_missing:l filled:d",
       (B.FILLED, "SELECT response, count(*) AS n_missing, sum(bytes_imputed) AS filled FROM filled WHERE bytes IS NULL GROUP BY response"))
def _(spark, d):
    missing = B.filled(spark, d).where(F.col("bytes").isNull())
    return missing.groupBy("response").agg(F.count("*").alias("n_missing"), F.sum("bytes_imputed").alias("filled"))


@query("j4_frequency_lookup", "event_id:l visitor_type:s visitor_type_freq:d",
       (B.ROWS, f"SELECT event_id, {_TYPE} AS visitor_type, count(*) OVER (PARTITION BY {_TYPE}) / count(*) OVER () AS visitor_type_freq FROM rows_"))
def _(spark, d):
    rows = B.rows(spark, d).withColumn("visitor_type", H.visitor_type(F.col("visitor_category")))
    return profile.add_frequency(rows, "visitor_type", "visitor_type_freq")


_NAMED = B.ROWS + """, named AS (SELECT event_id, CASE WHEN visitor_category = 'country' THEN tld ELSE 'non_country' END AS c FROM rows_),
kept AS (SELECT c FROM named WHERE c <> 'non_country' GROUP BY c ORDER BY count(*) DESC, c LIMIT 15),
topped AS (SELECT event_id, CASE WHEN c IN (SELECT c FROM kept) THEN c ELSE 'other_country' END AS visitor_country,
  CAST(c IN (SELECT c FROM kept) AS INTEGER) AS is_top_country FROM named)"""


@query("j5_top_membership", "event_id:l visitor_country:s country_freq:d is_top_country:i",
       (_NAMED, "SELECT *, count(*) OVER (PARTITION BY visitor_country) / count(*) OVER () AS country_freq FROM topped"))
def _(spark, d):
    named = H.visitor_country(F.col("visitor_category"), F.col("tld"), V.NON_COUNTRY)
    rows = B.rows(spark, d).withColumn("visitor_country", named).select("event_id", "visitor_country")
    topped = written(profile.add_top_country(rows), "topped")
    return profile.add_frequency(topped, "visitor_country", "country_freq")


@query("j6_status_phrase", "response:i response_status:s count:l",
       (B.ROWS, f"SELECT response, {_PHRASE} AS response_status, count(*) AS count FROM rows_ GROUP BY ALL"))
def _(spark, d):
    rows = B.rows(spark, d).withColumn("response_status", P.response_status(F.col("response")))
    return profile.counts_by(rows, "response", "response_status")


@query("u1_stacked_sets", ALL_SETS.replace(":i", ":d"),
       (SETS, "SELECT * FROM h UNION ALL BY NAME SELECT * FROM t UNION ALL BY NAME SELECT * FROM q "
        "UNION ALL BY NAME SELECT * FROM r UNION ALL BY NAME SELECT * FROM z"))
def _(spark, d):
    return combine.stack_sets(_feature_sets(spark, d))


# --- counts and shares ------------------------------------------------------

def _count_query(name, column, expr, build):
    @query(name, f"{column}:s count:l", (B.ROWS, f"SELECT {expr} AS {column}, count(*) AS count FROM rows_ GROUP BY 1"))
    def _(spark, d):
        return profile.largest_first(profile.counts_by(build(B.rows(spark, d)), column))


_count_query("d14_count_by_category", "visitor_category", "visitor_category", lambda r: r)
_count_query("d14_count_by_resource_type", "reqresourcetype", "reqresourcetype", lambda r: r)
_count_query("d14_count_by_response_class", "response_class", "response_class", lambda r: r)


@query("d15_relative_frequency", "response_result:s count:l share:d",
       (B.ROWS, f"SELECT {_RESULT} AS response_result, count(*) AS count, count(*) / sum(count(*)) OVER () AS share FROM rows_ GROUP BY 1"))
def _(spark, d):
    rows = B.rows(spark, d).withColumn("response_result", P.response_result(F.col("response")))
    return profile.shares(written(profile.counts_by(rows, "response_result"), "counts"))


_DAY_HOUR = B.TYPED + """, per AS (SELECT CAST("timestamp" AS DATE) AS date, hour("timestamp") AS hour, count(*) AS req
  FROM typed WHERE "timestamp" IS NOT NULL GROUP BY 1, 2)"""


@query("d16_count_by_day_hour", "date:D hour:i req:l", (_DAY_HOUR, "SELECT * FROM per"))
def _(spark, d):
    return profile.counts_by_day_hour(B.typed(spark, d))


@query("d17_hour_by_date", "hour:i date:s req:l",
       (_DAY_HOUR + ", days AS (SELECT DISTINCT date FROM per), hours AS (SELECT DISTINCT hour FROM per)",
        "SELECT h.hour, strftime(y.date, '%Y-%m-%d') AS date, req FROM hours h CROSS JOIN days y "
        "LEFT JOIN per p ON p.hour = h.hour AND p.date = y.date"))
def _(spark, d):
    # The table's columns are the dates of the data; its cells are shown one a row.
    table = profile.hour_by_date(written(profile.counts_by_day_hour(B.typed(spark, d)), "counts"))
    return table.unpivot("hour", [c for c in table.columns if c != "hour"], "date", "req")


@query("d18_outlier_fence", "split:s q1:d q3:d fence:d", (FENCE, "SELECT * FROM fences"))
def _(spark, d):
    return profile.outlier_fence(B.typed(spark, d))


_SIZED = FENCE + """, sized AS (SELECT t.*, fence FROM typed t JOIN fences USING (split) WHERE bytes > 0),
parted AS (SELECT *, bytes <= fence AS part FROM sized),
counted AS (SELECT split, part, bytes, count(*) AS n FROM parted GROUP BY split, part, bytes),
modes AS (SELECT split, part, min(bytes) AS mode FROM (SELECT *, max(n) OVER (PARTITION BY split, part) AS most FROM counted)
  WHERE n = most GROUP BY split, part)"""


@query("d19_size_summary", "split:s normal:b mean:d median:d mode:d max:d",
       (_SIZED, "SELECT split, part AS normal, avg(bytes) AS mean, median(bytes) AS median, any_value(mode) AS mode, max(bytes) AS max "
        "FROM parted JOIN modes USING (split, part) GROUP BY split, part"))
def _(spark, d):
    sized = profile.with_fence(B.typed(spark, d)).where(F.col("bytes") > 0)
    return profile.summary(sized.withColumn("normal", F.col("bytes") <= F.col("fence")), keys=("split", "normal"))


@query("d20_histogram", "split:s bin:i count:l",
       (_SIZED + """, ends AS (SELECT split, min(CAST(round(bytes * 1000) AS BIGINT)) AS lo, max(CAST(round(bytes * 1000) AS BIGINT)) AS hi
          FROM sized WHERE bytes <= fence GROUP BY split)""",
        "SELECT split, least((CAST(round(bytes * 1000) AS BIGINT) - lo) * 100 // (hi - lo), 99) AS bin, count(*) AS count "
        "FROM sized JOIN ends USING (split) WHERE bytes <= fence GROUP BY ALL"))
def _(spark, d):
    sized = profile.with_fence(B.typed(spark, d)).where((F.col("bytes") > 0) & (F.col("bytes") <= F.col("fence")))
    return profile.histogram(sized.withColumn("size", F.round(F.col("bytes") * 1000)), "size")


@query("d21_outlier_counts", "split:s bytes:d count:l",
       (FENCE, "SELECT split, bytes, count(*) AS count FROM typed JOIN fences USING (split) WHERE bytes > fence GROUP BY ALL"))
def _(spark, d):
    return profile.counts_by(profile.with_fence(B.typed(spark, d)).where(F.col("bytes") > F.col("fence")), "split", "bytes")


def _corr_sql(source, columns):
    parts = []
    for i, a in enumerate(columns):
        for b in columns[i + 1:]:
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, CASE WHEN min({a}) FILTER ({b} IS NOT NULL) < max({a}) FILTER ({b} IS NOT NULL) "
                         f"AND min({b}) FILTER ({a} IS NOT NULL) < max({b}) FILTER ({a} IS NOT NULL) THEN corr({a}, {b}) END AS corr FROM {source}")
    return " UNION ALL ".join(parts)


@query("d22_row_correlations", "col_a:s col_b:s corr:d",
       (B.FILLED + f""", named AS (SELECT *, {_TYPE} AS visitor_type, CASE WHEN visitor_category = 'country' THEN tld ELSE 'non_country' END AS c FROM filled),
kept AS (SELECT c FROM named WHERE c <> 'non_country' GROUP BY c ORDER BY count(*) DESC, c LIMIT 15),
topped AS (SELECT *, CASE WHEN c IN (SELECT c FROM kept) THEN c ELSE 'other_country' END AS country FROM named),
dated AS MATERIALIZED (SELECT *, hour("timestamp") AS hour, CAST(isodow("timestamp") >= 6 AS INTEGER) AS is_weekend,
  count(*) OVER (PARTITION BY visitor_type) / count(*) OVER () AS visitor_type_freq,
  count(*) OVER (PARTITION BY country) / count(*) OVER () AS country_freq FROM topped)""",
        _corr_sql("dated", V.ROW_CORRELATION_COLUMNS)))
def _(spark, d):
    return profile.correlations(profile.correlation_rows(B.rows(spark, d)), V.ROW_CORRELATION_COLUMNS)


@query("d22_bucket_correlations", "col_a:s col_b:s corr:d",
       (B.prepared_sql() + ", known AS MATERIALIZED (SELECT * FROM prepared WHERE y_req_t1 IS NOT NULL)",
        _corr_sql("known", V.BUCKET_CORRELATION_COLUMNS)))
def _(spark, d):
    table = features.sequence_table(B.traffic(spark, d), "15m")
    return profile.correlations(table, V.BUCKET_CORRELATION_COLUMNS)


BOX = "category:s n:l q1:d median:d q3:d whisker_low:d whisker_high:d"


def _box_query(name, ctes, source, category, value, build):
    sql = (ctes + f""", boxes AS (SELECT {category} AS c, count(*) AS n, quantile_cont({value}, 0.25) AS q1,
        quantile_cont({value}, 0.5) AS median, quantile_cont({value}, 0.75) AS q3 FROM {source} GROUP BY 1)""",
        f"SELECT CAST(c AS VARCHAR) AS category, n, q1, median, q3, min({value}) AS whisker_low, max({value}) AS whisker_high "
        f"FROM boxes JOIN {source} ON {category} = c WHERE {value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL")

    @query(name, BOX, sql)
    def _(spark, d):
        return profile.box_summary(build(spark, d), category, value)


_POSITIVE = B.ROWS + ", positive AS (SELECT * FROM rows_ WHERE bytes > 0), known AS (SELECT * FROM rows_ WHERE bytes IS NOT NULL)"
_positive = lambda spark, d: B.rows(spark, d).where(F.col("bytes") > 0)
_box_query("d23_bytes_by_method", _POSITIVE, "positive", "reqmethod", "bytes", _positive)
_box_query("d23_bytes_by_resource_type", _POSITIVE, "positive", "reqresourcetype", "bytes", _positive)
_box_query("d23_bytes_by_response", _POSITIVE, "known", "response", "bytes", B.rows)
_box_query("d23_requests_by_hour", B.traffic_sql(), "traffic", "hour", "y_req", B.traffic)
_DATED = B.FILLED + """, dated AS (SELECT *, hour("timestamp") AS hour, isodow("timestamp") - 1 AS weekday FROM filled)"""
_dated = lambda spark, d: B.filled(spark, d).withColumns(times.calendar(F.col("timestamp")))
_box_query("d23_bytes_by_hour", _DATED, "dated", "hour", "bytes_imputed", _dated)
_box_query("d23_bytes_by_weekday", _DATED, "dated", "weekday", "bytes_imputed", _dated)

COUNTED = ["host", "timestamp", "request", "response", "bytes", "tld", "reqdirectory"]


def _per_column(expr):
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {expr.format(c=c)} FROM rows_" for c in COUNTED)


@query("d24_null_counts", "column:s nulls:l", (B.ROWS, _per_column('count(*) - count("{c}") AS nulls')))
def _(spark, d):
    return profile.null_counts(B.rows(spark, d), COUNTED)


@query("d25_distinct_counts", "column:s distinct_values:l", (B.ROWS, _per_column('count(DISTINCT "{c}") AS distinct_values')))
def _(spark, d):
    return profile.distinct_counts(B.rows(spark, d), COUNTED)


@query("d26_trend_on_sample", "slope:d intercept:d n:l",
       (B.FILLED, f"SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, count(*) AS n FROM (SELECT CAST(reqpathdepth AS DOUBLE) AS x, bytes_imputed AS y "
        f"FROM filled ORDER BY md5(event_id || ':{V.SAMPLE_SEED}'), event_id LIMIT {V.SAMPLE_ROWS})"))
def _(spark, d):
    return profile.trend(profile.fixed_sample(B.filled(spark, d), "event_id"), "reqpathdepth", "bytes_imputed")


_STATUS = B.ROWS + f""", s AS (SELECT CASE WHEN response_class = 'client error' THEN 'client error'
  WHEN response_class = 'server error' THEN 'server error' ELSE 'success' END AS subset, {_PHRASE} AS response_status
  FROM rows_ WHERE {_RESULT} = 'success' OR response_class IN ('client error', 'server error'))"""


@query("d27_status_by_subset", "subset:s response_status:s count:l share:d",
       (_STATUS, "SELECT *, count / sum(count) OVER (PARTITION BY subset) AS share FROM (SELECT subset, response_status, count(*) AS count FROM s GROUP BY 1, 2)"))
def _(spark, d):
    rows = B.rows(spark, d).withColumns({
        "response_status": P.response_status(F.col("response")),
        "response_result": P.response_result(F.col("response")),
    })
    subset = F.when(F.col("response_class").isin("client error", "server error"), F.col("response_class")).when(
        F.col("response_result") == "success", F.lit("success"))
    return profile.shares(profile.counts_by(rows.withColumn("subset", subset), "subset", "response_status"), keys=["subset"])


# --- top lists --------------------------------------------------------------

@query("o2_top_resources", "requrl:s count:l",
       (B.ROWS, "SELECT requrl, count(*) AS count FROM rows_ WHERE reqresourcetype NOT IN ('Image', 'Directory') "
        "GROUP BY requrl ORDER BY count DESC, requrl LIMIT 20"))
def _(spark, d):
    return profile.top_resources(B.rows(spark, d))


@query("o3_top_directories", "reqdirectory:s count:l",
       (PAGES, "SELECT reqdirectory, count(*) AS count FROM asked GROUP BY 1 ORDER BY count DESC, reqdirectory LIMIT 20"))
def _(spark, d):
    return profile.top_directories(B.page_requests(spark, d))


@query("o4_top_countries", "visitor_country:s count:l",
       (_NAMED, "SELECT c AS visitor_country, count(*) AS count FROM named WHERE c <> 'non_country' GROUP BY c ORDER BY count DESC, c LIMIT 15"))
def _(spark, d):
    named = H.visitor_country(F.col("visitor_category"), F.col("tld"), V.NON_COUNTRY)
    return profile.top_countries(B.rows(spark, d).withColumn("visitor_country", named))
