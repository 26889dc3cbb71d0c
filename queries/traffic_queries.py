"""Buckets, rates, diversity, grids and feature columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import base as B
from queries.base import query
from trafficlens import fixed_values as V
from trafficlens.functions import times
from trafficlens.operators import buckets, enrich, features, folds, series as S
from trafficlens.operators.quantiles import exact_quantiles, merged_sketches, quantile_sketches, sketched_quantiles
from trafficlens.session import lookup, work_path

AT = "split:s timestamp:t "
TRAFFIC_TYPES = (
    AT + "y_req:l y_bytes_imp:d bytes_missing_rate:d bytes_all_missing:i error_rate:d server_error_rate:d "
    "redirection_rate:d dynamic_rate:d commercial_rate:d unknown_rate:d avg_path_depth:d country_nunique:l "
    "dir_nunique:l method_nunique:l top_country_share:d endpoint_entropy:d ratio_heavy:d ratio_image:d "
    "ratio_get:d ratio_post:d hour:i weekday:i is_weekend:i"
)


@query("d1_tumbling_bucket", AT + "n:l",
       (B.TYPED, "SELECT split, time_bucket(INTERVAL '10 minutes', \"timestamp\") AS \"timestamp\", count(*) AS n "
        "FROM typed WHERE \"timestamp\" IS NOT NULL GROUP BY 1, 2"))
def _(spark, d):
    start = times.bucket_start(F.col("timestamp"), 10).alias("timestamp")
    return B.typed(spark, d).groupBy("split", start).agg(F.count("*").alias("n"))


def _traffic_query(name, columns, freq="15m"):
    @query(name, AT + columns, (B.traffic_sql(freq), "SELECT * FROM traffic"))
    def _(spark, d):
        return B.traffic(spark, d, freq)


_traffic_query("d2_requests", "y_req:l")
_traffic_query("d3_bytes", "y_bytes_imp:d")
_traffic_query("d4_missing_rate", "bytes_missing_rate:d")
_traffic_query("d5_all_missing", "bytes_all_missing:i")
_traffic_query("d6_error_rates", "error_rate:d server_error_rate:d redirection_rate:d")
_traffic_query("d7_mix_rates", "dynamic_rate:d commercial_rate:d unknown_rate:d ratio_heavy:d ratio_image:d ratio_get:d ratio_post:d")
_traffic_query("d8_path_depth", "avg_path_depth:d")
_traffic_query("d9_distinct_counts", "country_nunique:l dir_nunique:l method_nunique:l")
_traffic_query("d11_top_country_share", "top_country_share:d")
_traffic_query("d12_endpoint_entropy", "endpoint_entropy:d")
_traffic_query("d13_table_5m", TRAFFIC_TYPES.removeprefix(AT), "5m")
_traffic_query("d13_table_1m", TRAFFIC_TYPES.removeprefix(AT), "1m")
_traffic_query("t4_calendar", "hour:i weekday:i is_weekend:i")


@query("d10_median_by_response", "split:s response:i median_bytes:d", (B.FILLED, "SELECT * FROM med"))
def _(spark, d):
    return enrich.code_medians(B.rows(spark, d))


def _all_freqs_sql():
    parts = []
    ctes = ""
    for freq in V.FREQ_MINUTES:
        body = B.traffic_sql(freq)
        parts.append(f"SELECT '{freq}' AS freq, * FROM (WITH {body} SELECT * FROM traffic)")
    return ctes, " UNION ALL ".join(parts)


@query("d13_all_frequencies", "freq:s " + TRAFFIC_TYPES, _all_freqs_sql())
def _(spark, d):
    return buckets.bucket_tables(B.rows(spark, d))


@query("t1_dense_grid", "split:s timestamp:t requests:l",
       (B.TYPED + """, per AS (SELECT split, time_bucket(INTERVAL '10 minutes', "timestamp") AS b, count(*) AS n FROM typed
          WHERE "timestamp" IS NOT NULL GROUP BY 1, 2),
        grid AS (SELECT split, unnest(generate_series(min(b), max(b), INTERVAL '10 minutes')) AS b FROM per GROUP BY split)""",
        "SELECT grid.split, grid.b AS \"timestamp\", coalesce(n, 0) AS requests FROM grid LEFT JOIN per USING (split, b)"))
def _(spark, d):
    return buckets.requests_per(B.typed(spark, d), 10)


@query("t1_empty_runs", "split:s first:t last:t buckets:l",
       (B.TYPED + """, per AS (SELECT DISTINCT split, time_bucket(INTERVAL '2 minutes', "timestamp") AS b FROM typed WHERE "timestamp" IS NOT NULL),
        nexts AS (SELECT split, b, lead(b) OVER (PARTITION BY split ORDER BY b) AS c FROM per)""",
        """SELECT split, b + INTERVAL 2 MINUTE AS "first", c - INTERVAL 2 MINUTE AS "last", date_diff('minute', b, c) / 2 - 1 AS buckets
        FROM nexts WHERE c > b + INTERVAL 2 MINUTE"""))
def _(spark, d):
    return buckets.empty_runs(B.typed(spark, d), 2)


# A customer's orders are a sparse series: a year without one sets the smaller part aside.
_ORDER_PARTS = """placed AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL),
cuts AS (SELECT *, CASE WHEN day - lag(day) OVER w > 366 THEN 1 ELSE 0 END AS cut FROM placed WINDOW w AS (PARTITION BY o_custkey ORDER BY day)),
numbered AS (SELECT *, sum(cut) OVER (PARTITION BY o_custkey ORDER BY day) AS part FROM cuts),
parts AS (SELECT o_custkey, part, min(day) AS lo, max(day) AS hi, sum(n) AS n FROM numbered GROUP BY ALL),
chosen AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, lo) AS place, sum(n) OVER (PARTITION BY o_custkey) AS total FROM parts)"""


def _orders(spark, d):
    return B.table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("timestamp_ntz").alias("timestamp"))


@query("t1_series_spans", "o_custkey:l first:t last:t rows:l rows_set_aside:l",
       (_ORDER_PARTS, 'SELECT o_custkey, lo AS "first", hi AS "last", n AS "rows", total - n AS rows_set_aside FROM chosen WHERE place = 1'))
def _(spark, d):
    return buckets.series_spans(_orders(spark, d), 1440, ("o_custkey",), 365)


@query("t1_grid_within_reach", "o_custkey:l days:l empty:l orders:l",
       (_ORDER_PARTS + """, days AS (SELECT o_custkey, unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL '1 day')) AS day FROM chosen WHERE place = 1)""",
        """SELECT o_custkey, count(*) AS days, count(*) FILTER (n IS NULL) AS empty, sum(n) AS orders
        FROM days LEFT JOIN placed USING (o_custkey, day) GROUP BY o_custkey"""))
def _(spark, d):
    daily = buckets.requests_per(_orders(spark, d), 1440, ("o_custkey",), 365)
    return daily.groupBy("o_custkey").agg(
        F.count("*").alias("days"), F.count_if(F.col("requests") == 0).alias("empty"), F.sum("requests").alias("orders"))


@query("d13_table_of_parts", TRAFFIC_TYPES, (B.traffic_sql("15m"), "SELECT * FROM traffic"))
def _(spark, d):
    """Cells of two halves of the log, added one after the other."""
    store, rows = work_path(spark, "cell-store"), B.rows(spark, d)
    early = F.coalesce(F.hour("timestamp") < 12, F.lit(True))
    buckets.add_to_cells(rows.where(early), store, "morning")
    buckets.add_to_cells(rows.where(~early), store, "evening")
    return buckets.tables_of_cells(buckets.cells_in(spark, store), ("15m",)).drop("freq")


@query("d10_continuous_quantiles", "l_returnflag:s n:l q1:d median_price:d q99:d",
       ("priced AS (SELECT l_returnflag, CAST(l_extendedprice AS DOUBLE) * (1 - CAST(l_discount AS DOUBLE)) * (1 + CAST(l_tax AS DOUBLE)) / CAST(l_quantity AS DOUBLE) AS price FROM lineitem)",
        "SELECT l_returnflag, count(price) AS n, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median_price, quantile_cont(price, 0.99) AS q99 FROM priced GROUP BY ALL"))
def _(spark, d):
    """Nearly every value its own, half of them in one group."""
    priced = _priced(spark, d)
    return exact_quantiles(priced, "price", {"q1": 0.25, "median_price": 0.5, "q99": 0.99}, ["l_returnflag"])


def _priced(spark, d):
    price = F.col("l_extendedprice").cast("double") * (1 - F.col("l_discount").cast("double")) * (1 + F.col("l_tax").cast("double"))
    return B.table(spark, d, "lineitem").select("l_returnflag", "l_linenumber", (price / F.col("l_quantity").cast("double")).alias("price"))


@query("d10_sketched_quantiles", "l_returnflag:s n:l q1_near:b median_near:b q99_near:b",
       ("", "SELECT l_returnflag, count(*) AS n, true AS q1_near, true AS median_near, true AS q99_near FROM lineitem WHERE l_quantity <> 0 GROUP BY ALL"))
def _(spark, d):
    """Sketches per line number merged per flag; a sketched value is near if its exact rank,
    counted over all rows, is within 2.5 % of the wanted one."""
    probs, priced = {"q1": 0.25, "median": 0.5, "q99": 0.99}, _priced(spark, d)
    parts = quantile_sketches(priced, "price", ["l_returnflag", "l_linenumber"])
    found = sketched_quantiles(merged_sketches(parts, ["l_returnflag"]), probs, ["l_returnflag"])
    ranks = priced.join(lookup(found, "sketched"), "l_returnflag").groupBy("l_returnflag", "n").agg(
        *(F.avg((F.col("price") <= F.col(name)).cast("int")).alias(name) for name in probs))
    return ranks.select("l_returnflag", "n", *((F.abs(F.col(name) - p) <= 0.025).alias(f"{name}_near") for name, p in probs.items()))


@query("j7_grid_join", "split:s empty:l filled:l",
       (B.traffic_sql("1m"), "SELECT split, count(*) FILTER (y_req = 0) AS empty, count(*) FILTER (y_req > 0) AS filled FROM traffic GROUP BY split"))
def _(spark, d):
    return B.traffic(spark, d, "1m").groupBy("split").agg(
        F.count_if(F.col("y_req") == 0).alias("empty"), F.count_if(F.col("y_req") > 0).alias("filled")
    )


def _prepared_query(name, columns, build, sql="SELECT * FROM prepared"):
    @query(name, AT + columns, (B.prepared_sql(), sql))
    def _(spark, d):
        return build(B.traffic(spark, d))


_prepared_query("t2_gap_flag", "flag_data_gap:i", features.flag_gaps)
_prepared_query("t3_filled_depth", "avg_path_depth:d flag_data_gap:i",
                lambda t: features.fill_depth(features.flag_gaps(t)))
_prepared_query("t5_cyclical_time", "sin_hour:d cos_hour:d sin_weekday:d cos_weekday:d", features.add_cyclical_time)
_prepared_query("t6_next_targets", "y_req:l y_req_t1:l y_bytes_imp_t1:d",
                lambda t: features.add_targets(t, "15m"), "SELECT * FROM prepared WHERE y_req_t1 IS NOT NULL")
_prepared_query("t7_gap_mask", "y_req:d y_bytes_imp:d bytes_missing_rate:d error_rate:d top_country_share:d endpoint_entropy:d",
                lambda t: features.mask_gaps(features.flag_gaps(t)), "SELECT * FROM masked")
_prepared_query("t8_payload", "avg_payload:d", features.add_payload)


def _history_query(name, names, freq="15m"):
    """Some history columns of one frequency; the rest is never computed."""
    types = " ".join(f"{n}:d" for n in names)

    @query(name, AT + types, (B.ml_sql(freq), "SELECT * FROM ml"))
    def _(spark, d):
        return B.ml(spark, d, freq)


def _named(freq, *marks):
    return [n for n in B.history_names(freq) if any(m in n for m in marks)]


_history_query("t9_lags", _named("15m", "_lag"))
_history_query("t10_rolling_means", _named("15m", "_rmean"))
_history_query("t11_rolling_deviations", _named("15m", "_rstd"))
_history_query("t12_velocity", _named("15m", "_vel"))
_history_query("t13_acceleration", _named("15m", "_acc"))

ML_HEAD = AT + "y_req_t1:l y_bytes_imp_t1:d y_req:l y_bytes_imp:d avg_payload:d flag_data_gap:i "


def _ml_query(name, freq):
    types = " ".join(f"{n}:d" for n in B.history_names(freq))

    @query(name, ML_HEAD + types.replace(":d", ":f"), (B.ml_sql(freq), "SELECT * FROM ml"))
    def _(spark, d):
        return B.ml(spark, d, freq)


_ml_query("t13_features_1m", "1m")
_ml_query("t13_features_5m", "5m")
_ml_query("t13_features_15m", "15m")


@query("t4_row_calendar", "event_id:l hour:i day:i weekday:i month:i is_weekend:i",
       (B.TYPED, "SELECT event_id, hour(\"timestamp\") AS hour, day(\"timestamp\") AS day, isodow(\"timestamp\") - 1 AS weekday, "
        "month(\"timestamp\") AS month, CAST(isodow(\"timestamp\") >= 6 AS INTEGER) AS is_weekend FROM typed"))
def _(spark, d):
    return B.typed(spark, d).select("event_id", *(
        c.alias(name) for name, c in times.row_calendar(F.col("timestamp")).items()
    ))


@query("t14_short_history", AT + "y_req:l y_req_lag_1:l y_req_lag_2:l y_req_lag_3:l y_req_rolling_mean_3:d flag_data_gap:i",
       (B.prepared_sql() + """, lagged AS (SELECT *, lag(y_req, 1) OVER w AS y_req_lag_1, lag(y_req, 2) OVER w AS y_req_lag_2,
          lag(y_req, 3) OVER w AS y_req_lag_3, avg(y_req) OVER (PARTITION BY split ORDER BY "timestamp" ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS y_req_rolling_mean_3
          FROM prepared WINDOW w AS (PARTITION BY split ORDER BY "timestamp"))""",
        "SELECT * FROM lagged WHERE y_req_lag_3 IS NOT NULL"))
def _(spark, d):
    return features.short_history(features.prepared(B.traffic(spark, d)), "15m")


@query("t15_sequence_table", AT + "y_req_t1:l y_req:l endpoint_entropy:d sin_hour:d flag_data_gap:i avg_payload:d",
       (B.prepared_sql("5m"), "SELECT * FROM prepared WHERE y_req_t1 IS NOT NULL"))
def _(spark, d):
    return features.sequence_table(B.traffic(spark, d, "5m"), "5m")


@query("t16_recent_mean", AT + "recent:d",
       (B.traffic_sql(), "SELECT split, \"timestamp\", CASE WHEN row_number() OVER (PARTITION BY split ORDER BY \"timestamp\") >= 5 THEN "
        "avg(y_req) OVER (PARTITION BY split ORDER BY \"timestamp\" ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS recent FROM traffic"))
def _(spark, d):
    def recent(frame):
        last = S.trailing(V.STABLE_ROWS, frame)
        return {"recent": F.when(F.count(F.lit(1)).over(last) == V.STABLE_ROWS, F.avg("y_req").over(last))}

    return S.over_blocks(B.traffic(spark, d), features.place("15m"), ("split",), 4, 0, recent)


@query("t17_expanding_folds", AT + "rn:l n:l fold:i",
       (B.ml_sql("15m", ("y_req",)) + """, numbered AS (SELECT split, "timestamp", row_number() OVER (PARTITION BY split ORDER BY "timestamp") - 1 AS rn,
          count(*) OVER (PARTITION BY split) AS n FROM ml)""",
        "SELECT *, CASE WHEN rn >= n - 5 * (n // 6) THEN (rn - (n - 5 * (n // 6))) // (n // 6) ELSE -1 END AS fold FROM numbered"))
def _(spark, d):
    return folds.add_fold(B.ml(spark, d), keys=("split",))


@query("o1_sorted_table", AT + "y_req:l", (B.traffic_sql(), "SELECT * FROM traffic"))
def _(spark, d):
    return B.traffic(spark, d).orderBy("split", "timestamp")
