"""Query registry, shared inputs, and the SQL twins of those inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from trafficlens import fixed_values as V
from trafficlens.operators import buckets, combine, enrich, features, parse
from trafficlens.plans.traffic import rows_of
from trafficlens.session import spread, written
from trafficlens.sources import events as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SQL_TYPES = {"l": "BIGINT", "i": "INTEGER", "s": "VARCHAR", "t": "TIMESTAMP", "D": "DATE", "b": "BOOLEAN"}
SPARK_TYPES = {"l": "bigint", "i": "int", "s": "string", "t": "timestamp_ntz", "D": "date", "b": "boolean"}


def _pairs(types: str) -> list[tuple[str, str]]:
    return [tuple(item.rsplit(":", 1)) for item in types.split()]


# Doubles are shown to six places (d). The mean of a few short decimals often lies exactly
# between two such numbers, and the last bit of the sum, which depends on the order of
# its terms, would decide; such columns are shown to 20 binary places instead (f).
GRID = float(2**20)


def shown(df: DataFrame, types: str) -> DataFrame:
    """The named columns in fixed types; doubles to six places, no negative zero."""
    out = []
    for name, kind in _pairs(types):
        c = F.col(f"`{name}`")
        if kind == "d":
            out.append((F.round(c.cast("double"), 6) + F.lit(0.0)).alias(name))
        elif kind == "f":
            out.append((F.round(c.cast("double") * GRID, 0) / GRID + F.lit(0.0)).alias(name))
        else:
            out.append(c.cast(SPARK_TYPES[kind]).alias(name))
    return df.select(*out)


def shown_sql(types: str) -> str:
    out = []
    for name, kind in _pairs(types):
        if kind == "f":
            out.append(f'round(CAST("{name}" AS DOUBLE) * {GRID}, 0) / {GRID} + 0.0 AS "{name}"')
        elif kind == "d":
            out.append(f'round(CAST("{name}" AS DOUBLE), 6) + 0.0 AS "{name}"')
        else:
            out.append(f'CAST("{name}" AS {SQL_TYPES[kind]}) AS "{name}"')
    return ", ".join(out)


def query(name: str, types: str, sql: tuple[str, str] | None = None):
    """Register a query; ``sql`` is (common table expressions, select)."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shown(fn(spark, sf_dir), types)

        QUERIES[name] = run
        if sql is not None:
            ctes, select = sql
            head = f"WITH {ctes}" if ctes else "WITH none AS (SELECT 1)"
            ORACLES[name] = f"{head} SELECT {shown_sql(types)} FROM ({select}) AS result"
        return fn

    return wrap


# --- Spark inputs -----------------------------------------------------------

def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark, sf_dir) -> DataFrame:
    return E.requests_from_events(spread(table(spark, sf_dir, "events")))


def parsed(spark, sf_dir) -> DataFrame:
    return parse.parse_lines(lines(spark, sf_dir))


def typed(spark, sf_dir) -> DataFrame:
    return parse.apply_types(parsed(spark, sf_dir))


def rows(spark, sf_dir) -> DataFrame:
    return rows_of(lines(spark, sf_dir))


def filled(spark, sf_dir) -> DataFrame:
    return enrich.add_bytes_imputed(rows(spark, sf_dir))


def page_requests(spark, sf_dir) -> DataFrame:
    """A request text for each crawled page."""
    request = F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.0")).alias("request")
    return enrich.add_request_features(table(spark, sf_dir, "pages").select("page_id", request))


def traffic(spark, sf_dir, freq="15m") -> DataFrame:
    return buckets.bucket_table(rows(spark, sf_dir), freq).drop("freq")


def ml(spark, sf_dir, freq="15m", complete=False) -> DataFrame:
    return features.feature_table(traffic(spark, sf_dir, freq), freq, complete=complete)


def service_rows(spark, sf_dir) -> DataFrame:
    """Rows of several services: the event type names the service."""
    source = E.requests_from_events(spread(table(spark, sf_dir, "events")), "event_type")
    return rows_of(source.withColumnRenamed("event_type", "series"))


def service_forecasts(spark, sf_dir, freq="15m") -> tuple[DataFrame, DataFrame]:
    """The simplest forecast per service: the next bucket will be like this one."""
    keys = ("series",)
    tables = buckets.bucket_table(service_rows(spark, sf_dir), freq, keys).drop("freq")
    kept = features.add_targets(features.flag_gaps(tables), freq, keys)
    kept = written(kept.where(F.col(V.GAP_FLAG) == 0), "forecasts")

    def one(column):
        return kept.select(
            "series", "timestamp", F.col(f"{column}_t1").cast("double").alias("actual"),
            F.col(column).cast("double").alias("predicted"),
        )

    return one("y_req"), one("y_bytes_imp")


def joined_forecasts(spark, sf_dir, freq="15m") -> DataFrame:
    return combine.join_forecasts(*service_forecasts(spark, sf_dir, freq))


def split_forecasts(spark, sf_dir) -> DataFrame:
    """Actual and predicted requests per split, from the feature table."""
    kept = ml(spark, sf_dir)
    return kept.select(
        "split", "timestamp", F.col("y_req_t1").cast("double").alias("actual"),
        F.col("y_req").cast("double").alias("predicted"),
    )


# --- SQL inputs -------------------------------------------------------------

def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def case(key: str, table_: dict, default: str) -> str:
    whens = " ".join(f"WHEN {k!r} THEN '{v}'" for k, v in table_.items())
    return f"CASE {key} {whens} ELSE {default} END"


_PAT = V.LOG_PATTERN
LINES = f"""
drawn AS (SELECT *,
  CASE user_id % 10 WHEN 0 THEN '10.0.' || user_id || '.1'
    WHEN 1 THEN 'u' || user_id || '.example.com' WHEN 2 THEN 'u' || user_id || '.example.COM'
    WHEN 3 THEN 'u' || user_id || '.edu' WHEN 4 THEN 'u' || user_id || '.net'
    WHEN 8 THEN 'u' || user_id || '.info' WHEN 9 THEN 'localhost' || user_id
    ELSE 'u' || user_id || '.' || {list(E.COUNTRIES)!r}[((user_id // 10) * (user_id // 10) + user_id % 10) % {len(E.COUNTRIES)} + 1] END AS host,
  CASE event_type WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'PUT' WHEN 'error' THEN 'BREW' ELSE 'GET' END AS method,
  '/' || event_type || repeat('/s', event_id % 4) || '/d' || (event_id % 7) || '/r' || (event_id % 13) ||
    CASE event_id % 8 WHEN 0 THEN '.gif' WHEN 1 THEN '.html' WHEN 2 THEN '.pl' WHEN 3 THEN '.mpg'
      WHEN 4 THEN '.txt' WHEN 5 THEN '.xyz' WHEN 7 THEN '.JPG' ELSE '' END AS url,
  CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN '404' WHEN 1 THEN '500' ELSE '403' END
    WHEN event_id % 9 = 0 THEN '304' WHEN event_id % 9 = 1 THEN '302' ELSE '200' END AS status,
  CASE WHEN event_id % 11 = 0 OR event_id % 9 = 0 THEN '-'
    ELSE CAST(CAST(floor(value * 1000) AS BIGINT) AS VARCHAR) END AS size
  FROM events),
lines AS (SELECT event_id, event_type AS series,
  CASE WHEN ts < TIMESTAMP '2024-01-22 00:00:00' THEN 'train' ELSE 'test' END AS split,
  CASE WHEN event_id % 101 = 0 THEN 'truncated line' ELSE
    host || ' - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' -0400] "' || method || ' ' || url ||
    ' HTTP/1.0" ' || status || ' ' || size END AS value
  FROM drawn)"""

PARSED = LINES + f""",
matched AS (SELECT event_id, series, split, value,
  regexp_extract(value, '{_PAT}', ['host', 'ts', 'request', 'response', 'size']) AS m
  FROM lines WHERE regexp_matches(value, '{_PAT}')),
parsed AS (SELECT event_id, series, split, m.host AS host, m.ts AS "timestamp", m.request AS request,
  m.response AS response, TRY_CAST(m.size AS BIGINT) AS bytes, m.size AS size_text FROM matched)"""

TYPED = PARSED + f""",
typed AS (SELECT event_id, series, split, host,
  try_strptime(regexp_extract("timestamp", '{V.LOG_TIME_PATTERN}', 1), '%d/%b/%Y:%H:%M:%S') AS "timestamp",
  request, TRY_CAST(response AS INTEGER) AS response, bytes / 1000.0 AS bytes FROM parsed)"""


def request_sql(source: str, out: str) -> str:
    """Request columns of ``source`` as table ``out``."""
    return f""",
{out}_1 AS (SELECT *, split_part(request, ' ', 1) AS word,
  CASE WHEN strpos(request, ' ') = 0 THEN 'UNKNOWN' ELSE split_part(request, ' ', 2) END AS requrl FROM {source}),
{out}_2 AS (SELECT *, trim(replace(requrl, 'HTTP/1.0', '')) AS clean,
  CASE WHEN word IN ({quoted(V.HTTP_METHODS)}) THEN word ELSE 'UNKNOWN' END AS reqmethod FROM {out}_1),
{out}_3 AS (SELECT *,
  CASE WHEN contains(clean, '/') THEN regexp_extract(clean, '^(.*/)', 1, 's') ELSE requrl END AS reqdirectory,
  CASE WHEN contains(clean, '/') THEN regexp_extract(clean, '([^/]*)$', 1, 's') ELSE '' END AS reqresource FROM {out}_2),
{out}_4 AS (SELECT *, lower(regexp_extract(reqresource, '([^.]*)$', 1, 's')) AS ext FROM {out}_3),
{out} AS (SELECT * EXCLUDE (word, clean, ext),
  CASE WHEN NOT contains(reqresource, '.') THEN 'Directory' WHEN ext IN ({quoted(V.IMAGE_TYPES)}) THEN 'Image'
    WHEN ext IN ({quoted(V.AV_TYPES)}) THEN 'Audio/Video' WHEN ext IN ({quoted(V.FILE_TYPES)}) THEN 'File'
    WHEN ext IN ({quoted(V.PAGE_TYPES)}) THEN 'Page' ELSE 'UNKNOWN' END AS reqresourcetype,
  CASE WHEN reqdirectory = 'UNKNOWN' THEN -1 ELSE length(regexp_replace(reqdirectory, '[^/]', '', 'g')) END AS reqpathdepth,
  CASE WHEN ends_with(lower(reqresource), 'pl') OR ends_with(lower(reqresource), 'cgi')
    OR ends_with(lower(reqresource), 'perl') THEN 1 ELSE 0 END AS is_dynamic,
  length(requrl) AS requrllength FROM {out}_4)"""


ROWS = TYPED + """,
tlds AS (SELECT *, CASE WHEN contains(host, '.') AND NOT regexp_matches(host, '^\\d{1,3}(\\.\\d{1,3}){3}$')
  AND NOT regexp_matches(regexp_extract(host, '([^.]*)$', 1), '^[0-9]+$')
  THEN lower(regexp_extract(host, '([^.]*)$', 1)) END AS tld FROM typed),
kinds AS (SELECT *, CASE WHEN length(tld) = 2 THEN 'country' WHEN length(tld) = 3 THEN
  """ + case("tld", V.TLD_CATEGORIES, "'unknown'") + """ ELSE 'unknown' END AS visitor_category FROM tlds),
hosts AS (SELECT *, CASE WHEN visitor_category = 'country' THEN tld ELSE 'other_country' END AS visitor_country,
  CAST(visitor_category = 'commercial' AS INTEGER) AS is_commercial,
  CAST(visitor_category = 'unknown' AS INTEGER) AS is_unknown FROM kinds)""" + request_sql("hosts", "asked") + """,
rows_ AS (SELECT *, CAST(reqresourcetype IN ('Audio/Video', 'File') AS INTEGER) AS is_heavy,
  CAST(reqresourcetype = 'Image' AS INTEGER) AS is_image, CAST(reqmethod = 'GET' AS INTEGER) AS is_get,
  CAST(reqmethod = 'POST' AS INTEGER) AS is_post,
  """ + case("left(CAST(response AS VARCHAR), 1)", V.RESPONSE_CLASSES, "'unknown'") + """ AS response_class,
  CAST(bytes IS NULL AS INTEGER) AS bytes_missing FROM asked)"""

_CODES = "(r.response BETWEEN 200 AND 299 OR r.response BETWEEN 400 AND 599)"


def filled_sql(key: str = "split") -> str:
    return ROWS + f""",
med AS (SELECT {key}, response, quantile_cont(bytes, 0.5) AS median_bytes FROM rows_
  WHERE bytes IS NOT NULL AND response IS NOT NULL GROUP BY ALL),
filled AS (SELECT r.*, coalesce(r.bytes, CASE WHEN {_CODES} THEN coalesce(m.median_bytes, 0) END, 0) AS bytes_imputed
  FROM rows_ r LEFT JOIN med m ON m.{key} = r.{key} AND m.response = r.response)"""


FILLED = filled_sql()


def traffic_sql(freq: str = "15m", key: str = "split") -> str:
    m = V.FREQ_MINUTES[freq]
    zero = ", ".join(f"coalesce(a.{c}, 0) AS {c}" for c in (
        "y_req", "y_bytes_imp", "bytes_missing_rate", "bytes_all_missing", "error_rate",
        "server_error_rate", "redirection_rate", "dynamic_rate", "commercial_rate", "unknown_rate",
        "country_nunique", "dir_nunique", "method_nunique", "ratio_heavy", "ratio_image", "ratio_get", "ratio_post",
    ))
    return filled_sql(key) + f""",
slotted AS (SELECT *, time_bucket(INTERVAL '{m} minutes', "timestamp") AS bucket FROM filled WHERE "timestamp" IS NOT NULL),
agg AS (SELECT {key}, bucket, count(*) AS y_req, sum(bytes_imputed) AS y_bytes_imp,
  avg(bytes_missing) AS bytes_missing_rate, CAST(avg(bytes_missing) = 1.0 AS INTEGER) AS bytes_all_missing,
  avg(CASE WHEN response >= 400 THEN 1.0 ELSE 0.0 END) AS error_rate,
  avg(CASE WHEN response >= 500 THEN 1.0 ELSE 0.0 END) AS server_error_rate,
  avg(CASE WHEN response >= 300 AND response < 400 THEN 1.0 ELSE 0.0 END) AS redirection_rate,
  avg(is_dynamic) AS dynamic_rate, avg(is_commercial) AS commercial_rate, avg(is_unknown) AS unknown_rate,
  avg(reqpathdepth) AS avg_path_depth, count(DISTINCT visitor_country) AS country_nunique,
  count(DISTINCT reqdirectory) AS dir_nunique, count(DISTINCT reqmethod) AS method_nunique,
  avg(is_heavy) AS ratio_heavy, avg(is_image) AS ratio_image, avg(is_get) AS ratio_get, avg(is_post) AS ratio_post
  FROM slotted GROUP BY ALL),
per_dir AS (SELECT {key}, bucket, reqdirectory, count(*) AS n FROM slotted GROUP BY ALL),
ent AS (SELECT {key}, bucket, -sum(p * log2(p + 1e-12)) AS endpoint_entropy FROM
  (SELECT {key}, bucket, n / sum(n) OVER (PARTITION BY {key}, bucket) AS p FROM per_dir) GROUP BY ALL),
per_country AS (SELECT {key}, bucket, visitor_country, count(*) AS n FROM slotted GROUP BY ALL),
share AS (SELECT {key}, bucket, coalesce(max(CASE WHEN visitor_country <> 'other_country' THEN n END), 0) / sum(n)
  AS top_country_share FROM per_country GROUP BY ALL),
grid AS (SELECT {key}, unnest(generate_series(lo, hi, INTERVAL '{m} minutes')) AS "timestamp" FROM
  (SELECT {key}, min(bucket) AS lo, max(bucket) AS hi FROM agg GROUP BY ALL)),
traffic AS (SELECT g.{key}, g."timestamp", {zero}, a.avg_path_depth,
  coalesce(s.top_country_share, 0) AS top_country_share, coalesce(e.endpoint_entropy, 0) AS endpoint_entropy,
  hour(g."timestamp") AS hour, isodow(g."timestamp") - 1 AS weekday,
  CAST(isodow(g."timestamp") >= 6 AS INTEGER) AS is_weekend
  FROM grid g LEFT JOIN agg a ON a.{key} = g.{key} AND a.bucket = g."timestamp"
  LEFT JOIN ent e ON e.{key} = g.{key} AND e.bucket = g."timestamp"
  LEFT JOIN share s ON s.{key} = g.{key} AND s.bucket = g."timestamp")"""


def prepared_sql(freq: str = "15m", key: str = "split") -> str:
    return traffic_sql(freq, key) + f""",
prepared AS (SELECT * REPLACE (coalesce(avg_path_depth, 0) AS avg_path_depth),
  CAST(avg_path_depth IS NULL AS INTEGER) AS flag_data_gap,
  sin(2 * pi() * hour / 24.0) AS sin_hour, cos(2 * pi() * hour / 24.0) AS cos_hour,
  sin(2 * pi() * weekday / 7.0) AS sin_weekday, cos(2 * pi() * weekday / 7.0) AS cos_weekday,
  y_bytes_imp / (y_req + 1e-6) AS avg_payload,
  lead(y_req) OVER (PARTITION BY {key} ORDER BY "timestamp") AS y_req_t1,
  lead(y_bytes_imp) OVER (PARTITION BY {key} ORDER BY "timestamp") AS y_bytes_imp_t1 FROM traffic),
masked AS (SELECT * REPLACE ({", ".join(f"CASE WHEN flag_data_gap = 0 THEN {c} END AS {c}" for c in V.HISTORY_COLUMNS)})
  FROM prepared)"""


def history_names(freq: str) -> list[str]:
    out = [f"{c}_lag{n}" for c in V.HISTORY_COLUMNS for n in V.LAGS[freq]]
    out += [f"{c}_{f}{n}" for c in V.HISTORY_COLUMNS for n in V.WINDOWS[freq] for f in ("rmean", "rstd")]
    return out + [f"{c}_{f}" for c in V.HISTORY_COLUMNS for f in ("vel", "acc")]


def ml_sql(freq: str = "15m", columns=tuple(V.HISTORY_COLUMNS)) -> str:
    out = []
    for c in columns:
        out += [f"lag({c}, {n}) OVER w AS {c}_lag{n}" for n in V.LAGS[freq]]
        for n in V.WINDOWS[freq]:
            frame = f'OVER (PARTITION BY split ORDER BY "timestamp" ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)'
            out += [f"avg({c}) {frame} AS {c}_rmean{n}", f"stddev_samp({c}) {frame} AS {c}_rstd{n}"]
        one, two, three = (f"lag({c}, {n}) OVER w" for n in (1, 2, 3))
        out += [f"{one} - {two} AS {c}_vel", f"({one} - {two}) - ({two} - {three}) AS {c}_acc"]
    return prepared_sql(freq) + f""",
ml AS (SELECT * FROM (SELECT *, {", ".join(out)} FROM masked
  WINDOW w AS (PARTITION BY split ORDER BY "timestamp")) WHERE y_req_t1 IS NOT NULL AND flag_data_gap = 0)"""


def forecasts_sql(freq: str = "15m") -> str:
    return prepared_sql(freq, "series") + """,
joined AS (SELECT series, "timestamp", CAST(y_req_t1 AS DOUBLE) AS actual_req, CAST(y_req AS DOUBLE) AS predicted_req,
  y_bytes_imp_t1 AS actual_bytes, y_bytes_imp AS predicted_bytes FROM prepared
  WHERE flag_data_gap = 0 AND y_req_t1 IS NOT NULL)"""


def capacity_sql(freq: str = "15m") -> str:
    return forecasts_sql(freq) + f""",
caps AS (SELECT series, ceil(max(actual_req) / 3.5) AS cap_req, ceil(max(actual_bytes) / 3.5) AS cap_bytes
  FROM joined GROUP BY series),
stepped AS (SELECT j.*, cap_req, cap_bytes, row_number() OVER w - 1 AS step,
  avg(predicted_req) OVER (PARTITION BY j.series ORDER BY "timestamp" ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mean_req,
  avg(predicted_bytes) OVER (PARTITION BY j.series ORDER BY "timestamp" ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mean_bytes
  FROM joined j JOIN caps USING (series) WINDOW w AS (PARTITION BY j.series ORDER BY "timestamp")),
needs AS MATERIALIZED (SELECT *, greatest(ceil(predicted_req / (cap_req * 0.3)), ceil(predicted_bytes / (cap_bytes * 0.3)), 1) AS need,
  CASE WHEN step >= 4 THEN greatest(ceil(mean_req / (cap_req * 0.3)), ceil(mean_bytes / (cap_bytes * 0.3)), 1) END AS stable_need
  FROM stepped)"""


def decisions_sql(freq: str = "15m") -> str:
    """A row's servers cover the last five steps, its own among them."""
    return capacity_sql(freq) + f""",
decided AS (SELECT *, actual_req > servers * cap_req OR actual_bytes > servers * cap_bytes AS overload
  FROM (SELECT *, max(need) OVER (PARTITION BY series ORDER BY "timestamp"
    RANGE BETWEEN INTERVAL {4 * V.FREQ_MINUTES[freq]} MINUTE PRECEDING AND CURRENT ROW) AS servers FROM needs))"""


FORECASTS, CAPACITY, DECISIONS = forecasts_sql(), capacity_sql(), decisions_sql()
