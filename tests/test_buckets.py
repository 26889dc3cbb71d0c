"""Traffic tables against SQL, hand-made cases and invariants."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trafficlens import fixed_values as V
from trafficlens.operators import buckets, enrich, parse
from trafficlens.plans.traffic import rows_of

AT = "%d/%b/%Y:%H:%M:%S -0400"


def line(when, host="a.com", url="/x/y", code=200, size="1000", method="GET"):
    return f'{host} - - [{pd.Timestamp(when).strftime(AT)}] "{method} {url} HTTP/1.0" {code} {size}'


def as_rows(spark, lines, split="train"):
    return rows_of(spark.createDataFrame([(split, v) for v in lines], "split string, value string"))


def table(spark, lines, freq="1m"):
    return buckets.bucket_table(as_rows(spark, lines), freq).orderBy("timestamp").toPandas()


def test_gaps_and_edge_buckets(spark):
    lines = [
        line("1995-07-01 00:00:10", size="-"), line("1995-07-01 00:00:50", size="-"),   # all missing
        line("1995-07-01 00:01:00", host="a.uk", url="/p/q"), line("1995-07-01 00:01:59", host="a.de", url="/p/r"),
        line("1995-07-01 00:04:30", code=503), line("1995-07-01 00:04:31", code=304, size="-"),
        "junk", line("1995-07-01 00:04:32", code=200).replace("01/Jul", "31/Feb"),       # no time
    ]
    t = table(spark, lines)
    assert list(t.timestamp) == list(pd.date_range("1995-07-01", periods=5, freq="1min"))
    assert list(t.y_req) == [2, 2, 0, 0, 2]
    assert list(t.bytes_all_missing) == [1, 0, 0, 0, 0]
    assert list(t.error_rate) == [0, 0, 0, 0, 0.5]
    assert list(t.redirection_rate) == [0, 0, 0, 0, 0.5]
    assert list(t.avg_path_depth.isna()) == [False, False, True, True, False]
    assert list(t.top_country_share) == [0, 0.5, 0, 0, 0]
    assert list(t.country_nunique) == [1, 2, 0, 0, 1]
    # The median of code 200 counts the row without a time: 1000 bytes each.
    assert list(t.y_bytes_imp) == [2.0, 2.0, 0, 0, 1.0]
    np.testing.assert_allclose(t.endpoint_entropy, [-1.4426950408896e-12, -1.4426950408896e-12, 0, 0, -1.4426950408896e-12], rtol=1e-3)
    assert list(t.hour) == [0] * 5 and list(t.weekday) == [5] * 5 and list(t.is_weekend) == [1] * 5


def test_null_response_is_no_error(spark):
    rows = as_rows(spark, [line("1995-07-01 00:00:10", code=500), line("1995-07-01 00:00:20")])
    rows = rows.withColumn("response", F.when(F.col("response") != 500, F.col("response")))
    t = buckets.bucket_table(rows, "1m").first()
    assert (t.y_req, t.error_rate, t.server_error_rate) == (2, 0.0, 0.0)


def random_lines(n=3000, seed=1, hot=0.4):
    """A third and more of all rows in one minute, one directory and one code."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        if rng.random() < hot:
            out.append(line(f"1995-07-02 03:04:{rng.integers(60):02d}", f"h{i}.com", f"/hot/{i}", 200, rng.integers(1, 5000)))
            continue
        second = int(rng.integers(0, 3 * 86400))
        when = pd.Timestamp("1995-07-01") + pd.Timedelta(seconds=second)
        host = rng.choice(["a.uk", "b.de", "c.com", "d", "e.org", "1.2.3.4"])
        url = f"/{rng.choice(list('abc'))}/{rng.integers(4)}/f{rng.choice(['.gif', '.html', '.pl', '.zip', ''])}"
        code = int(rng.choice([200, 200, 302, 304, 404, 500]))
        size = "-" if rng.random() < 0.2 else str(rng.integers(0, 9000))
        out.append(line(when, host, url, code, size, rng.choice(["GET", "POST", "BREW"])))
    return out


BY_SQL = """
WITH timed AS (SELECT *, time_bucket(INTERVAL '{m} minutes', "timestamp") AS slot FROM log_rows WHERE "timestamp" IS NOT NULL),
hits AS (SELECT slot, reqdirectory, count(*) AS k, sum(count(*)) OVER (PARTITION BY slot) AS n FROM timed GROUP BY slot, reqdirectory),
spread AS (SELECT slot, sum(-(k / n) * log2(k / n)) AS endpoint_entropy FROM hits GROUP BY slot),
named AS (SELECT slot, visitor_country, count(*) AS k FROM timed WHERE visitor_country <> 'other_country' GROUP BY ALL),
top AS (SELECT slot, max(k) AS k FROM named GROUP BY slot)
SELECT slot, count(*) AS y_req, avg(bytes_missing) AS bytes_missing_rate, avg(is_dynamic) AS dynamic_rate,
  avg(reqpathdepth) AS avg_path_depth, count(DISTINCT reqdirectory) AS dir_nunique, avg(is_post) AS ratio_post,
  count_if(response >= 400) / count(*) AS error_rate, any_value(endpoint_entropy) AS endpoint_entropy,
  coalesce(any_value(top.k), 0) / count(*) AS top_country_share
FROM timed JOIN spread USING (slot) LEFT JOIN top USING (slot) GROUP BY slot ORDER BY slot"""


@pytest.mark.parametrize("freq", ["1m", "5m", "15m"])
def test_skewed_rows_equal_sql(spark, freq):
    made = as_rows(spark, random_lines())
    log_rows = made.toPandas()
    want = duckdb.sql(BY_SQL.format(m=V.FREQ_MINUTES[freq])).df().set_index("slot")
    got = buckets.bucket_table(made, freq).orderBy("timestamp").toPandas().set_index("timestamp")
    full = got[got.y_req > 0]
    assert list(full.index) == list(want.index) and got.y_req.sum() == len(log_rows)
    for c in want.columns:
        np.testing.assert_allclose(full[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)
    # A bucket's known sizes alone never exceed the filled ones.
    assert (full.y_bytes_imp >= 0).all() and got.y_bytes_imp[got.y_req == 0].eq(0).all()


def test_one_huge_size_ends_nothing(spark):
    big = 2**63 - 1
    t = table(spark, [line("1995-07-01 00:00:10", size=big), line("1995-07-01 00:00:20", size=big), line("1995-07-01 00:00:30", size="9" * 25)])
    assert t.y_req[0] == 3 and t.y_bytes_imp[0] == pytest.approx(3 * big / 1000, rel=1e-9)


def test_all_frequencies_equal_single_ones(spark):
    rows = as_rows(spark, random_lines(800, 2))
    every = buckets.bucket_tables(rows).toPandas()
    for freq in V.FREQ_MINUTES:
        one = buckets.bucket_table(rows, freq).toPandas().sort_values("timestamp").reset_index(drop=True)
        part = every[every.freq == freq].sort_values("timestamp").reset_index(drop=True)[one.columns]
        pd.testing.assert_frame_equal(one, part, check_exact=False, rtol=1e-12)
    sums = every.groupby("freq")["y_req"].sum()
    assert len(set(sums)) == 1
    assert every.endpoint_entropy.le(np.log2(every.dir_nunique.clip(lower=1)) + 1e-9).all()
    rates = [c for c in every.columns if c.endswith("_rate") or c.startswith("ratio_") or c == "top_country_share"]
    assert every[rates].ge(0).all().all() and every[rates].le(1).all().all()


def test_rows_are_read_once(spark, tmp_path):
    """One pass over the log text makes the cells; nothing else reads it."""
    (tmp_path / "log.txt").write_text("\n".join(random_lines(50)))
    from trafficlens.sources import logs
    rows = rows_of(logs.read_log_text(spark, str(tmp_path)).withColumn("split", F.lit("train")))
    made = buckets.bucket_tables(rows)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "FileScan parquet" in plan
    assert buckets.traffic_cells(rows, sizes=True)._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1


def test_series_are_independent(spark):
    lines = [("s1", line("1995-07-01 00:00:00", size="10")), ("s1", line("1995-07-01 00:02:00", size="-")),
             ("s2", line("1995-07-05 00:00:00", size="90")), ("s2", line("1995-07-05 00:00:01", size="-"))]
    rows = rows_of(spark.createDataFrame(lines, "series string, value string"))
    t = buckets.bucket_table(rows, "1m", ("series",)).orderBy("series", "timestamp").collect()
    assert [(r.series, r.y_req, r.y_bytes_imp) for r in t] == [
        ("s1", 1, 0.01), ("s1", 0, 0.0), ("s1", 1, 0.01), ("s2", 2, 0.18),
    ]


def test_grid_crosses_blocks(spark):
    found = spark.createDataFrame([("a", 1, 100), ("a", 1, 9000), ("b", 1, 7)], "split string, minutes int, bucket long")
    got = {r.split: (r.n, r.lo, r.hi) for r in buckets.dense_grid(found, block=1000).groupBy("split").agg(
        F.countDistinct("bucket").alias("n"), F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).collect()}
    assert got == {"a": (8901, 100, 9000), "b": (1, 7, 7)}


def test_imputation_counts_untimed_rows(spark):
    rows = as_rows(spark, [line("1995-07-01 00:00:00", size="-"), line("1995-07-01 00:00:00", size="10").replace("01/Jul", "31/Feb")])
    got = [r.bytes_imputed for r in enrich.add_bytes_imputed(rows).collect()]
    assert sorted(got) == [0.01, 0.01]
    assert parse.apply_types(parse.parse_lines(spark.createDataFrame([("x",)], "value string"))).count() == 0


def test_one_far_time_does_not_fill_the_grid(spark):
    """1995 and 9999 in one split: the table ends with 1995, the far row is counted."""
    lines = [line("1995-07-01 00:00:10"), line("1995-07-01 00:02:10"),
             line("1995-07-01 00:00:20").replace("01/Jul/1995", "31/Dec/9999")]
    rows = as_rows(spark, lines)
    assert list(table(spark, lines).y_req) == [1, 0, 1]
    report = buckets.series_spans(rows, 1).first()
    assert (report["first"], report["last"], report["rows"], report["rows_set_aside"]) == (
        pd.Timestamp("1995-07-01"), pd.Timestamp("1995-07-01 00:02:00"), 2, 1)
    every = buckets.bucket_tables(rows).groupBy("freq").agg(F.sum("y_req").alias("n"), F.count("*").alias("buckets"))
    assert {r.freq: (r.n, r.buckets) for r in every.collect()} == {"1m": (2, 3), "5m": (2, 1), "15m": (2, 1)}
    # A table of the far year itself: its times pass 32 bits of minutes.
    late = as_rows(spark, [line("1995-07-01 00:00:20").replace("01/Jul/1995", "31/Dec/9999")])
    assert buckets.bucket_table(late, "1m").select(F.col("timestamp").cast("string")).first()[0] == "9999-12-31 00:00:00"


def test_equal_parts_keep_the_earliest_and_empty_input(spark):
    lines = [line("1995-07-01 00:00:10"), line("2040-07-01 00:00:10")]
    report = buckets.series_spans(as_rows(spark, lines), 1).first()
    assert (report["first"].year, report["rows"], report["rows_set_aside"]) == (1995, 1, 1)
    assert buckets.series_spans(as_rows(spark, ["junk"]), 1).count() == 0
    assert table(spark, ["junk"]).empty


def test_empty_runs_are_intervals(spark):
    lines = [line(f"1995-07-{d:02d} {h:02d}:00:00") for d, h in ((1, 0), (1, 1), (1, 5), (4, 0))]
    got = [(str(r["first"]), str(r["last"]), r.buckets) for r in buckets.empty_runs(as_rows(spark, lines), 60).orderBy("first").collect()]
    assert got == [("1995-07-01 02:00:00", "1995-07-01 04:00:00", 3), ("1995-07-01 06:00:00", "1995-07-03 23:00:00", 66)]


def test_cells_of_days_add_up(spark, tmp_path):
    """Two parts, one written twice, equal one pass over all lines."""
    lines = random_lines(1500)
    rows = as_rows(spark, lines)
    store = str(tmp_path / "cells")
    early = F.minute("timestamp") < 20
    buckets.add_to_cells(rows.where(early), store, "a")
    buckets.add_to_cells(rows.where(early), store, "a")
    buckets.add_to_cells(rows.where(~early), store, "b")
    got = buckets.tables_of_cells(buckets.cells_in(spark, store)).orderBy("freq", "timestamp").toPandas()
    want = buckets.bucket_tables(rows).orderBy("freq", "timestamp").toPandas()
    pd.testing.assert_frame_equal(got, want, rtol=1e-12)
    with pytest.raises(ValueError):
        buckets.add_to_cells(rows, store, "../b")


def test_steps_share_one_exchange(spark):
    cells = buckets.stored_cells(as_rows(spark, random_lines(200)))
    rolled = buckets.rolled_up(cells.where("dim <> 'size'"), [1, 5, 15])
    rolled.collect()
    plan = rolled._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 2 and plan.count("- Exchange hashpartitioning") == 1


def test_grid_of_sparse_series_moves_no_empty_bucket(spark):
    """Two rows a series, years apart: only found rows and marks of blocks are shuffled."""
    found = spark.createDataFrame(
        [("a", 1, 100, 5), ("a", 1, 9000, 2), ("a", 1, 9_000_000, 1), ("b", 1, 4095, 3), ("b", 1, 4096, 4), (None, 1, 7, 1)],
        "split string, minutes int, bucket long, requests long")
    ends = buckets.spans(found, weight="requests", most_empty_days=100)
    full = buckets.gap_free(found, ends, block=1000)
    got = {(r.split, r.bucket): r.requests for r in full.collect()}
    want = {("a", b): None for b in range(100, 9001)} | {(None, 7): None}
    assert got == want | {("a", 100): 5, ("a", 9000): 2, ("b", 4095): 3, ("b", 4096): 4}
    plan = full._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan.split("Generate explode(sequence(bucket")[0]
