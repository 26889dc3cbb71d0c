"""Text, CSV and Parquet sources, and row numbers."""

import re

import pytest
from pyspark.sql import functions as F, types as T

from trafficlens import fixed_values as V
from trafficlens.operators import combine, parse
from trafficlens.schemas import PARSED, require_columns
from trafficlens.sources import logs, tables

LINES = [
    'h1.com - - [01/Jul/1995:00:00:01 -0400] "GET /a HTTP/1.0" 200 123',
    'h2.com - - [01/Jul/1995:00:00:02 -0400] "GET /b HTTP/1.0" 304 -',
    "no quotes 200 12",
    "",
    'h3 - [x] y [02/Jul/1995:00:00:03 -0400] "GET /c" 200 7 trailing "text',
    'a\tb - - [03/Jul/1995:00:00:03 -0400] "GET /d" 404 99999999999999999999',
    'h5 - - [a [] "GET /e" 200 1',
    'h6 - - [01/Jul/1995:00:00:02 -0400] "one" 200 5 - [02/Jul/1995:00:00:09 -0400] "two" 500 6',
    'h7 - - [01/Jul/1995:00:00:02 -0400] "" 200 5',
]


def test_parse_equals_the_pattern(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(LINES)], "id int, value string")
    got = {r.id: (r.host, r.timestamp, r.request, r.response, r.bytes) for r in parse.parse_lines(df).collect()}
    want = {}
    for i, line in enumerate(LINES):
        m = re.search(V.LOG_PATTERN, line)
        if m:
            size = None if m[5] == "-" or len(m[5]) > 19 else int(m[5])
            want[i] = (m[1], m[2], m[3], m[4], size)
    assert got == want and set(want) == {0, 1, 4, 5, 6, 7}


def test_pattern_is_evaluated_once(spark):
    df = spark.createDataFrame([(LINES[0],)], "value string")
    plan = parse.apply_types(parse.parse_lines(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_apply_types_and_guard(spark):
    df = spark.createDataFrame([("h", "31/Feb/1995:00:00:01", "r", "045", 1500)],
                               "host string, timestamp string, request string, response string, bytes long")
    row = parse.apply_types(df).first()
    assert (row.timestamp, row.response, row.bytes) == (None, 45, 1.5)
    with pytest.raises(ValueError, match="bytes"):
        parse.apply_types(df.drop("bytes"))
    with pytest.raises(ValueError):
        require_columns(df, ["index"])


def test_text_scan(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\xff\r\ntwo\x0cthree\nfour\xc2\x85five\n")
    got = [r.value for r in logs.read_log_text(spark, str(tmp_path)).collect()]
    assert got == (tmp_path / "a.txt").read_bytes().decode("utf-8", "replace").splitlines()


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_dense_index_in_file_order(spark, tmp_path, block):
    text = []
    for part in range(3):
        rows = [f'h{part}x{i} - - [01/Jul/1995:00:00:01 -0400] "GET /{i}" 200 1' if i % 5 else "bad" for i in range(40 + 30 * part)]
        (tmp_path / f"part-{part}.txt").write_text("\n".join(rows) + "\n")
        text += [r for r in rows if r != "bad"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        scan = logs.read_log_text(spark, str(tmp_path), positions=True)
        got = logs.dense_index(parse.parse_lines(scan)).orderBy("index").select("index", "host").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["index"] for r in got] == list(range(len(text)))
    assert [r.host for r in got] == [line.split(" ")[0] for line in text]


def test_csv_round_trip(spark, tmp_path):
    rows = [(0, 'a "quoted", text', "x", "r", "200", 5), (1, "b", "y", "s\\t", "404", None)]
    schema = T.StructType([T.StructField("index", T.LongType()), *PARSED.fields])
    tables.write_csv(spark.createDataFrame(rows, schema), str(tmp_path / "c"))
    back = tables.read_csv(spark, str(tmp_path / "c"), PARSED, index="index")
    assert back.columns == PARSED.fieldNames()
    assert sorted(map(tuple, back.collect())) == sorted(r[1:] for r in rows)
    two = tables.read_csv(spark, str(tmp_path / "c"), schema, columns=["index", "request"])
    assert two.columns == ["index", "request"]


def test_cast_columns(spark):
    df = spark.createDataFrame([("1", "x", "keep")], "a string, b string, c string")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType())])
    assert tuple(parse.cast_columns(df, schema).first()) == (1, None, "keep")
    numbers = spark.createDataFrame([("1.5",), ("NaN",), ("x",), (None,)], "t string")
    assert [r[0] for r in numbers.select(parse.coerce_number(F.col("t"))).collect()] == [1.5, None, None, None]


def test_tables_by_frequency(spark, tmp_path):
    df = spark.sql("""select split, freq, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id) timestamp, id
        from range(48), (select explode(array('train', 'test')) split), (select explode(array('1m', '5m')) freq)""")
    path = str(tmp_path / "t")
    tables.write_tables(df, path)
    got = tables.read_table(spark, path, "5m", "train")
    assert got.count() == 48 and {r.freq for r in got.collect()} == {"5m"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "freq=5m" in plan and "(split" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    with pytest.raises(FileNotFoundError, match="traffic-table step"):
        tables.read_table(spark, path, "15m")
    assert len(tables.read_parquet_sets(spark, [path, path])) == 2


def test_bucketed_sets_join_without_moving(spark, tmp_path):
    """No exchange in the plan, and the rows of the plain join, null and missing keys too."""
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "index long, a string")
    b = spark.createDataFrame([(2, 2.0), (3, 3.0), (None, 4.0)], "index long, b double")
    c = spark.createDataFrame([(1, 7), (1, 8), (9, 9)], "index long, c int")
    keys, stored = tables.write_bucketed_sets({"a": a, "b": b, "c": c}, str(tmp_path / "kept-sets"), buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = combine.join_sets(stored, keys=keys)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        key = lambda r: tuple(str(v) for v in r)
        assert sorted(joined.collect(), key=key) == sorted(combine.join_sets([a, b, c]).collect(), key=key)
        want = a.join(b, "index", "full").join(c, "index", "full")
        assert sorted(joined.collect(), key=key) == sorted(want.collect(), key=key)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("a", "b", "c", "_keys"):
            spark.sql(f"DROP TABLE IF EXISTS kept_sets_{name}")


def test_rejects_are_counted_and_kept(spark, tmp_path):
    good = 'a.com - - [01/Jul/1995:00:00:01 -0400] "GET /x HTTP/1.0" 200 {}'
    lines = [good.format(5), good.format("-"), good.format("9" * 25), good.format(7).replace("01/Jul", "31/Feb"),
             good.format("9" * 25).replace("Jul", "Xyz"), "junk", "", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "id int, value string")
    path = str(tmp_path / "checked")
    assert parse.store_checked(df, path) == {
        "lines": 8, "unmatched": 3, "bad_time": 2, "bad_size": 2, "known_size": 2, "no_size": 3}
    kept = {r.id: r.faults for r in parse.quarantine(df, path).collect()}
    assert kept == {2: ["bad_size"], 3: ["bad_time"], 4: ["bad_time", "bad_size"], 5: ["unmatched"], 6: ["unmatched"], 7: ["unmatched"]}
    texts = {r.id: r.value for r in parse.quarantine(df, path).collect()}
    assert all(texts[i] == (lines[i] or "") for i in texts)
    rows = parse.checked_rows(df, path)
    assert sorted(rows.collect()) == sorted(parse.apply_types(parse.parse_lines(df)).select(*rows.columns).collect())
    # Nothing at all, and no fault at all: both folders can be read.
    for name, none in (("empty", df.where("id > 99")), ("clean", df.where("id < 2"))):
        parse.store_checked(none, str(tmp_path / name))
        assert parse.quarantine(none, str(tmp_path / name)).count() == 0
        assert parse.checked_rows(none, str(tmp_path / name)).count() == none.count()


def test_one_row_group_of_many_splits_is_dealt_out(spark, tmp_path):
    """A scan of as many splits as cores, one of which holds every row."""
    import pandas as pd

    from trafficlens import session

    path = str(tmp_path / "events.parquet")
    pd.DataFrame({"event_id": range(50_000), "text": [f"{i * 7919}" for i in range(50_000)]}).to_parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        scan = spark.read.parquet(path)
        assert scan.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        dealt = session.spread(scan)
        most = dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert most[0] <= 50_000 / 4 and most[1] == 50_000
