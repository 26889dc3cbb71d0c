"""Scalar functions on edge values."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import pairs
from trafficlens.functions import host as H, request as R, response as P, scaling, sizes as S, times


def one(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return pairs(df.select("x", expr(F.col("x")).alias("y")))


def test_tld_and_category(spark):
    hosts = ["10.0.3.1", "localhost", "a.b.COM", "a.uk", "a.info", "a.", "x.123"]
    assert one(spark, hosts, H.tld) == {
        "10.0.3.1": None, "localhost": None, "a.b.COM": "com", "a.uk": "uk",
        "a.info": "info", "a.": "", "x.123": None,
    }
    assert one(spark, hosts, lambda h: H.visitor_category(H.tld(h))) == {
        "10.0.3.1": "unknown", "localhost": "unknown", "a.b.COM": "commercial",
        "a.uk": "country", "a.info": "unknown", "a.": "unknown", "x.123": "unknown",
    }


def test_domain_keeps_case(spark):
    assert one(spark, ["a.b.COM", "x.123", "localhost", "a."], H.domain) == {
        "a.b.COM": "COM", "x.123": "None", "localhost": "None", "a.": "",
    }


REQUESTS = [
    "GET /a/b.gif HTTP/1.0", "GET", "GET  /x", "get /x", "GET noslash", "GET /cgi?u=/p/q", "",
    "GET \t/a/b\t HTTP/1.0", "GET /a/HTTP/1.0x",
]


def test_request_pieces(spark):
    def pieces(r):
        u = R.request_url(r)
        return F.struct(R.request_method(r), u, R.url_directory(u), R.url_resource(u))

    got = {k: tuple(v) for k, v in one(spark, REQUESTS, pieces).items()}
    assert got == {
        "GET /a/b.gif HTTP/1.0": ("GET", "/a/b.gif", "/a/", "b.gif"),
        "GET": ("GET", "UNKNOWN", "UNKNOWN", ""),
        "GET  /x": ("GET", "", "", ""),
        "get /x": ("UNKNOWN", "/x", "/", "x"),
        "GET noslash": ("GET", "noslash", "noslash", ""),
        "GET /cgi?u=/p/q": ("GET", "/cgi?u=/p/q", "/cgi?u=/p/", "q"),
        "": ("UNKNOWN", "UNKNOWN", "UNKNOWN", ""),
        "GET \t/a/b\t HTTP/1.0": ("GET", "\t/a/b\t", "/a/", "b"),
        "GET /a/HTTP/1.0x": ("GET", "/a/HTTP/1.0x", "/a/", "x"),
    }


def test_resource_type_dynamic_depth(spark):
    assert one(spark, ["b.GIF", "README", "x.tar", "m.mpg", "p.html", "run.pl", "xpl"], R.resource_type) == {
        "b.GIF": "Image", "README": "Directory", "x.tar": "UNKNOWN", "m.mpg": "Audio/Video",
        "p.html": "Page", "run.pl": "Page", "xpl": "Directory",
    }
    assert one(spark, ["run.pl", "xpl", "a.CGI", "perl.txt"], R.is_dynamic) == {
        "run.pl": 1, "xpl": 1, "a.CGI": 1, "perl.txt": 0,
    }
    assert one(spark, ["UNKNOWN", "/", "/a/b/", "none"], R.path_depth) == {
        "UNKNOWN": -1, "/": 1, "/a/b/": 3, "none": 0,
    }


def test_url_length_counts_characters(spark):
    assert one(spark, ["/ü日"], R.url_length) == {"/ü日": 3}


def test_response(spark):
    codes = [200, 304, 404, 503, 45, 0, 600, 100, None]
    assert one(spark, codes, P.response_class, "int") == {
        200: "successful", 304: "redirection", 404: "client error", 503: "server error",
        45: "client error", 0: "unknown", 600: "unknown", 100: "informational", None: "unknown",
    }
    assert one(spark, [600, None], lambda c: P.response_class(c, None), "int") == {600: None, None: None}
    assert one(spark, [200, 299, 404], P.response_status, "int") == {
        200: "OK", 299: "Not Found", 404: "Not Found",
    }
    assert one(spark, [100, 302, 404, 600], P.response_result, "int") == {
        100: "success", 302: "success", 404: "fail", 600: "fail",
    }


def test_sizes(spark):
    texts = ["-", "12", "99999999999999999999", "x"]
    assert one(spark, texts, S.parse_size) == {"-": None, "12": 12, "99999999999999999999": None, "x": None}
    df = spark.createDataFrame(
        [(304, None, None), (200, None, 5.0), (500, None, None), (100, None, 7.0), (None, None, None), (404, 3.0, 9.0)],
        "code int, size double, median double",
    )
    args = F.col("size"), F.col("code"), F.col("median")
    rows = df.select(S.imputed(*args), S.imputed(*args, keep_null=True)).collect()
    assert [r[0] for r in rows] == [0.0, 5.0, 0.0, 0.0, 0.0, 3.0]
    assert [r[1] for r in rows] == [0.0, 5.0, 0.0, None, None, 3.0]
    assert one(spark, [1.0, 9.0, None], lambda v: S.bytes_action(v, F.lit(5.0)), "double") == {
        1.0: "normal", 9.0: "for observation", None: "for observation",
    }


def test_log_time(spark):
    texts = [
        "01/Jul/1995:00:00:01 -0400", "01/jul/1995:00:00:01 +0100", "31/Feb/1995:00:00:01 -0400",
        "junk", " 02/Jul/1995:23:59:59", "01/Jul/1995:24:00:00", "01/Jul/1995:10:00:60",
    ]
    got = {k: None if v is None else str(v) for k, v in one(spark, texts, times.parse_log_time).items()}
    assert got == {
        texts[0]: "1995-07-01 00:00:01", texts[1]: "1995-07-01 00:00:01", texts[2]: None, texts[3]: None,
        texts[4]: "1995-07-02 23:59:59", texts[5]: None, texts[6]: None,
    }


@pytest.mark.parametrize("minutes", [1, 5, 10, 15])
def test_bucket_number_and_start_agree(spark, minutes):
    df = spark.sql("select timestamp_ntz'1995-07-01 13:14:15' ts union all select timestamp_ntz'1969-12-31 23:59:59'")
    start = times.bucket_time(times.bucket_number(F.col("ts"), minutes), minutes)
    rows = df.select(start.alias("a"), F.window("ts", f"{minutes} minutes").start.alias("b")).collect()
    assert all(r.a == r.b and r.a.minute % minutes == 0 for r in rows)


def test_servers_and_overload(spark):
    df = spark.sql("select 10.0D req, 0.0D size union all select 0.0D, 0.0D union all select 1.0D, 99.0D")
    need = scaling.required_servers(F.col("req"), F.col("size"), F.lit(5), F.lit(10), 0.5)
    assert [r[0] for r in df.select(need).collect()] == [4, 1, 20]
    over = scaling.overload(F.col("req"), F.col("size"), F.lit(2), F.lit(5), F.lit(10))
    assert [r[0] for r in df.select(over).collect()] == [False, False, True]


def test_log_target_round_trip(spark):
    assert one(spark, [0.0, 3.0], lambda y: F.round(scaling.from_log(scaling.to_log(y)), 9), "double") == {0.0: 0.0, 3.0: 3.0}
    assert one(spark, [-5.0], scaling.from_log, "double") == {-5.0: 0.0}
