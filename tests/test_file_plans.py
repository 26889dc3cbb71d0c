"""Plans from files to files."""

import datetime

from trafficlens.operators import buckets
from trafficlens.plans import files
from trafficlens.plans.traffic import rows_of
from trafficlens.sources import logs, tables


def line(minute, size):
    return f'a.com - - [01/Jul/1995:00:{minute:02d}:30 -0400] "GET /x/y HTTP/1.0" 200 {size}'


def test_text_to_csv_to_typed_csv(spark, tmp_path):
    (tmp_path / "log").write_text("\n".join([line(1, 10), line(2, "-"), "junk", line(3, "9" * 30)]) + "\n")
    raw = files.log_to_csv(spark, str(tmp_path / "log"), str(tmp_path / "raw"))
    assert [r.response for r in raw.collect()] == ["200"] * 3
    rows = sorted(files.typed_csv(spark, str(tmp_path / "raw"), str(tmp_path / "typed")).collect(), key=lambda r: r.timestamp)
    assert [(r.timestamp, r.response, r.bytes) for r in rows] == [
        (datetime.datetime(1995, 7, 1, 0, m, 30), "200", size) for m, size in ((1, 10), (2, None), (3, None))]


def test_short_history_tables(spark, tmp_path):
    (tmp_path / "log").write_text("\n".join(line(m, 10) for m in range(12) for _ in range(m + 1)) + "\n")
    rows = rows_of(logs.read_train_test(spark, str(tmp_path / "log"), str(tmp_path / "log")))
    tables.write_tables(buckets.bucket_tables(rows, ("1m",)), str(tmp_path / "traffic"))
    made = files.short_history_tables(spark, str(tmp_path / "traffic"), str(tmp_path / "out"), ("1m",))["1m"]
    got = {r.timestamp.minute: (r.y_req, r.y_req_lag_1, r.y_req_lag_3, r.y_req_rolling_mean_3) for r in made.collect()}
    assert got == {m: (m + 1, m, m - 2, float(m - 1)) for m in range(3, 12)}
