"""Log text from members of zip containers."""

import random
import tracemalloc
import zipfile

import pytest

from trafficlens.plans.traffic import traffic_features, traffic_features_from_zip
from trafficlens.sources import logs, zips


def container(path, **members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for name, data in members.items():
            out.writestr(name.replace("__", "/") + ".txt", data)
    return str(path)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_lines_of_pieces(size):
    rnd = random.Random(size)
    for _ in range(300):
        data = b"".join(rnd.choice([b"a", b"bc", b"\n", b"\r", b"\r\n", b"\n\r", b"\xc3", b"\xa9", b""]) for _ in range(rnd.randint(0, 12)))
        got = [x for part in zips.lines_of(data[i:i + size] for i in range(0, len(data), size)) for x in part]
        want = data.replace(b"\r\n", b"\n").replace(b"\r", b"\n").split(b"\n")
        assert got == (want[:-1] if want[-1] == b"" else want)


def test_zip_equals_text(spark, tmp_path):
    data = "one\r\ntwo\x0cthree\rfour\x85five\n\nlast é".encode() + b"\xff\xc3 end"
    (tmp_path / "a.txt").write_bytes(data)
    path = container(tmp_path / "logs.zip", DATA__train=data, DATA__test=b"t1\nt2\n", README=b"not read")
    text = [r.value for r in logs.read_log_text(spark, str(tmp_path / "a.txt")).collect()]
    assert [r.value for r in logs.read_log_zip(spark, path, "DATA/train.txt").collect()] == text == data.decode("utf-8", "replace").splitlines()
    both = logs.read_train_test_zip(spark, path).collect()
    assert sorted((r.split, r.value) for r in both) == sorted([("train", v) for v in text] + [("test", "t1"), ("test", "t2")])


def test_patterns_folders_and_empty_members(spark, tmp_path):
    container(tmp_path / "b.zip", x=b"b1\nb2", y=b"")
    container(tmp_path / "a.zip", x=b"a1", z=b"\n")
    (tmp_path / "note.txt").write_text("no container")
    read = lambda members: sorted(r.value for r in logs.read_log_zip(spark, str(tmp_path), members).collect())
    assert read("x.txt") == ["a1", "b1", "b2"] and read("y.txt") == [] and read("z.txt,y.txt") == [""]
    assert read("*") == ["", "a1", "b1", "b2"]
    with pytest.raises(Exception, match="no member"):
        read("x.txt,w.txt")
    with pytest.raises(Exception, match="missing.zip"):
        logs.read_log_zip(spark, str(tmp_path / "missing.zip")).collect()


def test_numbers_follow_the_members(spark, tmp_path):
    lines = [f"line {i}" for i in range(40_000)]
    path = container(tmp_path / "l.zip", DATA__train="\n".join(lines).encode(), DATA__test=b"a\nb\nc")
    got = logs.dense_index(logs.read_train_test_zip(spark, path, positions=True))
    rows = {(r.split, r["index"]): r.value for r in got.collect()}
    assert rows == {("train", i): v for i, v in enumerate(lines)} | {("test", i): v for i, v in enumerate("abc")}


def test_other_encodings(spark, tmp_path):
    path = container(tmp_path / "l.zip", a="é\nü\r\n漢".encode("utf-16"), b="é\xa0".encode("latin-1"))
    assert [r.value for r in logs.read_log_zip(spark, path, "a.txt", encoding="utf-16").collect()] == ["é", "ü", "漢"]
    assert [r.value for r in logs.read_log_zip(spark, path, "b.txt", encoding="latin-1").collect()] == ["é\xa0"]


def test_a_damaged_member_is_an_error(spark, tmp_path):
    path = container(tmp_path / "l.zip", a=random.Random(1).randbytes(5000))
    data = bytearray((tmp_path / "l.zip").read_bytes())
    data[2000] ^= 255
    (tmp_path / "l.zip").write_bytes(data)
    with pytest.raises(Exception, match="CRC|zip|decompress"):
        logs.read_log_zip(spark, path).collect()


def test_memory_stays_bounded(tmp_path, monkeypatch):
    """A member of 200 MB, and a line of 40 MB in pieces of 64 KB."""
    line = b'h.com - - [01/Jul/1995:00:00:01 -0400] "GET /a HTTP/1.0" 200 123\n'
    with zipfile.ZipFile(tmp_path / "l.zip", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as out:
        with out.open("a.txt", "w", force_zip64=True) as member:
            for _ in range(200):
                member.write(line * (1_000_000 // len(line)))
    tracemalloc.start()
    n = sum(b.num_rows for b in zips.read_member(str(tmp_path / "l.zip"), "a.txt"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 200 * (1_000_000 // len(line)) and peak < 20 << 20
    monkeypatch.setattr(zips, "PIECE_BYTES", 1 << 16)
    with zipfile.ZipFile(tmp_path / "m.zip", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as out:
        out.writestr("a.txt", b"x" * (40 << 20) + b"\ny")
    assert [b.column("value")[-1].as_buffer().size for b in zips.read_member(str(tmp_path / "m.zip"), "a.txt")] == [40 << 20, 1]


def test_the_sink_overwrites_and_rereads(spark, tmp_path):
    path = str(tmp_path / "out")
    for n in (500, 300):
        rows = spark.range(n).selectExpr("concat('m', id % 3, '.txt') AS member", "concat('v', id) AS value").repartition(4).sortWithinPartitions("member")
        logs.write_log_zip(rows, path)
        assert {r.value for r in logs.read_log_zip(spark, path).collect()} == {f"v{i}" for i in range(n)}
    assert not [p for p in (tmp_path / "out").iterdir() if p.suffix == ".tmp"]
    with pytest.raises(Exception, match="do not follow"):
        logs.write_log_zip(spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "3")], "member string, value string").coalesce(1), path)
    logs.write_log_zip(rows.where("member = 'none'"), path)
    assert zips.containers(path) == []


def test_features_from_a_container(spark, tmp_path):
    def log(hours):
        return "".join(f'h{i % 5}.com - - [0{1 + i // 24}/Jul/1995:{i % 24:02d}:00:30 -0400] "GET /a/b HTTP/1.0" 200 {i}\n' for i in range(hours)).encode()

    (tmp_path / "train").write_bytes(log(60))
    (tmp_path / "test").write_bytes(log(30))
    path = container(tmp_path / "l.zip", DATA__train=log(60), DATA__test=log(30))
    text = traffic_features(spark, str(tmp_path / "train"), str(tmp_path / "test"), str(tmp_path / "t"), ("15m",))["15m"]
    zipped = traffic_features_from_zip(spark, path, str(tmp_path / "z"), ("15m",))["15m"]
    assert sorted(map(str, zipped.collect())) == sorted(map(str, text.collect())) and text.count() > 0
