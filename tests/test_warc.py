"""Archives of responses: what is written is read again, under filters and limits."""

import gzip
import io
import zlib

import pytest

from tidewatch.operators import fetch
from tidewatch.sources.warc import read_archive, record, records, write_archive

ROWS = [
    {"url": "https://a.example/x?q=1", "status": 200, "content_type": "text/html", "body": b"hello \xff", "elapsed_ms": 5},
    {"url": "https://a.example/x?q=1", "try": 2, "status": 301, "location": "/y", "body": b""},
    {"url": "http://B.example:80/", "status": 404, "content_type": "text/html", "x_robots_tag": "noindex", "body": b"gone"},
    {"url": "https://a.example/late", "status": 200, "body": b"late", "elapsed_ms": 20_001},
    {"url": "https://a.example/lost", "error": "NETWORK_ERROR"},
    {"url": "https://a.example/big", "status": 200, "body": b"x" * 5000},
    {"url": "https://a.example/zip", "status": 200, "headers": {"content-encoding": "gzip"}, "body": gzip.compress(b"packed " * 100)},
    {"url": "https://a.example/bomb", "status": 200, "headers": {"content-encoding": "deflate"}, "body": zlib.compress(b"0" * 100_000)},
    {"url": "https://a.example/br", "status": 200, "headers": {"content-encoding": "br"}, "body": b"?"},
    {"url": "https://a.example/none", "status": 204},
]


def test_records_and_limits():
    data = b"".join(map(record, ROWS))
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n\r\n"
    got = {(r[0], r[2]): r for r in records(io.BytesIO(info + data), body_cap=4000)}
    assert len(got) == len(ROWS)
    one = lambda path, n=1: got[f"https://a.example/{path}", n]
    assert one("x?q=1")[1:6] == ("a.example", 1, 200, None, "text/html") and one("x?q=1")[8:] == (b"hello \xff", None, 5)
    assert one("x?q=1", 2)[3:5] == (301, "/y")
    assert got["http://B.example:80/", 1][1] == "b.example" and got["http://B.example:80/", 1][6] == "noindex"
    assert one("late")[8:10] == (None, "TIMEOUT") and one("lost")[8:10] == (None, "NETWORK_ERROR")
    assert one("big")[8:10] == (None, "BODY_TOO_LARGE") and one("bomb")[8:10] == (None, "BODY_TOO_LARGE")
    assert one("zip")[8] == b"packed " * 100 and one("br")[9] == "NETWORK_ERROR" and one("none")[8:10] == (b"", None)
    twice = record({"url": "u", "status": 200}).replace(b"HTTP/1.1 200\r\n", b"HTTP/1.1 200\r\nVary: a\r\nVary: b\r\n").replace(b"Content-Length: 16", b"Content-Length: 34")
    assert next(records(io.BytesIO(twice)))[7] == {"vary": "a, b"}
    cut = data[: data.index(b"x" * 100) + 50]
    assert [r[9] for r in records(io.BytesIO(cut))][-1] == "NETWORK_ERROR"
    assert list(records(io.BytesIO(b""))) == [] and list(records(io.BytesIO(b"no archive\r\n"))) == []


def test_unwanted_bodies_are_not_read():
    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            Counted.taken = max(Counted.taken, len(out))
            return out

    data = record({"url": "https://a/", "status": 200, "body": b"y" * 10_000_000})
    assert list(records(Counted(data), wanted=lambda row: row["status"] == 404)) == [] and Counted.taken <= 1 << 16


def test_written_and_read_by_spark(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    schema = "url string, try int, status int, location string, content_type string, x_robots_tag string, headers map<string,string>, body binary, error string, elapsed_ms int"
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([tuple(bytearray(r[n]) if n == "body" and n in r else r.get(n) for n in names) for r in ROWS], schema)
    for _ in range(2):  # an overwritten archive holds the rows once
        write_archive(df.repartition(3), path)
    back = read_archive(spark, path, body_cap=4000)
    assert back.count() == len(ROWS)
    assert {(r.url, r["try"], r.error) for r in back.collect()} == {(r[0], r[2], r[9]) for r in records(io.BytesIO(b"".join(map(record, ROWS))), body_cap=4000)}
    for condition, n in (("status = 200", 6), ("host = 'b.example'", 1), ("status in (301, 404) and host = 'a.example'", 1), ("elapsed_ms > 0", 2)):
        assert back.filter(condition).count() == n, condition
    plan = back.filter("status = 200")._jdf.queryExecution().executedPlan().toString()
    assert "status" in plan and "Filter (" not in plan.replace("isnotnull(status", "")  # the reader took it
    write_archive(df.limit(0), path)
    assert read_archive(spark, path).count() == 0


def test_a_crawl_reads_it(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    answers = [("https://a.example/1", 1, 301, "/2", None, 0), ("https://a.example/2", 1, 200, None, "body", 0), ("https://a.example/3", 1, 200, None, "slow", 30_000), ("https://a.example/3", 2, 200, None, "there", 10)]
    write_archive(spark.createDataFrame(answers, "url string, try int, status int, location string, body string, elapsed_ms int"), path)
    asked = spark.createDataFrame([(f"https://a.example/{i}", "a.example") for i in range(1, 5)], "url string, host string")
    got = {r.url[-1]: (r.outcome, r.initial_status, r.final_status, r.chain, r.lost) for r in fetch.settled(asked, fetch.archive(read_archive(spark, path))).collect()}
    assert got == {"1": ("HTTP_RESPONSE", 301, 200, 1, 0), "2": ("HTTP_RESPONSE", 200, 200, 0, 0), "3": ("HTTP_RESPONSE", 200, 200, 0, 1), "4": ("NETWORK_ERROR", None, None, 0, 3)}


@pytest.mark.parametrize("bad", ["", "nothing"])
def test_a_folder_without_archives(spark, tmp_path, bad):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / f"a{bad}.txt").write_text("x")
    assert read_archive(spark, f"file://{tmp_path}/x").count() == 0
