import gzip

from pyspark.sql import functions as F

from lexmill.llm import warc


def record(kind, name, date, http, extra="", length=None):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\nWARC-Target-URI: http://a.example/x\r\nWARC-Date: {date}\r\n{extra}Content-Type: application/http\r\nContent-Length: {len(http) if length is None else length}\r\n\r\n"
    return head.encode() + http + b"\r\n\r\n"


FULL = record("response", "f", "2024-01-01T00:00:00Z", b'HTTP/1.1 200 OK\r\nETag: "1"\r\nVary: a\r\nVary: b\r\n\r\nhello')
SAME = record("revisit", "s", "2024-01-02T00:00:00Z", b'HTTP/1.1 304 Not Modified\r\nETag: "1"\r\n\r\n')


def test_only_not_modified_revisits_are_resolved(spark):
    digest = record("revisit", "d", "2024-01-03T00:00:00Z", b'HTTP/1.1 200 OK\r\nETag: "1"\r\n\r\n', "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n")
    said = record("revisit", "n", "2024-01-04T00:00:00Z", b'HTTP/1.1 200 OK\r\nETag: "1"\r\n\r\n', "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/server-not-modified\r\n")
    rows = list(warc.parse_warc(FULL + SAME + digest + said))
    df = spark.createDataFrame([(r["record_id"], r["type"], r["url"], r["time"], r["status"], dict(r["headers"]), r["body"], r["profile"]) for r in rows], warc.SCHEMA.replace("time timestamp", "time string")).withColumn("time", F.to_timestamp("time"))
    got = {r.record_id: (r.outcome, r.body and bytes(r.body)) for r in warc.resolve_revisits(df).collect()}
    assert got == {"s": ("resolved", b"hello"), "d": ("other_kind", None), "n": ("resolved", b"hello")}
    assert dict(rows[0]["headers"])["vary"] == "a, b"


def test_broken_files_keep_what_comes_before(spark, tmp_path):
    whole = gzip.compress(FULL) + gzip.compress(SAME)
    assert len(list(warc.parse_warc(whole))) == 2
    assert [r["record_id"] for r in warc.parse_warc(whole[:-20])] == ["f"]
    assert [r["record_id"] for r in warc.parse_warc(record("response", "odd", "x", b"", length="many") + SAME)] == ["s"]
    assert [r["record_id"] for r in warc.parse_warc(FULL + SAME[:-10])] == ["f"]
    assert list(warc.parse_warc(b"")) == [] and list(warc.parse_warc(b"\x1f\x8bnot gzip")) == []
    for name, data in (("a.warc.gz", whole), ("b.warc.gz", whole[:-20]), ("c.warc", b"noise")):
        (tmp_path / name).write_bytes(data)
    assert warc.read_warc(spark, str(tmp_path)).groupBy("record_id").count().where("count > 1").count() == 1


def test_nulls_ties_clashes_and_hot_url(spark):
    rows = [("b", "response", "u", 5, 200, {"etag": "1"}, b"x" * 2_000_000), ("b2", "response", "u", 5, 200, {"etag": "2"}, b"y"), (None, "response", "u", 6, 200, {}, b""), ("n", "revisit", None, 7, 304, {"etag": "1"}, None), ("m", "revisit", "u", None, 304, None, None)]
    rows += [(f"r{i}", "revisit", "u", 10 + i, 304, {"etag": "2", "expires": None}, None) for i in range(300)] + [("r0", "revisit", "u", 10, 304, {"etag": "2"}, None)]
    df = spark.createDataFrame([(a, b, u, t, s, h, x, "clash", 1) for a, b, u, t, s, h, x in rows], "record_id string, type string, url string, t long, status int, headers map<string,string>, body binary, latest string, _base int").withColumn("time", F.timestamp_seconds("t"))
    got = {r.record_id: r for r in warc.resolve_revisits(df).collect()}
    assert len(got) == 302 and got["n"].outcome == got["m"].outcome == "no_base"
    assert all(got[f"r{i}"].base_id == "b2" and bytes(got[f"r{i}"].body) == b"y" for i in range(300))
