"""Archives against plain loops: round trips, transactions of every shape, odd rows."""

import gzip
import hashlib
import io
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioflow.llm import common, warc

LONG = "<p>é</p>" * 20
EDGE = "y" * 99
HTML = [None, "", "short", LONG, LONG, "short", EDGE, EDGE, "z" * 100, "z" * 100, LONG, "\r\n\r\nWARC/1.1\r\n" * 9, "ü" * 40_000, "é" * 50, "é" * 50]
URLS = ["http://a.example/x?y=1", None, "", "no scheme", "http://b.example/\r\nWARC-Type: x", "http://ü.example/ä ö", "http://[bad"]
SCHEMA = "page_id long, url string, html string, payload string, Row int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 7) for i, u, h in rows], SCHEMA)


def brute(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    out = Counter()
    responses = {}
    for i, d in sorted(data, key=lambda x: (x[0] is None, x[0] or 0)):
        digest = hashlib.sha256(d).hexdigest()
        if len(d) >= 100 and digest in responses:
            out[i, len(d), digest, "revisit", responses[digest]] += 1
        else:
            responses[digest] = i
            out[i, len(d), digest, "response", None] += 1
    return out


def run(spark, rows, tmp_path):
    pages(spark, rows).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    got = warc.op13_warc(spark, str(tmp_path))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return Counter(map(tuple, got.collect()))


@pytest.mark.parametrize("size", [128 << 20, 2000])
def test_pages_by_brute_force(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(warc, "FILE_BYTES", size)
    rows = [(100 - i, URLS[i % len(URLS)], h) for i, h in enumerate(HTML)] + [(None, None, LONG), (None, None, None), (7, "u", "q" * 200), (7, "u", "q" * 200), (None, "v", "only null " * 20), (None, "v", "only null " * 20)]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_no_pages(spark, tmp_path):
    assert not run(spark, [], tmp_path)
    assert not run(spark, [(1, None, None)], tmp_path) - Counter([(1, 0, hashlib.sha256().hexdigest(), "response", None)])


def test_payloads_come_back(spark):
    rows = [(i, URLS[i % len(URLS)], h) for i, h in enumerate(HTML)]
    archives = warc.write_warc(pages(spark, rows), "2024-01-02T03:04:05Z")
    got = archives.records(payloads=True).collect()
    assert Counter(r.type for r in got if r.type != "warcinfo") == {"request": 15, "metadata": 15, "response": 11, "revisit": 4}
    assert Counter(bytes(r.payload) for r in got if r.type == "response") == Counter((h or "").encode() for i, (_, _, h) in enumerate(rows) if i not in (4, 9, 10, 14))
    assert {r.target_uri for r in got if r.type != "warcinfo"} == {"http://a.example/x?y=1", "about:blank", "no%20scheme", "http://b.example/%0D%0AWARC-Type:%20x", "http://%C3%BC.example/%C3%A4%20%C3%B6", "http://[bad"}
    assert all(r.date == "2024-01-02T03:04:05Z" for r in got) and len({r.record_id for r in got}) == len(got)
    assert sum(r.n_records for r in archives.manifest.collect()) == len(got)


def member(kind, name, block=b"", *headers):
    return warc.record(kind, name, "2024-01-01T00:00:00Z", block, list(headers))


def to(name):
    return "WARC-Concurrent-To", f"<{name}>"


HTTP = ("Content-Type", "application/http; msgtype=response")
FIELDS = ("Content-Type", "application/warc-fields")


def nested(spark, tmp_path, name, data):
    (tmp_path / name).write_bytes(data)
    paths = spark.createDataFrame([(f"file://{tmp_path}/{name}",)], "path string")
    return warc.assemble(common.written(warc.read_warc(paths)))


def test_transactions_of_every_shape(spark, tmp_path):
    http = b"HTTP/1.1 404 Not Found\r\nContent-Length: 2\r\n X: folded\r\n\r\nhi"
    data = b"".join([
        member("request", "q1", b"", to("c1")), member("response", "c1", http, HTTP),  # the request names the response
        member("response", "c2", http, HTTP, to("q2"), to("m2")), member("request", "q2"), member("metadata", "m2", b"a: 1\r\nb: x\r\n y\r\n", FIELDS),  # the response names the others
        member("metadata", "m3", b"", to("q3")), member("request", "q3", b"", to("c3")), member("response", "c3", b"no http", HTTP),  # over the request
        member("metadata", "m3b", b"", to("m3")),  # two records in between
        member("request", "lost", b"", to("nowhere")), member("metadata", "alone"),
        member("metadata", "both", b"", to("c1"), to("c2"), to("c1")),
        member("response", "c1", b"again", HTTP), member("resource", "r1", b"data"), member("conversion", "x1", b"left out", to("c1")),
        member("revisit", "v1", b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\n", HTTP, ("WARC-Payload-Digest", "sha256:" + "AB" * 32), ("WARC-Refers-To", "<c1>")),
    ])
    for name, raw in (("t.warc.gz", data), ("t.warc", gzip.decompress(data))):
        rows = {r.capture_id: r for r in nested(spark, tmp_path, name, raw).collect()}
        names = {k: ([x.record_id for x in r.requests], [x.record_id for x in r.metadata]) for k, r in rows.items()}
        assert names == {"c1": (["q1"], ["both"]), "c2": (["q2"], ["m2", "both"]), "c3": (["q3"], ["m3", "m3b"]), "lost": (["lost"], []), "alone": ([], ["alone"]), "r1": ([], []), "v1": ([], [])}
        assert rows["c2"].metadata[0].fields == {"a": "1", "b": "x y"} and rows["c1"].http_status == 404 and rows["c3"].http_status is None
        assert (rows["c1"].payload_bytes, rows["r1"].payload_bytes, rows["v1"].payload_bytes) == (2, 4, 9) and rows["v1"].payload_digest == "ab" * 32 and rows["lost"].type is None
        assert rows["c1"].payload_digest == hashlib.sha256(b"hi").hexdigest() and rows["v1"].refers_to == "c1"


def test_captures_with_many_records_go_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PART", 10)
    data = b"".join([member("response", "c", b"x", HTTP), *[member("metadata", f"m{i}", b"", to("c")) for i in range(95)]])
    rows = nested(spark, tmp_path, "m.warc.gz", data).collect()
    assert len(rows) == 10 and sorted(r.part for r in rows) == list(range(10)) and all(r.type == "response" for r in rows)
    assert Counter(x.record_id for r in rows for x in r.metadata) == Counter(f"m{i}" for i in range(95))


def test_blocks_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 64)
    payload = bytes(range(256)) * 9
    data = member("response", "c", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + payload, HTTP) + member("resource", "d", payload)
    got = list(warc.read_records(io.BytesIO(data), "f", payloads=True))
    assert [r["payload"] for r in got] == [payload, payload] and got[0]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
    assert list(warc.read_records(io.BytesIO(b""), "f")) == []
    with pytest.raises(ValueError, match="cut short"):
        list(warc.read_records(io.BytesIO(gzip.decompress(data)[:-3000]), "f"))
    with pytest.raises(ValueError, match="no record begins"):
        list(warc.read_records(io.BytesIO(b"<html>"), "f"))


def test_declared_digests_are_checked(spark, tmp_path):
    good = "sha256:" + hashlib.sha256(b"x").hexdigest()
    data = b"".join(member("response", k, b"HTTP/1.1 200 OK\r\n\r\nx", HTTP, *([("WARC-Payload-Digest", d)] if d else [])) for k, d in (("a", good), ("b", "sha256:" + "0" * 64), ("c", "sha1:AAAA"), ("d", None)))
    rows = {r.capture_id: r.intact for r in nested(spark, tmp_path, "d.warc.gz", data).withColumn("x", F.lit(1)).collect()}
    assert rows == {"a": True, "b": False, "c": None, "d": None}
