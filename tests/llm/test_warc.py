"""Round trips of pages through archives, and what the reader leaves unread."""

import base64
import hashlib

from arbora.llm import warc

PAGES = [
    (1, "http://a.example/x", "<p>é</p>"),
    (2, "http://a.example/y z\n%", "<p>é</p>"),
    (3, None, None),
    (4, "http://b.example/", ""),
    (5, "http://c.example/", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\n\r\n\r\n"),
    (6, "http://d.example/", "x" * 300_000),
    (6, "http://d.example/", "x" * 300_000),
    (None, "http://e.example/", "<p>é</p>"),
    (8, "http://e.example/", "x" * 300_000),
]
SCHEMA = "page_id BIGINT, url STRING, html STRING, payload STRING, record_type INT"


def _pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "own", 1) for r in rows], SCHEMA)


def _digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip(spark):
    path = warc.archive(_pages(spark))
    rows = warc.read_warc(spark, path).withColumn("page_id", warc.page_number("record_id")).collect()
    assert len(rows) == len(PAGES)
    firsts = {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, None: 1, 8: 6}
    html = {p: h for p, _, h in PAGES}
    for r in rows:
        text = html[r.page_id] or ""
        first = firsts[r.page_id]
        assert r.record_type == ("response" if first == r.page_id else "revisit")
        assert r.payload_bytes == len(text.encode()) and r.payload_digest == _digest(text)
        assert (bytes(r.payload).decode() == text) if r.record_type == "response" else r.payload is None
        assert r.refers_to == (None if first == r.page_id else f"urn:arbora:page:{first}")
    uris = {r.page_id: r.target_uri for r in rows}
    assert uris[2] == "http://a.example/y%20z%0A%" and uris[3] is None


def test_least_bytes_and_no_rows(spark):
    path = warc.archive(_pages(spark), least_bytes=1000)
    kinds = {r.record_id: r.record_type for r in warc.read_warc(spark, path, payload=False).collect()}
    assert [k for k, v in kinds.items() if v == "revisit"] == ["urn:arbora:page:8"]
    assert warc.read_warc(spark, warc.archive(_pages(spark, []))).count() == 0


def test_pushed_filters_skip_payloads(spark, monkeypatch):
    path = warc.archive(_pages(spark))
    df = warc.read_warc(spark, path).filter("record_type = 'revisit' AND payload_digest IS NOT NULL")
    assert df.count() == 4
    reader = warc.WarcReader({"path": path})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_bytes",), 3)]))
    assert [f.attribute for f in left] == [("payload_bytes",)]
    decoded = []
    real = warc._Buffered.read
    monkeypatch.setattr(warc._Buffered, "read", lambda self, n: decoded.append(n) or real(self, n))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == 4 and decoded == []


def test_foreign_records(spark, tmp_path):
    body = b"plain\r\n\r\nWARC/1.1\r\n"
    record = b"WARC/1.0\r\nwarc-type: resource\r\nWARC-Target-URI: <http://x/>\r\nX-Long: a\r\n  b\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record % (len(body), body) * 3)
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert [(r.record_type, bytes(r.payload), r.payload_bytes) for r in rows] == [("resource", body, len(body))] * 3
    assert warc.read_warc(spark, str(tmp_path)).filter("record_type IN ('response', 'revisit')").count() == 0
