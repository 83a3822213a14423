import gzip
import hashlib
from base64 import b32encode

import pytest

from quillmill.llm import queries, warc

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


def brute(rows, min_bytes=0):
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        to = first.get(html or "") if len(raw) >= min_bytes else None
        revisit = to is not None and to != page_id
        out.append((page_id, len(raw), b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert found(queries.op11_warc(spark, SF)) == brute(rows)


ODD = [
    (1, "http://a.example/x", "same"), (2, "http://a.example/x", "same"), (2, "http://a.example/x", "same"), (3, None, "same"), (None, "http://b.example", "same"), (4, "", ""), (5, None, None),
    (6, "http://a.example/y?\r\nWARC-Type: no", "line\r\n\r\nline"), (7, "https://user@[::1]:8080/é#f", "é" * 300_000), (8, "no host at all", "\0 nul"), (9, "http://a.example/x", "other"), (None, "http://c.example/", "alone"),
]


@pytest.mark.parametrize("min_bytes", [0, 5])
@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(spark, small, min_bytes, monkeypatch):
    if small:  # blocks of two lines, segments of one record, one part of fences at a time, joins in place of what is sent to all
        for name, value in (("LINES", 2), ("SEGMENT", 1), ("FENCES", 1), ("FEW_GROUPS", 0), ("NAMED", 0), ("ASKED", 1)):
            monkeypatch.setattr(warc, name, value)
    pages = spark.createDataFrame(ODD, PAGES).selectExpr("*", "1 AS sha", "2 AS refers_to", "3 AS key", "4 AS segment")
    assert found(warc.round_trip(pages, min_bytes=min_bytes)) == brute(ODD, min_bytes)


def test_empty_table(spark):
    pages = spark.createDataFrame([], PAGES)
    assert warc.round_trip(pages).collect() == []
    location = warc.write(pages)
    assert warc.under(spark, location, spark.createDataFrame([("example.com",)], "domain string")).collect() == []


def test_files_are_archives(spark):
    location = warc.write(spark.createDataFrame(ODD, PAGES).coalesce(1))
    parts = spark.read.parquet(f"{location}/archives").orderBy("segment").collect()
    data = gzip.decompress(b"".join(r.blob for r in parts))
    kinds = []
    while data:  # record by record, by their own lengths
        head, _, rest = data.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        assert rest[size : size + 4] == b"\r\n\r\n"
        kinds.append(fields["WARC-Type"])
        data = rest[size + 4 :]
    assert kinds[0] == "warcinfo" and len(kinds) == len(ODD) + 1 and kinds.count("revisit") == sum(x[3] == "revisit" for x in brute(ODD))


def test_damage_is_found():
    data = warc.record(1, "http://a.example/", b"payload", None, False, "2024-01-01T00:00:00Z")
    assert warc.parse(data)["html"] == "payload"
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(data.replace(b"payload\r\n", b"Payload\r\n"))


@pytest.mark.parametrize("lines", [1_024, 3])
def test_lookups(spark, lines, monkeypatch):
    """Hits and misses of single URLs and of domains, each against all keys."""
    monkeypatch.setattr(warc, "LINES", lines)
    hosts = ["example.com", "www.example.com", "a.b.example.com", "example.company", "example.org", "xample.com"]
    rows = [(i, f"http://{hosts[i % 6]}{':8080' if i % 7 == 0 else ''}/{i % 5}", f"page {i}") for i in range(60)]
    location = warc.write(spark.createDataFrame(rows, PAGES).repartition(3))
    asked = ["http://example.com/1", "https://EXAMPLE.com:80/1#top", "http://example.com/9", "http://example.net/", None]
    hits = warc.lookup(spark, location, spark.createDataFrame([(u,) for u in asked], "url string"))
    assert sorted(r.page_id for r in hits.collect()) == [i for i, u, _ in rows if u == "http://example.com/1"]
    own = warc.under(spark, location, spark.createDataFrame([("example.com",), ("b.example.com",), (None,), ("nowhere.org",)], "domain string"))
    assert sorted(r.page_id for r in own.collect()) == [i for i, _, _ in rows if hosts[i % 6].endswith("example.com") and hosts[i % 6] != "xample.com"]
    back = warc.read(spark, location, own)
    assert all(r.html == f"page {r.page_id}" and r.target_uri == rows[r.page_id][1] for r in back.collect())


def test_only_blocks_that_can_hold_a_key_are_opened(spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 10)
    rows = [(i, f"http://h.example/{i:05d}", "x") for i in range(1_000)]
    location = warc.write(spark.createDataFrame(rows, PAGES))
    blocks = spark.read.parquet(f"{location}/index").orderBy("block").collect()
    assert sum(r.n for r in blocks) == 1_000 and all(len(r.fence) <= len("example,h)/00000") for r in blocks)
    opened = []
    put = warc.work.put
    monkeypatch.setattr(warc.work, "put", lambda df, tag: (opened.append(put(df, tag)) or opened[-1]))
    warc.lookup(spark, location, spark.createDataFrame([("http://h.example/00500",), ("http://h.example/00501x",)], "url string")).collect()
    assert opened[0].select("block").distinct().count() <= 3
