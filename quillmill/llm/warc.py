"""Web archives of pages, with a two-level capture index.

``write`` makes one WARC/1.1 record a page, each a gzip member of its own. A payload that an earlier page (by page_id)
already has becomes a ``revisit`` record, which carries the digest and no payload. Archives travel as rows of Parquet
(file, segment, bytes), because executors reach shared storage only through Spark; the segments of a file, one after
another, are a WARC file as any reader takes it.

The index sorts captures by reversed-host URL keys (``com,example)/path``) over all archives and cuts them into
compressed blocks of lines; the directory beside them holds one fence for each block: the shortest text that parts it
from the block before. A lookup searches the fences by halves, opens only the blocks that can hold its keys, searches
their lines by halves, and reads only the segments, and of these only the bytes, that the lines name.

Null html is an empty payload; a null or empty url gets the target ``urn:x-page:<page_id>`` and the key ``)``. Of rows
with equal payloads, all with the smallest page_id are responses (repeated rows give repeated records), and a row without
page_id revisits the smallest page_id that there is. Payloads under ``min_bytes`` are never revisited. Very long pages get
a segment of their own, up to what one row of Parquet holds (2 GB compressed). An empty table gives empty archives
and lookups. Columns besides ``page_id``, ``url`` and ``html`` are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import work

#: Compressed bytes of a segment, lines of an index block, bytes of fences sent to executors at once, groups of equal payloads
#: sent at once (beyond, rows are shuffled), keys asked of one block in one row, and segments named in a scan (beyond, a join).
SEGMENT, LINES, FENCES, FEW_GROUPS, ASKED, NAMED = 1 << 20, 1_024, 32_000_000, 250_000, 16_384, 1_000

_ARCHIVE = pa.schema([("segment", pa.int64()), ("blob", pa.binary()), ("entries", pa.list_(pa.struct([("key", pa.string()), ("page_id", pa.int64()), ("offset", pa.int32()), ("length", pa.int32())])))])
_ARCHIVE_DDL = "segment long, blob binary, entries array<struct<key: string, page_id: long, offset: int, length: int>>"
_INDEX_DDL = "block long, fence string, n int, blob binary"
_RECORD_DDL = "page_id long, target_uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, html string"


def surt(url: Column) -> Column:
    """A URL's key: host reversed by labels, without scheme, user, default port and fragment."""
    text = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)#.*$", "")
    part = lambda k: F.regexp_extract(text, r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?]*@)?([^/?:@\[]*|\[[^\]]*\])(?::([0-9]*))?([/?].*)?$", k)
    host = F.lower(part(1))
    turned = F.when(host.rlike(r"^[0-9.]+$|^\["), host).otherwise(F.array_join(F.reverse(F.split(host, r"\.")), ","))
    port = F.when(part(2).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), part(2)))
    path = F.when(part(3) == "", "/").when(part(3).startswith("?"), F.concat(F.lit("/"), part(3))).otherwise(part(3))
    key = F.when(part(0) == "", F.concat(F.lit(")"), text)).otherwise(F.concat(turned, port, F.lit(")"), path))
    return F.regexp_replace(key, r"[\x00-\x20\x7F]", "%20")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'urn:x-page:{page_id}:{sha1}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record, not compressed."""
    sha1 = digest(payload)
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else f"urn:x-page:{page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, sha1)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, sha1)}", f"Refers-To-Page-ID: {refers_to}"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _fields(lines: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode().split("\r\n")[1:])}


def parse(data: bytes, payload: bool = True) -> dict:
    """What a record (not compressed) says, with its text if asked; a response's payload is held against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    own = _fields(head)
    block = rest[: int(own["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    sha1 = own["warc-payload-digest"].removeprefix("sha1:")
    kind = own["warc-type"]
    if kind == "response" and digest(body) != sha1:
        raise ValueError(f"damaged record {own['warc-record-id']}")
    number = lambda k: int(own[k]) if k in own else None
    return {
        "page_id": number("page-id"), "target_uri": own["warc-target-uri"], "record_type": kind, "payload_bytes": int(_fields(http)["content-length"]),
        "payload_digest": sha1, "refers_to": number("refers-to-page-id"), "html": body.decode() if payload and kind == "response" else None,
    }


def _squeezed(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _decided(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Pages with ``refers_to``: the smallest page_id of their payload where several rows have it.

    Only groups of two rows or more are joined back: broadcast up to a counted number of them, beyond it by a join of
    written tables in which Spark splits a payload that very many rows share.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.when(F.octet_length("html") >= min_bytes, F.unhex(F.sha2(F.encode("html", "UTF-8"), 256))))
    groups = rows.filter("sha IS NOT NULL").groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies"))
    groups = work.put(groups.filter("copies > 1 AND refers_to IS NOT NULL").drop("copies"), "payloads")
    few = groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    return rows.join(F.broadcast(groups) if few else groups, "sha", "left")


def write(pages: DataFrame, location: str | None = None, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 4) -> str:
    """Write archives and index of ``pages``; returns where they are."""
    spark = pages.sparkSession
    location = location or work.path(spark, "warc")

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, k, held, at, entries = TaskContext.get().partitionId(), 0, [], 0, []

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"segment": (file << 32) + k, "blob": b"".join(held), "entries": entries}], _ARCHIVE)

        for batch in batches:
            for page_id, url, html, key, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "key", "refers_to")), strict=True):
                page_id, refers_to = page_id.as_py(), refers_to.as_py()
                if not k and not held:
                    info = b"software: quillmill\r\nformat: WARC File Format 1.1\r\n"
                    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {_record_id(None, str(file))}\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                    held.append(_squeezed(head.encode() + info + b"\r\n\r\n", level))
                    at = len(held[0])
                member = _squeezed(record(page_id, url.as_py(), html.as_buffer().to_pybytes(), refers_to, refers_to is not None and refers_to != page_id, date), level)
                entries.append({"key": key.as_py(), "page_id": page_id, "offset": at, "length": len(member)})
                held.append(member)
                at += len(member)
                if at >= SEGMENT:
                    yield full()
                    k, held, at, entries = k + 1, [], 0, []
        if held:
            yield full()

    own = _decided(pages, min_bytes).select("page_id", "url", "html", surt(F.col("url")).alias("key"), "refers_to")
    own.mapInArrow(archives, _ARCHIVE_DDL).write.option("compression", "none").option("parquet.block.size", 8 * SEGMENT).parquet(f"{location}/archives")
    _index(spark, location)
    return location


def _index(spark: SparkSession, location: str) -> None:
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, lines, first, last = TaskContext.get().partitionId(), 0, [], "", None

        def full() -> pa.RecordBatch:
            fence = first
            if last is not None and first > last:  # the shortest beginning of the first key that is above the last one before
                same = next((i for i, (a, b) in enumerate(zip(first, last)) if a != b), min(len(first), len(last)))
                fence = first[: same + 1]
            return pa.RecordBatch.from_pydict({"block": [(part << 32) + k], "fence": [fence], "n": pa.array([len(lines)], pa.int32()), "blob": [zlib.compress("\n".join(lines).encode(), 6)]})

        key = None
        for batch in batches:
            for x in batch.to_pylist():
                if len(lines) == LINES:
                    yield full()
                    k, lines, last = k + 1, [], key
                key = x["key"]
                if not lines:
                    first = key
                lines.append(f"{key} {'-' if x['page_id'] is None else x['page_id']} {x['segment']} {x['offset']} {x['length']}")
        if lines:
            yield full()

    entries = spark.read.schema(_ARCHIVE_DDL).parquet(f"{location}/archives").select("segment", F.inline("entries"))
    order = ["key", "page_id", "segment", "offset"]
    ranged = entries.repartitionByRange(work.partitions(spark), *order).sortWithinPartitions(*order)
    ranged.select(*order, "length").mapInArrow(blocks, _INDEX_DDL).write.option("compression", "none").parquet(f"{location}/index")


def _slices(directory: DataFrame) -> list[tuple[int, int]]:
    """Runs of index parts (first, last) whose fences are few enough to be sent to all executors at once.

    One row for each part comes to the driver; their number is that of the write's partitions.
    """
    sizes = directory.groupBy((F.shiftright("block", 32)).alias("part")).agg(F.sum(F.octet_length("fence") + 64).alias("size")).orderBy("part").collect()
    out, held = [], 0
    for r in sizes:
        if not out or held + r.size > FENCES:
            out.append((r.part, r.part))
            held = 0
        out[-1], held = (out[-1][0], r.part), held + r.size
    return out


def _captures(spark: SparkSession, location: str, ranges: DataFrame) -> DataFrame:
    """(key, page_id, segment, offset, length) of captures with low <= key < high for a row of ``ranges`` (low, high); no capture twice."""
    index = spark.read.schema(_INDEX_DDL).parquet(f"{location}/index")
    directory, ranges = index.select("block", "fence"), ranges.select("low", "high").distinct()
    found = "key string, page_id long, segment long, offset int, length int"
    opened = []
    for first, last in _slices(directory):
        own = directory.filter(F.col("block").between(first << 32, ((last + 1) << 32) - 1)).orderBy("block").collect()
        shared = spark.sparkContext.broadcast(([r.block for r in own], [r.fence.encode() for r in own]))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            blocks, fences = shared.value
            for batch in batches:
                at, lows, highs = [], [], []
                for x in batch.to_pylist():
                    low, high = x["low"].encode(), x["high"].encode()
                    for i in range(max(0, bisect_left(fences, low) - 1), bisect_left(fences, high)):
                        at.append(blocks[i])
                        lows.append(x["low"])
                        highs.append(x["high"])
                        if len(at) == 10_000:
                            yield pa.RecordBatch.from_pydict({"block": at, "low": lows, "high": highs})
                            at, lows, highs = [], [], []
                if at:
                    yield pa.RecordBatch.from_pydict({"block": at, "low": lows, "high": highs})

        opened.append(ranges.mapInArrow(search, "block long, low string, high string"))
    if not opened:
        return spark.createDataFrame([], found)
    asked = opened[0]
    for more in opened[1:]:
        asked = asked.unionByName(more)
    # ranges of one block meet it in rows of some ASKED ranges, so that a block is copied for each of these rows only
    asked = work.put(asked, "asked")
    parts = asked.groupBy("block").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
    asked = asked.join(parts, "block").withColumn("part", F.expr("pmod(xxhash64(low, high), parts)"))
    asked = asked.groupBy("block", "part").agg(F.collect_list(F.struct("low", "high")).alias("asked"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, own in zip(batch.column("blob"), batch.column("asked"), strict=True):
                lines = zlib.decompress(blob.as_py()).split(b"\n")
                keys, hits = [x.partition(b" ")[0] for x in lines], set()
                for x in own.as_py():
                    hits.update(range(bisect_left(keys, x["low"].encode()), bisect_left(keys, x["high"].encode())))
                if hits:
                    key, page_id, segment, offset, length = zip(*(lines[i].decode().split(" ") for i in sorted(hits)), strict=True)
                    page_id = [None if x == "-" else int(x) for x in page_id]
                    yield pa.RecordBatch.from_pydict({
                        "key": list(key), "page_id": pa.array(page_id, pa.int64()), "segment": [*map(int, segment)],
                        "offset": pa.array([*map(int, offset)], pa.int32()), "length": pa.array([*map(int, length)], pa.int32()),
                    })

    return index.select("block", "blob").join(asked, "block").select("blob", "asked").mapInArrow(answer, found)


def lookup(spark: SparkSession, location: str, urls: DataFrame) -> DataFrame:
    """Captures of the URLs in column ``url``, each once; URLs that were never captured give nothing."""
    key = surt(F.col("url"))
    return _captures(spark, location, urls.select(key.alias("low"), F.concat(key, F.lit("\0")).alias("high")))


def under(spark: SparkSession, location: str, domains: DataFrame) -> DataFrame:
    """Captures on the domains in column ``domain`` (``example.com``) and on all their subdomains; nested domains give a capture once."""
    own = F.array_join(F.reverse(F.split(F.lower("domain"), r"\.")), ",")
    ends = F.explode(F.array(*[F.struct(F.concat(own, F.lit(a)).alias("low"), F.concat(own, F.lit(b)).alias("high")) for a, b in ((")", "*"), (",", "-"), (":", ";"))]))
    return _captures(spark, location, domains.filter("domain IS NOT NULL").select(ends.alias("x")).select("x.*")).distinct()


def read(spark: SparkSession, location: str, captures: DataFrame, payload: bool = True) -> DataFrame:
    """The records of ``captures``: only their segments are opened, and of these only the members' bytes are unpacked.

    A few segments (up to ``NAMED``) are named in the scan, which skips files and row groups without them; more are met in a join.
    """
    archive = spark.read.schema(_ARCHIVE_DDL).parquet(f"{location}/archives").select("segment", "blob")
    wanted = captures.groupBy("segment").agg(F.collect_set(F.struct("offset", "length")).alias("members"))  # a segment's members are bounded by its size
    wanted = work.put(wanted, "wanted")
    named = wanted.select("segment").limit(NAMED + 1).collect()
    few = len(named) <= NAMED
    if few:
        archive = archive.filter(F.col("segment").isin([r.segment for r in named]))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])
        for batch in batches:
            for blob, members in zip(batch.column("blob"), batch.column("members"), strict=True):
                raw, rows, size = memoryview(blob.as_buffer()), [], 0
                for m in sorted(members.as_py(), key=lambda m: m["offset"]):
                    rows.append(parse(zlib.decompress(raw[m["offset"] : m["offset"] + m["length"]], 31), payload))
                    size += len(rows[-1]["html"] or "")
                    if size >= 8 * SEGMENT:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archive.join(wanted.hint("broadcast" if few else "shuffle_hash"), "segment").select("blob", "members").mapInArrow(records, _RECORD_DDL)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages written, looked up in the index by their URLs, and read back: a row for each record."""
    spark = pages.sparkSession
    location = write(pages, min_bytes=min_bytes)
    found = lookup(spark, location, pages.select("url"))
    return read(spark, location, found, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
