"""WARC archives of pages: writing with segments, reading with reassembly.

Writing is DataFrame work: a record is text, its pages' HTML in UTF-8, framed in chunks
inside an HTTP response. A block longer than the segment length is split into a first
record and continuation records, as WARC 1.1 describes. The text writer puts the record
separator behind each.

Reading takes whole archive files, which the writer bounds by records per file and by the
segment length, parses them by content length in Python, and brings the segments of a
record together: grouped by origin identifier, ordered by segment number, checked
against the total length. Only split records are shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careledger.llm.shared import new_path, whole

CRLF = "\r\n"
BETWEEN = CRLF + CRLF
#: Payloads under this length are never revisits.
REVISIT_BYTES = 100
#: Characters in a chunk of the HTTP body, characters in a segment, records in a file.
CHUNK_CHARS, SEGMENT_CHARS, FILE_RECORDS = 4096, 16384, 1024
_DATE = "2024-01-01T00:00:00Z"


def _parts(text: Column, chars: int) -> Column:
    """``text`` in pieces of ``chars`` code points; none for an empty one."""
    count = F.ceil(F.length(text) / chars).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i * chars + 1, F.lit(chars)))


def _chunked(text: Column) -> Column:
    framed = F.transform(
        _parts(text, CHUNK_CHARS),
        lambda p: F.concat(F.lower(F.hex(F.octet_length(p).cast("bigint"))), F.lit(CRLF), p, F.lit(CRLF)),
    )
    return F.concat(F.array_join(framed, ""), F.lit("0" + BETWEEN))


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _header(*fields: tuple[str, Column]) -> Column:
    """Header lines; a field with a null value is left out."""
    lines = [F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)) for name, value in fields]
    return F.concat(F.lit("WARC/1.1" + CRLF), *[F.coalesce(x, F.lit("")) for x in lines], F.lit(CRLF))


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, bytes and refers_to: the page a revisit refers to, else null.

    Of equal payloads the row with the smallest page_id is the response. Digests are
    counted per task before the shuffle; only repeated ones are joined back, and the
    join on a very common digest can be split.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), whole("html").alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html").cast("long"))
    repeated = (
        rows.filter(F.col("bytes") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", "first")
    )
    later = F.col("page_id") > F.col("first")
    return rows.join(repeated, "digest", "left").withColumn("refers_to", F.when(later, F.col("first"))).drop("first")


def records(pages: DataFrame) -> DataFrame:
    """``value``: one WARC record per row, split ones as several rows.

    Rows that repeat page_id and html have the same identifier.
    """
    rows = with_revisits(pages)
    rows = rows.withColumn("id", _urn(F.col("page_id"), F.col("digest")))
    revisit = F.col("refers_to").isNotNull()
    # Header fields are lines: a URL with line breaks is kept percent-encoded.
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
        F.lit(f"Transfer-Encoding: chunked{BETWEEN}"),
    )
    rows = rows.withColumn("uri", uri).withColumn(
        "block", F.when(revisit, F.lit("HTTP/1.1 200 OK" + BETWEEN)).otherwise(F.concat(http, _chunked(F.col("html"))))
    )
    rows = rows.withColumn("total", F.octet_length("block")).select(
        "*", F.posexplode(_parts(F.col("block"), SEGMENT_CHARS)).alias("nth", "part")
    )
    split, first = F.length("block") > SEGMENT_CHARS, F.col("nth") == 0
    last = (F.col("nth") + 1) * SEGMENT_CHARS >= F.length("block")
    number = F.col("nth") + 1
    own_id = F.when(first, F.col("id")).otherwise(_urn(F.col("id"), number))
    head = _header(
        ("WARC-Type", F.when(~first, "continuation").when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", own_id),
        ("WARC-Date", F.lit(_DATE)),
        ("WARC-Target-URI", F.col("uri")),
        ("WARC-Page-ID", F.when(first, F.col("page_id"))),
        ("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha256:"), F.col("digest")))),
        ("WARC-Payload-Length", F.when(first, F.col("bytes"))),
        ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", F.when(revisit, _urn(F.col("refers_to"), F.col("digest")))),
        ("WARC-Refers-To-Page", F.col("refers_to")),
        ("WARC-Segment-Number", F.when(split, number)),
        ("WARC-Segment-Origin-ID", F.when(split & ~first, F.col("id"))),
        ("WARC-Segment-Total-Length", F.when(split & last, F.col("total"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length("part")),
    )
    return rows.select(F.concat(head, "part").alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Archives of ``pages`` as compressed files below ``path``."""
    records(pages).write.option("lineSep", BETWEEN).option("maxRecordsPerFile", FILE_RECORDS).option(
        "compression", "gzip"
    ).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record; damaged framing raises ValueError."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode().split(CRLF)[1:]
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start = end + 4
        stop = start + int(fields["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is not as long as it says")
        yield fields, data[start:stop]
        at = stop + 4


def dechunked(body: bytes) -> bytes:
    """The content of a body in chunked transfer framing; ValueError if it is cut off."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size is missing")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut off")
        out.append(body[at : at + size])
        at += size + 2


def payload(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


_COLUMNS = {
    "record_id": pa.string(), "origin": pa.string(), "number": pa.int32(), "total": pa.int64(),
    "page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
    "record_type": pa.string(), "refers_to": pa.int64(), "block": pa.binary(),
}
_SCHEMA = (
    "record_id string, origin string, number int, total long, page_id long, url string, payload_bytes long, "
    "payload_digest string, record_type string, refers_to long, block binary"
)


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _rows(data: bytes) -> Iterator[tuple]:
    for f, block in parse_records(data):
        origin = f.get("warc-segment-origin-id", f["warc-record-id"])
        number, digest = _number(f.get("warc-segment-number")), f.get("warc-payload-digest")
        yield (
            f["warc-record-id"], origin, number, _number(f.get("warc-segment-total-length")),
            _number(f.get("warc-page-id")), f.get("warc-target-uri"), _number(f.get("warc-payload-length")),
            digest and digest.removeprefix("sha256:"), f["warc-type"], _number(f.get("warc-refers-to-page")), block,
        )


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            content = zlib.decompress(data.as_py(), wbits=47)
            rows = list(_rows(content))
            columns = zip(*rows, strict=True) if rows else [()] * len(_COLUMNS)
            arrays = [pa.array(c, k) for c, k in zip(columns, _COLUMNS.values(), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, list(_COLUMNS))


_META = ("record_id", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
_WHOLE = (
    "record_id string, page_id long, url string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, block binary"
)


def _join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            numbers = [s["number"] for s in row["segments"]]
            block = b"".join(s["block"] for s in row["segments"])
            if numbers != list(range(1, len(numbers) + 1)) or len(block) != row["total"]:
                raise ValueError(f"segments of {row['origin']} are missing: {numbers}, {row['total']} bytes")
            rows += [{name: row[name] for name in _META} | {"block": block}] * row["copies"]
        fields = [(name, _COLUMNS[name]) for name in (*_META, "block")]
        yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))


def reassembled(parts: DataFrame) -> DataFrame:
    """Whole records of (origin, number, total, block, ...) segments.

    A record whose segments are not numbered 1 to n, or do not add up to the total length
    that its last one states, raises an error. Segments of rows that were archived twice
    are alike and count once; the record then comes back as often as its first segment.
    """
    rest = [c for c in _COLUMNS if c not in ("origin", "number")]
    same = parts.groupBy("origin", "number").agg(
        F.count("*").alias("copies"), *[F.first(c, ignorenulls=True).alias(c) for c in rest]
    )
    first = F.col("number") == 1
    gathered = same.groupBy("origin").agg(
        F.max("total").alias("total"),
        F.max(F.when(first, F.col("copies"))).alias("copies"),
        *[F.max(F.when(first, F.col(c))).alias(c) for c in _META],
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("segments"),
    )
    return gathered.mapInArrow(_join_segments, _WHOLE)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """record_id, page_id, url, payload_bytes, payload_digest, record_type, refers_to, block.

    The block is the whole one, also of records in segments.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    parts = files.mapInArrow(_parse_files, _SCHEMA)
    alone = parts.filter("number is null").select(*_META, "block")
    return alone.unionByName(reassembled(parts.filter("number is not null")))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest and length of the payload as read, in place of the block."""
    for batch in batches:
        bodies = [payload(x.as_py()) for x in batch.column("block")]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(n) for n in names),
                pa.array([len(x) for x in bodies], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in bodies]),
            ],
            [*names, "read_bytes", "read_digest"],
        )


def archived(pages: DataFrame) -> DataFrame:
    """``pages`` written to archives and read back: one row per page.

    Length and digest of a response are those of the payload as read; a revisit, which
    has no payload, gives those of its header, the full payload's. A null html is an
    empty payload, a null url leaves its header out; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    read = read_archives(spark, path).mapInArrow(
        _verify,
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "read_bytes long, read_digest string",
    )
    response = F.col("record_type") == "response"
    return read.select(
        "page_id",
        F.when(response, F.col("read_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.col("read_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
