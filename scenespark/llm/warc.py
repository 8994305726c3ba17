"""WARC archives: writing captures, reading them back, assembling transactions.

Each page becomes a request, a response (or a revisit of an equal payload) and a metadata record that
are tied by WARC-Concurrent-To. Spark's text writer puts records behind each other, ended by CRLF CRLF,
into gzip files (one stream each) in a folder that all executors share. Captures are dealt to files by
classes of their size, so that a file holds at most ``ARCHIVE_BYTES`` before compression, or one capture
that is larger. Reading takes each archive whole from Spark's binaryFile source and parses it record by
record, so memory holds one archive; a single capture must stay below 2 GB, the bound of Spark's values.
Assembly joins the three kinds of records through the identifier they are concurrent to, in one
aggregation over one reading of the archives, and gives one nested row per capture; a record whose
partners are missing still gives a row, and of repeated records of one kind the one with the smallest
identifier counts.

Of records with equal payloads of at least ``LEAST`` bytes, the one with the largest page_id is the
response and the others revisit it (a null page_id is the smallest); copies of that row itself stay
responses. Null html is the empty payload. Repeated rows are captures of their own. An empty table gives
no archive and no row. Further columns of pages are ignored, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenespark.session import cut, prepare, scratch

LEAST = 1000
#: Bytes of one archive file, its records at most, and the date written into them (archives are repeatable).
ARCHIVE_BYTES, RECORDS, DATE = 32 << 20, 6000, "2024-01-01T00:00:00Z"
#: Classes of captures by payload bytes: below each of these, and beyond the last.
SIZES = (12 << 10, 192 << 10, 3 << 20)
#: Payload digests with copies that may be broadcast (about 100 bytes each); more are joined by a shuffle.
BROADCAST_DIGESTS = 100_000
CRLF = "\r\n"


def _header(fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the two line ends behind it; null fields are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in fields]
    return F.concat(F.lit("WARC/1.1" + CRLF), *[F.coalesce(x, F.lit("")) for x in lines], F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block)


def _id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), *[F.concat(F.substring(h, a, n), F.lit(s)) for a, n, s in ((1, 8, "-"), (9, 4, "-"), (13, 4, "-"), (17, 4, "-"), (21, 12, ">"))])


def mark_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest and refers_to (null: a response)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("payload_digest"))
    seen = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
    copies = cut(seen.filter("n > 1").select("payload_digest", "first_id"))
    small = copies.count() <= BROADCAST_DIGESTS
    out = rows.join(F.broadcast(copies) if small else copies, "payload_digest", "left")
    other = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return out.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(other, F.col("first_id")).alias("refers_to"))


def write_warc(captures: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes the captures of ``mark_revisits`` as gzip archives in folders under path, one for each class of sizes."""
    stored = F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(0)
    size = sum((F.when(stored >= s, 1).otherwise(0) for s in SIZES), F.lit(0))
    for k in sorted(r[0] for r in captures.select(size.alias("k")).distinct().collect()) or [0]:
        # headers, request and metadata take less than the bytes of the smallest class, unless the url is long
        records = 3 * max(1, archive_bytes // (SIZES[k] + 4096)) if k < len(SIZES) else 3
        _write_records(captures.filter(size == k), k, f"{path}/size{k}", min(RECORDS, records))


def _write_records(captures: DataFrame, size: int, path: str, records: int) -> None:
    row = F.monotonically_increasing_id().cast("string")
    df = captures.withColumn("__row", F.concat(F.lit(f"{size}/"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("/"), row))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    rid, digest = _id(F.col("__row"), F.lit("response")), F.concat(F.lit("sha1:"), F.col("payload_digest"))
    again = F.col("refers_to").isNotNull()
    host = F.coalesce(F.regexp_extract(url, r"^.*?://([^/?#]*)", 1), F.lit(""))
    target = F.regexp_extract(url, r"^.*?://[^/?#]*([^#]*)", 1)
    ask = F.concat(F.lit("GET "), F.when(F.coalesce(target, F.lit("")) == "", F.lit("/")).otherwise(target), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2))
    answer = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2), F.when(again, F.lit("")).otherwise(F.col("payload")))
    facts = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF), F.coalesce(F.concat(F.lit("refers-to-page: "), F.col("refers_to").cast("string"), F.lit(CRLF)), F.lit("")))

    def record(kind: Column, own: Column, mime: str, block: Column, *more: tuple[str, Column]) -> Column:
        return _header([("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", url), ("Content-Type", F.lit(mime)), *more], block)

    tie = ("WARC-Concurrent-To", rid)
    profile = F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    response = record(F.when(again, F.lit("revisit")).otherwise(F.lit("response")), rid, "application/http; msgtype=response", answer, ("WARC-Payload-Digest", digest), ("WARC-Profile", profile))
    request = record(F.lit("request"), _id(F.col("__row"), F.lit("request")), "application/http; msgtype=request", ask, tie)
    metadata = record(F.lit("metadata"), _id(F.col("__row"), F.lit("metadata")), "application/warc-fields", facts, tie)
    lines = df.select(F.explode(F.array(request, response, metadata)).alias("value"))
    lines.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with names in lower case, block) of each record of a WARC file, gzipped or not."""
    f = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while True:
        line = f.readline()
        while line in (b"\r\n", b"\n"):
            line = f.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("a record does not begin with WARC/")
        headers: dict[str, str] = {}
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", errors="replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, f.read(int(headers.get("content-length", 0)))


def _fields(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", errors="replace").split("\r\n") if ":" in x)}


RECORD = "type string, record_id string, concurrent_to string, target_uri string, date string, digest string, http string, fields map<string,string>, payload_bytes bigint, payload_sha1 string, payload binary"


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record. payload_bytes and payload_sha1 are measured on the block that was read; the
    payload itself comes along if asked for."""
    prepare(spark)
    schema = T._parse_datatype_string(RECORD)
    types = pa.schema([("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("digest", pa.string()), ("http", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for h, block in parse_archive(content.as_py()):
                    kind = h.get("warc-type", "")
                    http, body = None, block
                    if h.get("content-type", "").startswith("application/http"):
                        head, _, body = block.partition(b"\r\n\r\n")
                        http = head.decode("utf-8", errors="replace")
                    fields = _fields(block) if kind == "metadata" else _fields(http.encode()) if http else {}
                    rows.append((kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-payload-digest"), http, list(fields.items()), len(body), hashlib.sha1(body).hexdigest(), body if payload else None))
                    held += len(body) if payload else 0
                    if len(rows) >= 2000 or held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)], schema=types)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)], schema=types)

    whole = T._parse_datatype_string("path string, modificationTime timestamp, length bigint, content binary")
    files = spark.read.format("binaryFile").schema(whole).option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, schema)


def assemble_transactions(records: DataFrame) -> DataFrame:
    """capture_id and the structs request, response and metadata: one row per capture."""
    rest = F.struct(*[c for c in records.columns if c != "concurrent_to"])
    answer = F.col("type").isin("response", "revisit")
    keyed = records.select(F.when(answer, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("capture_id"), "type", "record_id", rest.alias("__record"))
    part = lambda kinds: F.min_by(F.when(F.col("type").isin(*kinds), F.col("__record")), F.when(F.col("type").isin(*kinds), F.col("record_id")))
    known = keyed.filter(F.col("type").isin("request", "response", "revisit", "metadata"))
    return known.groupBy("capture_id").agg(part(("request",)).alias("request"), part(("response", "revisit")).alias("response"), part(("metadata",)).alias("metadata"))


def warc_query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, read back from archives."""
    path = scratch(spark, "warc")
    write_warc(mark_revisits(pages.select("page_id", "url", "html")), path)
    rows = assemble_transactions(read_warc(spark, path, payload=False).drop("payload"))
    kind = F.col("response.type")
    fields = lambda part, name: F.element_at(F.col(f"{part}.fields"), F.lit(name))
    return rows.select(
        fields("metadata", "page-id").try_cast(pages.schema["page_id"].dataType.simpleString()).alias("page_id"),
        F.when(kind == "response", F.col("response.payload_bytes")).otherwise(fields("response", "content-length").cast("long")).alias("payload_bytes"),
        F.when(kind == "response", F.col("response.payload_sha1")).otherwise(F.substring_index("response.digest", ":", -1)).alias("payload_digest"),
        kind.alias("record_type"),
        fields("metadata", "refers-to-page").try_cast(pages.schema["page_id"].dataType.simpleString()).alias("refers_to"),
    )


WARC_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS b, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS first_id FROM p WHERE b >= {LEAST} GROUP BY d)
SELECT page_id, b AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d"""
