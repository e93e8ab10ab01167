"""Web archives: write page tables as WARC 1.1 files, read archives back, and
assemble the records of each capture.

``write_archives`` emits a request, a response (or revisit) and a metadata
record per page through Spark's text writer: a record is one text value and the
line separator is the record's last line end, so the gzip files are plain WARC.
``read_records`` walks whole files by Content-Length, so a payload that itself
looks like a record does no harm.  ``captures`` joins request, response and
metadata records through their concurrent-to identifiers into nested rows.

Defined results: null html is an empty payload; null page ids are kept (and
come after all others when the smallest id of equal payloads is sought); of
repeated rows with that id one is the response, the others revisit it; null
urls are written as empty; an empty table gives an archive without records;
other columns are ignored.  Companion records whose capture is absent belong to
no capture and stay in ``read_records`` only.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: smallest payload (bytes) that a revisit record may stand for
REVISIT_FROM = 100
#: pages whose records share an archive file at most
PAGES_PER_FILE = 8192
STAMP = "2024-01-01T00:00:00Z"
CRLF = "\r\n"

RECORD_SCHEMA = ("record_id string, type string, concurrent_to string, refers_to string, target_uri string, "
                 "stamp string, declared_digest string, declared_bytes long, head string, payload binary")


def _record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column, block: Column, fields: list[tuple[str, Column]]) -> Column:
    """Text of a record up to its last line end; fields with null are left out."""
    lines = [F.lit("WARC/1.1" + CRLF + "WARC-Type: "), kind, F.lit(CRLF)]
    for name, value in fields:
        lines.append(F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(CRLF)), F.lit("")))
    lines += [F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block, F.lit(CRLF)]
    return F.concat(*lines)


def decide(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """``page_id, url, html, digest, first_id, role``: which pages are written as
    responses and which revisit an equal payload's smallest page id."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]", " ").alias("url"),
                        html.alias("html")).withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    rows = rows.withColumn("_key", F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "digest"))
    sized = rows.where(F.octet_length("html") >= revisit_from)
    shared = (sized.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("_n"))
              .where("_n > 1").drop("_n"))
    marks = (sized.select("_key", "digest").distinct().join(shared, "digest")
             .select(F.col("_key").alias("_k"), "first_id", F.lit(True).alias("_shared")))
    # one key for the join and the numbering: the payloads move once
    joined = rows.join(marks, F.col("_key") == F.col("_k"), "left")
    copy = F.row_number().over(Window.partitionBy("_key").orderBy("url"))
    first = F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("_copy") == 1)
    return (joined.withColumn("_copy", copy)
            .withColumn("role", F.when(F.col("_shared").isNull() | first, "response").otherwise("revisit"))
            .withColumn("response_id", F.when(F.col("_shared"), _record_id(
                F.lit("first"), F.coalesce(F.col("first_id").cast("string"), F.lit("-")), F.col("digest"))))
            .select("page_id", "url", "html", "digest", "role", "response_id", "_copy"))


def write_archives(pages: DataFrame, path: str, revisit_from: int = REVISIT_FROM, stamp: str = STAMP) -> None:
    """Write the pages' records as gzip WARC files below ``path``."""
    d = decide(pages, revisit_from)
    own = _record_id(F.lit("page"), F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.col("digest"),
                     F.col("_copy").cast("string"), F.col("url"))
    revisit = F.col("role") == "revisit"
    d = d.withColumn("id", F.when(revisit | F.col("response_id").isNull(), own).otherwise(F.col("response_id")))
    shared = [("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(stamp))]
    head = F.concat(F.lit(CRLF.join(("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "))),
                    F.octet_length("html").cast("string"), F.lit(CRLF + CRLF))
    request = _record(F.lit("request"), F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1" + CRLF + CRLF)), [
        ("WARC-Record-ID", _record_id(F.lit("request"), F.col("id"))), *shared,
        ("WARC-Concurrent-To", F.col("id")), ("Content-Type", F.lit("application/http; msgtype=request"))])
    answer = _record(F.col("role"), F.when(revisit, head).otherwise(F.concat(head, F.col("html"))), [
        ("WARC-Record-ID", F.col("id")), *shared,
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("WARC-Refers-To", F.when(revisit, F.col("response_id"))),
        ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("Content-Type", F.lit("application/http; msgtype=response"))])
    about = _record(F.lit("metadata"), F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
                                                F.lit(CRLF)), [
        ("WARC-Record-ID", _record_id(F.lit("metadata"), F.col("id"))), *shared,
        ("WARC-Concurrent-To", F.col("id")), ("Content-Type", F.lit("application/warc-fields"))])
    (d.select(F.explode(F.array(request, answer, about)).alias("value"))
     .write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", 3 * PAGES_PER_FILE)
     .text(path))


def _unpacked(content: bytes, step: int = 1 << 20):
    """Chunks of a file's bytes; gzip files of any number of members are inflated."""
    view = memoryview(content)
    if content[:2] != b"\x1f\x8b":
        for i in range(0, len(view), step):
            yield bytes(view[i:i + step])
        return
    inflater = zlib.decompressobj(31)
    for i in range(0, len(view), step):
        data = bytes(view[i:i + step])
        while data:
            yield inflater.decompress(data)
            data = inflater.unused_data
            if inflater.eof and data:
                inflater = zlib.decompressobj(31)


def parse(chunks):
    """Records of a byte stream as (header dict, block); a cut-off or malformed
    record raises."""
    held = bytearray()
    chunks = iter(chunks)

    def fill(least: int) -> bool:
        while len(held) < least:
            chunk = next(chunks, None)
            if chunk is None:
                return False
            held.extend(chunk)
        return True

    while True:
        while held[:2] == b"\r\n" or (len(held) < 2 and fill(2) and held[:2] == b"\r\n"):
            del held[:2]
        if not held and not fill(1):
            return
        at, seen = -1, 0
        while (at := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not fill(seen + 1):
                raise ValueError("archive ends inside a record's header")
        lines = held[:at].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        head = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        end = at + 4 + int(head["content-length"])
        if not fill(end):
            raise ValueError("archive ends inside a record's block")
        block = bytes(held[at + 4:end])
        del held[:end]
        yield head, block


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``: ids, declared digest,
    the payload (HTTP body of responses and requests, block of others) and the
    length that its HTTP header declares."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    names = [f.split(" ")[0] for f in RECORD_SCHEMA.split(", ")]

    def records(batches):
        rows, held = [], 0
        for batch in batches:
            for content in batch.column(0):
                for head, block in parse(_unpacked(content.as_py())):
                    declared, http, payload = None, None, block
                    if head.get("content-type", "").startswith("application/http"):
                        raw, _, payload = block.partition(b"\r\n\r\n")
                        http = raw.decode("utf-8", "replace")
                        for line in http.split(CRLF)[1:]:
                            name, _, value = line.partition(":")
                            if name.strip().lower() == "content-length":
                                declared = int(value)
                    digest = head.get("warc-payload-digest")
                    rows.append((head.get("warc-record-id"), head.get("warc-type"), head.get("warc-concurrent-to"),
                                 head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"),
                                 digest and digest.partition(":")[2], declared, http, payload))
                    held += len(payload) + 500
                    if held > 8_000_000:
                        yield pack(rows)
                        rows, held = [], 0
        if rows:
            yield pack(rows)

    def pack(rows):
        kinds = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return files.mapInArrow(records, RECORD_SCHEMA)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit record: ``record_id, type,
    response, requests, metadata`` (structs of all other columns)."""
    rest = [c for c in records.columns if c not in ("record_id", "type", "concurrent_to")]
    whole = F.struct("record_id", *rest)
    anchors = (records.where(F.col("type").isin("response", "revisit"))
               .select("record_id", "type", whole.alias("response")))
    companions = (records.where(~F.col("type").isin("response", "revisit") & F.col("concurrent_to").isNotNull())
                  .groupBy("concurrent_to")
                  .agg(F.collect_list(F.when(F.col("type") == "request", whole)).alias("requests"),
                       F.collect_list(F.when(F.col("type") == "metadata", whole)).alias("metadata")))
    return (anchors.join(companions, anchors["record_id"] == companions["concurrent_to"], "left")
            .drop("concurrent_to"))


def page_digests(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the
    archives below ``path``: responses are measured, revisits take the length
    and digest they declare."""
    records = read_records(spark, path)
    told = F.col("type") == "revisit"
    narrow = records.select(
        "record_id", "type", "concurrent_to", "refers_to",
        F.when(told, F.col("declared_bytes")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(told, F.col("declared_digest")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        F.when(F.col("type") == "metadata", F.col("payload").cast("string")).alias("about"))
    page = F.nullif(F.regexp_extract(F.col("metadata")[0]["about"], r"page_id: (-?\d*)", 1), F.lit("")).cast("long")
    rows = captures(written(narrow, "records")).select(
        "record_id", page.alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("type").alias("record_type"),
        F.col("response.refers_to").alias("_to"))
    rows = written(rows, "captures")
    targets = (rows.join(rows.where("_to IS NOT NULL").select(F.col("_to").alias("record_id")).distinct(), "record_id",
                         "left_semi").select(F.col("record_id").alias("_to"), F.col("page_id").alias("refers_to")))
    return (rows.join(targets, "_to", "left")
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
