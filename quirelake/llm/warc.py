"""WARC archives: written with segmented and chunked records, and reassembled when read.

Writing: payloads of at least a least size that occur more than once are stored by the record with
the smallest page id; the others become revisit records that refer to its record id. A response's HTTP
message carries its body in chunked transfer framing. A record whose block is larger than a segment is
split: the first segment keeps the record's type, the rest are continuation records that name it as
their origin, number themselves, and the last tells the total length. Every record is a gzip member of
its own, so that one can be read from its offset alone. Spark's text writer puts the members into
files of a bounded number of records, in the shared folder, with its commit protocol: a member's last
byte, the highest of its size and so zero, is left to the writer as line separator.

Reading: each file is parsed by its records' content lengths. Segments are grouped by the identifier
of their origin, ordered by number, checked against the total length, and joined; then the HTTP
message is parsed and its chunks are decoded. A revisit takes its payload's length from the record
that it refers to.

Defined results: a null payload is empty; a null url is an empty target. A row without a page id is a
response of its own, which no other refers to, and has none when read. Rows that share a page id and a
payload are each a response or each a revisit. A segmented record with a segment missing or repeated, a
wrong total, or broken chunk framing has a null payload and ``verified`` false, as has one whose digest
differs from the declared one; a revisit whose record is not there has no payload bytes. An empty table
writes no record and gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, shared_path, sized, staged

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
RECORDS_A_FILE = 2000
#: Records and bytes of a batch that Python hands on at once.
BATCH_RECORDS, BATCH_BYTES = 500, 4 << 20
CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes | None:
    """The body in chunked framing, or None where the framing is broken."""
    out, at = [], 0
    while True:
        end = framed.find(CRLF, at)
        if end < 0:
            return None
        try:
            n = int(framed[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        at = end + 2
        if n == 0:
            return b"".join(out)
        if n < 0 or framed[at + n : at + n + 2] != CRLF:
            return None
        out.append(framed[at : at + n])
        at += n + 2


def payload_of(message: bytes) -> bytes | None:
    """The body of an HTTP message, without transfer framing."""
    head, found, body = message.partition(b"\r\n\r\n")
    if not found:
        return None
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (line.partition(b":") for line in head.split(CRLF)[1:])}
    return unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def record(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in {**fields, "Content-Length": str(len(block))}.items())
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block + CRLF + CRLF


def member(data: bytes) -> bytes:
    """A gzip member without its last byte where that is zero; a zero byte more is padding to readers."""
    z = zlib.compressobj(wbits=31)
    whole = z.compress(data) + z.flush()
    return whole[:-1] if whole[-1] == 0 else whole


def record_id(page_id: int, digest: str, copy: int = 0) -> str:
    return f"<urn:quirelake:page:{page_id}:{digest}:{copy}>"


def records_of(page_id: int | None, own: str, url: str | None, payload: bytes, refers_to: str | None, date: str, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of a page, whose first has the id ``own``."""
    digest = hashlib.sha256(payload).hexdigest()
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    page = {} if page_id is None else {"WARC-Page-ID": str(page_id)}
    fields = {"WARC-Type": "response", "WARC-Record-ID": own, "WARC-Date": date, **page, "WARC-Target-URI": target, "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http;msgtype=response"}
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        yield record(fields | {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": refers_to}, head + CRLF)
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield record(fields, block)
        return
    yield record(fields | {"WARC-Segment-Number": "1"}, block[:segment])
    for k, at in enumerate(range(segment, len(block), segment), 2):
        part = {"WARC-Type": "continuation", "WARC-Record-ID": f"{own[:-1]}:segment:{k}>", "WARC-Date": date, "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": str(k)}
        if at + segment >= len(block):
            part["WARC-Segment-Total-Length"] = str(len(block))
        yield record(part, block[at : at + segment])


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an uncompressed archive."""
    at = 0
    while archive.startswith(b"WARC/", at):
        end = archive.index(b"\r\n\r\n", at)
        lines = archive[at:end].decode("utf-8").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        at = end + 4
        n = int(fields["content-length"])
        yield fields, archive[at : at + n]
        at += n + 4


def write(pages: DataFrame, path: str, id_col: str = "page_id", least: int = 100, segment: int = SEGMENT_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record per row of pages(id_col, url, html) into archives under ``path``.

    ``date`` is the WARC-Date of all records, as pages do not tell when they were fetched.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    known = staged(rows.where("id is not null").select("id", "digest", (F.octet_length("payload") >= least).alias("large")), "digests")
    firsts = known.where("large").groupBy("digest").agg(F.min("id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1")
    revisits = known.join(firsts, "digest").where("id != refers_to").select("id", "digest", "refers_to", F.lit(False).alias("again"))
    repeated = known.groupBy("id", "digest").agg(F.count("*").alias("n")).where("n > 1").select("id", "digest", F.lit(None).cast("long").alias("refers_to"), F.lit(True).alias("again"))
    marks = staged(revisits.unionByName(repeated).groupBy("id", "digest").agg(F.max("refers_to").alias("refers_to"), F.max("again").alias("again")), "revisits")
    marked = rows.join(sized(marks), ["id", "digest"], "left").withColumn("copy", F.lit(0))
    if not marks.where("again").isEmpty():  # rows that share page id and payload are told apart by number
        number = F.row_number().over(Window.partitionBy("id", "digest").orderBy("url")) - 1
        marked = marked.where("again is null or not again").unionByName(marked.where("again").withColumn("copy", number))

    def built(batches):
        task, n, out, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            for page, digest, copy, url, body, to in zip(*(b[c].to_pylist() for c in ("id", "digest", "copy", "url")), b["payload"], b["refers_to"].to_pylist(), strict=True):
                n += 1
                own = f"<urn:quirelake:task:{task}:{n}>" if page is None else record_id(page, digest, copy)
                for r in records_of(page, own, url, body.as_py(), None if to is None else record_id(to, digest), date, segment):
                    out.append(member(r))
                    size += len(out[-1])
                    if len(out) == BATCH_RECORDS or size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    made = arrow_map(marked.select("id", "digest", "copy", "url", "payload", "refers_to"), built, "value binary")
    made.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


READ_SCHEMA = "page_id long, type string, url string, declared string, refers string, origin string, segment int, total long, block binary, payload_bytes long, payload_digest string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, verified), a row per record."""

    def parsed(batches):
        for b in batches:
            for content in b["content"]:
                rows = []
                for f, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())).read()):
                    kind, part, n, sha = f["warc-type"], f.get("warc-segment-number"), None, None
                    whole = part is None and kind == "response"
                    if whole and (body := payload_of(block)) is not None:
                        n, sha = len(body), hashlib.sha256(body).hexdigest()
                    page = f.get("warc-page-id")
                    declared = f.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    rows.append((page and int(page), kind, f.get("warc-target-uri"), declared, f.get("warc-refers-to"), f.get("warc-segment-origin-id") or f["warc-record-id"], part and int(part), (t := f.get("warc-segment-total-length")) and int(t), block if part else None, n, sha))
                    if len(rows) == 200:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    def batch(rows):
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
        names = [x.split(" ")[0] for x in READ_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,gz}").load(path).select("content")
    records = staged(arrow_map(files, parsed, READ_SCHEMA), "records")

    told = ["page_id", "url", "declared", "payload_bytes", "payload_digest"]

    # one origin's segments are one record, so a group is no larger than a page
    joined = records.where("segment is not null").groupBy("origin").agg(
        F.max("page_id").alias("page_id"), F.max("url").alias("url"), F.max("declared").alias("declared"), F.max("total").alias("total"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )

    def reassembled(batches):
        for b in batches:
            rows = []
            for origin, page, url, declared, total, parts in zip(*(b[c] for c in ("origin", "page_id", "url", "declared", "total", "parts")), strict=True):
                parts, n, sha = parts.as_py(), None, None
                block = b"".join(p["block"] for p in parts)
                if [p["segment"] for p in parts] == list(range(1, len(parts) + 1)) and len(block) == total.as_py() and (body := payload_of(block)) is not None:
                    n, sha = len(body), hashlib.sha256(body).hexdigest()
                rows.append((origin.as_py(), page.as_py(), url.as_py(), declared.as_py(), n, sha))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["origin", *told])

    responses = records.where("segment is null and type = 'response'").select("origin", *told)
    responses = responses.unionByName(arrow_map(joined, reassembled, "origin string, page_id long, url string, declared string, payload_bytes long, payload_digest string"))
    responses = responses.withColumn("verified", F.coalesce(F.col("payload_digest") == F.col("declared"), F.lit(False)))
    revisits = records.where("type = 'revisit'").select("page_id", "url", "refers", "declared")
    known = responses.where("verified").select(F.col("origin").alias("refers"), F.col("page_id").alias("refers_to"), "declared", "payload_bytes")
    revisits = revisits.join(known, ["refers", "declared"], "left").select("page_id", "url", F.lit("revisit").alias("record_type"), "refers_to", "payload_bytes", F.col("declared").alias("payload_digest"), F.col("payload_bytes").isNotNull().alias("verified"))
    return responses.select("page_id", "url", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "payload_bytes", "payload_digest", "verified").unionByName(revisits)


def archive(pages: DataFrame, **settings) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    path = shared_path(pages.sparkSession, "warc")
    write(pages, path, **settings)
    return read(pages.sparkSession, path)
