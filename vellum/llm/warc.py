"""WARC archives: a writer of one gzip member per record, and a splittable reader.

Writer: each task writes archives of its own into the shared folder and returns their paths and
sizes; only archives named by a task that ended well are in the manifest, so a lost or repeated
task leaves at worst a file that nobody reads. Of records with equal payloads of at least
`least` bytes the one with the smallest id is a response and the others are revisits of it.

Reader: an archive is cut into byte ranges. A task scans its range for the gzip magic, takes a
place for a member only if what it inflates to starts as a WARC header does, and owns the
records whose member starts inside the range, reading on past its end for the last of them.

A member that starts as a WARC record and then ends early, fails its checksum or does not parse is
no chance magic: reading stops with an error that names archive and offset, or, with
damaged="row", gives a row of record_type 'damaged' and goes on at the next member.

Defined cases: a null html is an empty payload; a very long one is one record, held whole by the task
that writes or reads it; a null url leaves its header out, a line break in one is percent-encoded and
everything else stands as it is; a null id counts as largest; ids that tie, and repeated rows, that
share the smallest id are all responses (of one record ID where the payload is the same too); an empty
table writes no archive and reads as no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST = 100
FILE_BYTES = 64 << 20
SPLIT_BYTES = 8 << 20
CHUNK = 1 << 20
MAGIC = b"\x1f\x8b\x08"
#: Bytes that are inflated to tell a record from chance magic.
PROBE = 4096
PAGE, REFERS = "X-Page-ID", "X-Refers-To-Page-ID"
READ_SCHEMA = "path string, start long, record_type string, page_id long, refers_to long, url string, payload binary, payload_bytes long, payload_digest string"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def decide(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Pages with digest, record_type and refers_to. Digests that occur once need no row on the other side of the join."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    first = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id")).where("n > 1")
    first = common.table(first.select(F.col("digest").alias("f_digest"), "first_id"), "warc-equal")
    rows = common.join_small(rows, first, F.col("digest") == F.col("f_digest"), "left")
    again = ~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull()
    return rows.select("page_id", "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"))


def record_id(kind: str, page_id, url: str | None, digest: str) -> str:
    """A URN from what a record holds; a revisit can thus name the response it refers to."""
    said = f"{kind}|{page_id}|{digest}" + ("" if kind == "response" else f"|{url}")
    return uuid.uuid5(uuid.NAMESPACE_URL, said).urn


def record(page_id, url, html: str, digest: str, kind: str, refers_to) -> bytes:
    payload = html.encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(kind, page_id, url, digest)}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if page_id is not None:
        lines.append(f"{PAGE}: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id('response', refers_to, None, digest)}>", f"{REFERS}: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes decided rows as archives; returns the manifest: path, size, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        out, done, name, size, n = None, [], "", 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, size, n = system.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                z = zlib.compressobj(6, wbits=31)
                member = z.compress(record(row["page_id"], row["url"], row["html"], row["digest"], row["record_type"], row["refers_to"])) + z.flush()
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= file_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], ["path", "size", "records"])

    return common.table(rows.mapInArrow(run, "path string, size long, records long"), "warc-manifest")


class Damaged(ValueError):
    """A member that starts as a record and cannot be read to its end."""


def members(f, start: int, end: int, skip: bool = False) -> Iterator[tuple[int, bytes | None]]:
    """(offset, inflated bytes) of the members of an open file that start in [start, end); None for a damaged one, where such are skipped."""
    at = start
    f.seek(at)
    buf = bytearray()  # the file's bytes from `at` on
    while at < end:
        while len(buf) < PROBE and (more := f.read(CHUNK)):
            buf += more
        k = buf.find(MAGIC)
        if k:
            step = k if k > 0 else len(buf) - len(MAGIC) + 1
            if step <= 0 or k < 0 and len(buf) < PROBE:
                return  # the file's last bytes hold no magic
            at += step
            del buf[:step]
            continue
        probe = zlib.decompressobj(wbits=31)
        try:
            seen = probe.decompress(buf[:PROBE], 5)
            chance = not b"WARC/".startswith(seen) or len(seen) < 5 and (probe.eof or len(buf) >= PROBE)
        except zlib.error:
            chance = True
        if chance:
            at += 1
            del buf[:1]
            continue
        z, parts, fed, fault = zlib.decompressobj(wbits=31), [], 0, ""
        while not z.eof and not fault:
            if fed == len(buf):
                buf += (more := f.read(CHUNK))
                fault = "" if more else "ends early"
            data, fed = buf[fed : fed + CHUNK], min(len(buf), fed + CHUNK)
            try:
                parts.append(z.decompress(data))
            except zlib.error as e:
                fault = str(e)
        if fault and not skip:
            raise Damaged(f"the record at byte {at}: {fault}")
        yield at, None if fault else b"".join(parts)
        used = 1 if fault else fed - len(z.unused_data)
        at += used
        del buf[:used]


def parse(raw: bytes) -> dict:
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    size = int(fields["Content-Length"])
    if len(block) < size:
        raise Damaged(f"{fields['WARC-Record-ID']} is shorter than it says")
    http, _, payload = block[:size].partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    number = lambda name: int(fields[name]) if name in fields else None
    said = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and hashlib.sha256(payload).hexdigest() != said:
        raise Damaged(f"the payload of {fields['WARC-Record-ID']} does not have its digest")
    length = len(payload) if kind == "response" else int(re.search(rb"(?m)^Content-Length: (\d+)", http)[1])
    return {"record_type": kind, "page_id": number(PAGE), "refers_to": number(REFERS), "url": fields.get("WARC-Target-URI"), "payload": payload if kind == "response" else None, "payload_bytes": length, "payload_digest": said}


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payload: bool = True, damaged: str = "fail") -> DataFrame:
    """The records of the archives that the manifest names (path, size), read by byte ranges. damaged: 'fail', or 'row' for a row of record_type 'damaged'."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = manifest.sparkSession
    arrow = to_arrow_schema(StructType.fromDDL(READ_SCHEMA))
    skip = damaged == "row"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                system, name = _open(path)
                rows, held = [], 0
                with system.open_input_file(name) as f:
                    try:
                        for at, raw in members(f, start, end, skip):
                            try:
                                rows.append(({"record_type": "damaged"} if raw is None else parse(raw)) | {"path": path, "start": at})
                            except (ValueError, KeyError, TypeError) as e:
                                if not skip:
                                    raise Damaged(f"the record at byte {at}: {e}") from e
                                rows.append({"record_type": "damaged", "path": path, "start": at})
                            if not payload:
                                rows[-1]["payload"] = None
                            held += len(raw or b"")
                            if held >= 4 << 20:
                                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                                rows, held = [], 0
                    except Damaged as e:
                        raise Damaged(f"{path}: {e}") from e
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    ranges = manifest.where("size > 0").select("path", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(split_bytes))).alias("start"))
    ranges = ranges.select("path", "start", (F.col("start") + split_bytes).alias("end"))
    n = max(1, min(ranges.count(), 8 * spark.sparkContext.defaultParallelism))
    return ranges.repartition(n).mapInArrow(run, READ_SCHEMA)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write(decide(common.read(spark, sf_dir, "pages")), common.scratch(spark, "warc"))
    return read_archives(manifest, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM h WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT h.page_id, payload_bytes, h.payload_digest,
  CASE WHEN first_id IS NULL OR h.page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id IS NULL OR h.page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM h LEFT JOIN f ON h.payload_digest = f.payload_digest
"""
