"""WARC archives with duplicate payloads as revisit records.

Resolution moves headers only: (id, payload digest, payload size) are grouped
by digest, the response with the largest id becomes the original, and every
other record of the digest is joined to it by its own id, so a digest with a
third of all records is not gathered in one task. Archives are then written
with fresh headers by Spark's committing file writer, one gzip file per
task, as plain WARC/1.1: a record ends with two line ends, which is the writer's
line separator, and Spark passes bytes through unchanged. gzip files are not
split, so the reader sees each file in order: it splits at the same separator,
and a streaming parser joins the parts again and cuts them by Content-Length,
holding one record at a time. It works on any file system that Spark reads.

Cases: null payload counts as empty; null urls are written as a name made of the
id; line ends in urls are percent-encoded; records repeated with one id and one
payload are alike (all responses if the id is the largest); a null id is only
an original if its digest has no other; empty tables give an empty result (and
an empty archive); further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Digits of numbers in base 32 as SQL writes them, and those of RFC 4648.
BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
#: Payload bytes after which the reader sends on a batch.
BATCH_BYTES = 4 << 20

READ_SCHEMA = ("record_type string, record_id string, target_uri string, date string, payload_digest string, "
               "refers_to string, payload_bytes long, payload binary")


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of a binary column, 20 bits at a time."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), *BASE32)


def headers(pages: DataFrame) -> DataFrame:
    """page_id, payload_digest, payload_bytes of each record."""
    return pages.select("page_id", payload_digest(F.col("payload")).alias("payload_digest"),
                        F.octet_length("payload").cast("long").alias("payload_bytes"))


def resolve_revisits(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The records that revisit another: page_id, payload_digest, refers_to.

    ``heads``: page_id, payload_digest, payload_bytes. Payloads under
    ``min_bytes`` are never revisited.
    """
    heads = heads.where(F.col("payload_bytes") >= min_bytes)
    originals = (heads.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
                 .where("n > 1").drop("n"))
    return (heads.select("page_id", "payload_digest").join(originals, "payload_digest")
            .where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct())


def record_urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def record_bytes(date: str) -> Column:
    """A whole record, without its last line ends, from columns page_id, url,
    payload, payload_digest, payload_bytes and refers_to (null in responses)."""
    is_revisit = F.col("is_revisit")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(END))
    uri = F.coalesce(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"),
                     F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    lines = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(is_revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), record_urn(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(is_revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), record_urn(F.col("refers_to")),
                                    F.lit(f"\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.when(is_revisit, F.lit(0).cast("long")).otherwise(F.col("payload_bytes"))).cast("string"),
        F.lit(END), http)
    return F.concat(lines.cast("binary"), F.when(is_revisit, F.lit(b"")).otherwise(F.col("payload")))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per row of (page_id, url, payload) to gzip files under ``path``."""
    pages = pages.select("page_id", "url", "payload")
    revisits = (resolve_revisits(headers(pages), min_bytes)
                .select(F.col("page_id").alias("r_id"), F.col("payload_digest").alias("r_digest"), "refers_to"))
    full = pages.withColumns({"payload_digest": payload_digest(F.col("payload")),
                              "payload_bytes": F.octet_length("payload").cast("long")})
    (full.join(revisits, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("payload_digest") == F.col("r_digest")), "left")
     .withColumn("is_revisit", F.col("r_digest").isNotNull())
     .select(record_bytes(date).cast("string").alias("value"))
     .write.mode("errorifexists").option("lineSep", END).option("compression", "gzip").text(path))


def _fields(head: bytes) -> dict:
    """Header fields by lower-case name; the first line is the version."""
    return {k.strip().lower(): v.strip() for k, _, v in
            (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _record(head: dict, block: bytes, with_payload: bool) -> dict:
    http, _, payload = block.partition(END.encode())
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    revisit = head["warc-type"] == "revisit"
    if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"the payload of {head['warc-record-id']} does not have its digest")
    return {"record_type": head["warc-type"], "record_id": head["warc-record-id"].strip("<>"),
            "target_uri": head["warc-target-uri"], "date": head["warc-date"], "payload_digest": digest,
            "refers_to": head["warc-refers-to"].strip("<>") if revisit else None,
            "payload_bytes": int(_fields(http)["content-length"]),
            "payload": payload if with_payload and not revisit else None}


def _read(parts, with_payload: bool):
    """Records from the parts of archives between separators, in order.

    Parts are joined by the separator again and cut by Content-Length alone, so
    payloads may hold or end in anything. Line ends between records are skipped:
    the last part of a file may have had no separator after it.
    """
    end = END.encode()
    held, head, need = bytearray(), None, 0
    for part in parts:
        held += part
        held += end
        while True:
            if head is None:
                del held[:len(held) - len(held.lstrip(b"\r\n"))]
                at = held.find(end)
                if at < 0:
                    break
                if not held.startswith(b"WARC/1."):
                    raise ValueError(f"no record starts with {bytes(held[:40])!r}")
                head = _fields(bytes(held[:at]))
                need = int(head["content-length"])
                del held[:at + 4]
            if len(held) < need + 4:
                break
            if held[need:need + 4] != end:
                raise ValueError(f"{head.get('warc-record-id')} is longer than its Content-Length")
            yield _record(head, bytes(held[:need]), with_payload)
            del held[:need + 4]
            head = None
    if head is not None or held:
        raise ValueError("an archive ends within a record")


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives under ``path``; digests of responses are checked."""
    schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()),
                        ("date", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        rows, held = [], 0
        for row in _read((v for b in batches for v in b.column(0).to_pylist()), with_payload):
            rows.append(row)
            held += 500 + len(row["payload"] or b"")
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    parts = spark.read.schema("value string").option("lineSep", END).text(path)
    return parts.select(F.col("value").cast("binary")).mapInArrow(run, READ_SCHEMA)


def page_of(urn: Column) -> Column:
    """The page id in a record's name."""
    return F.regexp_extract(urn, r"^urn:page:(-?\d+)$", 1).try_cast("long")
