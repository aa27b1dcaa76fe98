"""Archives: exact round trip, revisits, awkward payloads."""

import base64
import gzip
import hashlib
import os
import random
import tempfile

import pytest
from nasty import empty, sf_dir
from pyspark.sql import functions as F

from playlens.llm import queries, warc

PAGES = "page_id long, url string, html string"
PAYLOADS = ["", None, "a", "\r\n\r\n", "\r\n", "\r\n\r", "\r\n\r\r\n\r\n", "x\r\n\r\n\r\n\r\ny", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n",
            "é漢😀" * 2000, "end\r", "\n\r\n\r\n", "same", "same", "same", "long " * 200_000]


def pages(spark):
    rows = [(i, f"http://x/{i}" if i % 4 else None, p) for i, p in enumerate(PAYLOADS)]
    rows += [(90, "http://a\r\nb: c", "q"), (90, "http://a\r\nb: c", "q"), (91, "u", "late"), (-5, "u", "late"), (None, None, "nobody"), (None, "u", None)]
    return spark.createDataFrame(rows, PAGES)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_query_on_nasty_pages(spark):
    df = pages(spark)
    rows = df.collect()
    extra = df.withColumns({"payload": F.lit("x"), "payload_digest": F.lit("x"), "refers_to": F.lit("x"), "r_id": F.lit(1), "is_revisit": F.lit(1)})
    got = sorted(map(tuple, queries.op3_warc(spark, sf_dir(spark, pages=extra)).collect()), key=repr)
    last = {}
    for r in rows:
        d = digest(r.html)
        last[d] = max((x for x in (last.get(d), r.page_id) if x is not None), default=None)
    want = []
    for r in rows:
        d = digest(r.html)
        original = r.page_id == last[d]
        want.append((r.page_id, len((r.html or "").encode()), d, "response" if original else "revisit", None if original else last[d]))
    assert got == sorted(want, key=repr)
    assert queries.op3_warc(spark, sf_dir(spark, pages=empty(spark, PAGES))).count() == 0


def test_payloads_come_back_to_the_byte(spark):
    df = pages(spark).where("page_id is not null").select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    path = os.path.join(tempfile.mkdtemp(prefix="playlens-warc-", dir="/tmp"), "w")
    warc.write_archives(df.repartition(3), path)
    want = {r.page_id: bytes(r.payload) for r in df.collect()}
    by_digest = {digest(v.decode()): v for v in want.values()}
    got = warc.read_archives(spark, path).withColumn("page_id", warc.page_of(F.col("record_id"))).collect()
    for r in got:
        assert by_digest[r.payload_digest] == want[r.page_id]
        assert (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None:
            assert bytes(r.payload) == want[r.page_id]
    # plain WARC in gzip files: headers first, two line ends after each record
    raw = [gzip.open(os.path.join(path, f)).read() for f in os.listdir(path) if f.endswith(".gz")]
    assert all(x.startswith(b"WARC/1.1\r\nWARC-Type: ") and x.endswith(b"\r\n\r\n") for x in raw if x)


def test_small_payloads_are_never_revisited(spark):
    df = spark.createDataFrame([(1, "u", bytearray(b"ab")), (2, "u", bytearray(b"ab")), (3, "u", bytearray(b"abc")), (4, "u", bytearray(b"abc"))],
                               "page_id long, url string, payload binary")
    got = {r.page_id: r.refers_to for r in warc.resolve_revisits(warc.headers(df), min_bytes=3).collect()}
    assert got == {3: 4}


def test_damaged_archives_are_refused():
    for parts in ([b"junk"], [b"WARC/1.1\r\nContent-Length: 2", b"abc"], [b"WARC/1.1\r\nContent-Length: 20", b"abc"]):
        with pytest.raises(ValueError):
            list(warc._read(iter(parts), True))


def test_payloads_full_of_separators(spark):
    rng = random.Random(6)
    rows = [(i, "u", "".join(rng.choices(["\r", "\n", "\r\n", "x"], k=rng.choice([3, 50, 70_000])))) for i in range(60)]
    got = queries.op3_warc(spark, sf_dir(spark, pages=spark.createDataFrame(rows, PAGES).repartition(4))).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest) for r in got} == {i: (len(p), digest(p)) for i, _, p in rows}


def test_native_digest(spark):
    df = spark.createDataFrame([(p or "",) for p in PAYLOADS], "html string")
    for r in df.select("html", warc.payload_digest(F.col("html").cast("binary")).alias("d")).collect():
        assert r.d == digest(r.html)
