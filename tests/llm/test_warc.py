"""Archives: round trip, and records that payloads only seem to hold."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from factloom.llm import warc


def expected(pages):
    last = {}
    for page_id, _, html in pages:
        html = html or ""
        if page_id is not None and (html not in last or last[html] is None or page_id > last[html]):
            last[html] = page_id
        last.setdefault(html, None)
    out = []
    for page_id, _, html in pages:
        data = (html or "").encode()
        revisit = last[html or ""] is not None and last[html or ""] != page_id
        out.append((page_id, len(data), warc.digest_of(data), "revisit" if revisit else "response", last[html or ""] if revisit else None))
    return sorted(out, key=repr)


def pages():
    inner = warc.record(77, "http://x/", b"inner payload", None, False).decode()
    rows = [(i, f"http://h/{i}", f"page {i} " * (i % 50)) for i in range(120)]
    rows += [(200 + i, "http://h/ä b\r\nWARC-Type: x", inner * (i + 1)) for i in range(6)]
    rows += [(300, None, None), (301, "u", ""), (302, "u", "WARC/1.1\r\n"), (303, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n"), (304, "u", "é" * 5000), (None, "u", "no id"), (None, "u", "page 1 "), (5, "u", "page 5 " * 5), (5, "u", "page 5 " * 5)]
    rows += [(400 + i, "u", "same for many") for i in range(60)]
    return rows


@pytest.mark.parametrize(("chunk", "compress"), [(64, False), (64, True), (700, True), (1 << 20, False), (1 << 20, True)])
def test_round_trip(spark, chunk, compress):
    df = spark.createDataFrame(pages(), "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    files = warc.write_warc(df, warc.new_folder(spark), compress=compress)
    got = warc.described(warc.read_warc(files, chunk))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(pages())


def test_min_bytes(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id bigint, url string, html string")
    got = warc.described(warc.read_warc(warc.write_warc(df, warc.new_folder(spark), min_bytes=3)))
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got.collect()) == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]


def test_no_rows(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.described(warc.read_warc(warc.write_warc(df, warc.new_folder(spark)))).collect() == []


def test_members_inside_members():
    """A record whose stored payload holds whole members: only the outer chain is followed."""
    inner = warc.member(warc.record(9, "u", b"x" * 50, None, False))
    outer = [warc.member(warc.record(i, "u", inner * 3, None, False), level=0) for i in range(4)]
    data = b"".join(outer)
    assert gzip.decompress(data).count(b"WARC/1.1") == 4
    found = warc.candidates(data, 0, 0, len(data))
    assert len(found) == 20
    at, seen = 0, []
    follow = {o: s for o, s, _ in found}
    while at < len(data):
        seen.append(at)
        at = follow[at]
    assert seen == [sum(map(len, outer[:i])) for i in range(4)]


def test_digest():
    assert warc.digest_of(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert len(hashlib.sha1(b"x").digest()) == 20
