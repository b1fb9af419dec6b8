"""WARC archives: writing with revisit records, and reading by a verified chain of boundaries.

Writing: one file per task, under a name of the attempt and then renamed; the
content depends on the rows only. Of records with equal payloads of at least
``min_bytes`` that with the largest page_id is the response, the others revisit it.

A record is stored as a gzip member of its own, with the compressed and the full
length in the extra field "sl" of its header, or plain with ``compress=False``.

Reading: files are cut into ranges of ``chunk`` bytes. A task looks for the magic
(of a member or a plain record) in its range and emits, for each candidate, the
offset its header's length leads to, and
where the chain from it leaves the range. Pointer jumping from each file's start
over these exits, doubling the step each round, finds where the chain enters each
range; candidates that no chain reaches, such as the magic inside a payload, are
never records. A last pass reads each range from its entry.

Null html is an empty payload, null url an empty URI. Rows repeated with their
page_id and payload have the same role. A null page_id is a record without a
number; it is the response only if no record with an equal payload has one.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import Rows, own_shuffle, prepare, shared_folder, stage, values

MAGIC = b"WARC/1.1\r\n"
CHUNK = 8 << 20
MAX_HEADER = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
_ID = "urn:page:"
_GZIP = b"\x1f\x8b\x08\x04"
_MEMBER = struct.Struct("<4s4sBBH2sHII")  # magic, time, flags, system, extra length, "sl", its length, compressed length, full length
_MAGICS = re.compile(re.escape(MAGIC) + b"|" + re.escape(_GZIP))
_FIELD = re.compile(rb"^([!-9;-~]+):[ \t]*([^\r\n]*)\r$", re.M)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record with its trailing blank lines."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda x: f"<{_ID}{'' if x is None else x}>"
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
    ]
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"] if revisit else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return MAGIC + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A record as a gzip member that states its lengths."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = _MEMBER.pack(_GZIP, b"\0" * 4, 0, 255, 12, b"sl", 8, _MEMBER.size + len(body) + 8, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def successor(data: bytes, at: int) -> int | None:
    """Where the record at ``at`` says that the next one starts; None if no record's header is there."""
    if data.startswith(_GZIP, at):
        if at + _MEMBER.size > len(data):
            return None
        *_, extra, name, size, length, _ = _MEMBER.unpack_from(data, at)
        return at + length if (extra, name, size) == (12, b"sl", 8) and length > _MEMBER.size + 8 else None
    head = header_of(data, at)
    return head[1] + int(head[0]["content-length"]) + 4 if head else None


def header_of(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """Fields and end of the header at ``at``; None if it isn't one."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0 or end - at > MAX_HEADER or not data.startswith(MAGIC, at):
        return None
    fields = {m[1].decode().lower(): m[2].decode("utf-8", "replace").strip() for m in _FIELD.finditer(data, at + len(MAGIC), end + 1)}
    return (fields, end + 4) if fields.get("content-length", "").isascii() and fields.get("content-length", "").isdigit() else None


def roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages with refers_to and revisit. Only digests pass the first shuffle; hot ones are counted on the map side."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    many = rows.filter(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1")
    # stored, so that the join shuffles both sides and can split a hot payload
    out = rows.join(stage(many.select("digest", "last")), "digest", "left")
    revisit = F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("page_id"))
    return out.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("last")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, compress: bool = True) -> DataFrame:
    """Writes the archives; gives a row per file: file, bytes, records."""
    prepare(pages.sparkSession)
    schema = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = pafs.FileSystem.from_uri(folder)
        name = f"part-{task.partitionId():08d}.warc{'.gz' if compress else ''}"
        trial = f"{base}/.{name}-{task.taskAttemptId()}"
        size = n = 0
        store.create_dir(base, recursive=True)
        with store.open_output_stream(trial, buffer_size=1 << 20) as f:
            for batch in batches:
                for page_id, url, html, revisit, refers_to in values(batch, "page_id", "url", "html", "revisit", "refers_to"):
                    data = record(page_id, url, html.encode(), refers_to, revisit)
                    data = member(data) if compress else data
                    f.write(data)
                    size += len(data)
                    n += 1
        out = Rows(schema)
        if n:
            store.move(trial, f"{base}/{name}")
            out.add((f"{folder}/{name}", size, n))
        else:
            store.delete_file(trial)
        yield out.take()

    # repeated tasks write the same bytes: rows of a partition have a fixed order
    ordered = roles(pages, min_bytes).sortWithinPartitions("page_id", "url", F.xxhash64("html"))
    return stage(ordered.mapInArrow(write, "file string, bytes bigint, records bigint"))


def candidates(data: bytes, base: int, lo: int, hi: int) -> list[tuple[int, int, int | None]]:
    """(offset, successor, exit) of all candidates that start in [lo, hi); ``data`` starts at ``base``.

    The exit is the first offset at or after ``hi`` on the chain, None if the chain breaks inside.
    """
    found: list[tuple[int, int]] = []
    for m in _MAGICS.finditer(data, lo - base):
        if m.start() >= hi - base:
            break
        after = successor(data, m.start())
        if after is not None:
            found.append((m.start() + base, base + after))
    exits: dict[int, int | None] = {}
    for offset, after in reversed(found):
        exits[offset] = after if after >= hi else exits.get(after)
    return [(o, s, exits[o]) for o, s in found]


def _ranges(files: DataFrame, chunk: int) -> DataFrame:
    cuts = files.filter("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(chunk).cast("bigint"))).alias("lo"))
    return cuts.select("file", "bytes", "lo", F.least(F.col("lo") + chunk, "bytes").alias("hi"))


def _scan(chunk: int):
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("next", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in batches:
            for uri, size, lo, hi in values(batch, "file", "bytes", "lo", "hi"):
                store, path = pafs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as f:
                    f.seek(lo)
                    data = f.read(min(hi + MAX_HEADER, size) - lo)
                for offset, _, leaves in candidates(data, lo, lo, hi):
                    if leaves is not None:
                        out.add((uri, offset, leaves))
                if out.full():
                    yield out.take()
        yield out.take()

    return run


def entries(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Where the chain of each file enters its ranges: file, offset. Offset 0 always is an entry."""
    ranges = _ranges(files, chunk)
    totals = files.agg(F.count("*").alias("n"), F.max(F.ceil(F.col("bytes") / chunk)).alias("most")).first()
    parts = max(1, ranges.count())
    jump = stage(ranges.repartition(parts).mapInArrow(_scan(chunk), "file string, offset bigint, next bigint"))
    # only candidates that some chain enters a range by can be entries
    aims = jump.select("file", F.col("next").alias("offset")).union(jump.filter("offset = 0").select("file", "offset")).distinct()
    jump = jump.join(aims, ["file", "offset"], "left_semi")
    reached = files.filter("bytes > 0").select("file", F.lit(0).cast("bigint").alias("offset"))
    for _ in range(max(1, math.ceil(math.log2((totals.most or 0) + 1)))):
        ahead = reached.join(jump, ["file", "offset"]).select("file", F.col("next").alias("offset"))
        reached = stage(reached.union(ahead).distinct())
        after = jump.select("file", F.col("offset").alias("next"), F.col("next").alias("after"))
        jump = stage(jump.join(after, ["file", "next"]).select("file", "offset", F.col("after").alias("next")))
    return reached.join(files.select("file", "bytes"), "file").filter("offset < bytes").select("file", "bytes", "offset")


def _whole(f, uri: str, at: int) -> tuple[bytes, int]:
    """The plain bytes of the record at ``at``, and where the next one starts."""
    f.seek(at)
    data = f.read(4096)
    while (after := successor(data, 0)) is None:
        more = f.read(len(data)) if len(data) <= 2 * MAX_HEADER else b""
        if not more:
            raise ValueError(f"{uri}: no record at {at}")
        data += more
    data += f.read(after - len(data)) if after > len(data) else b""
    data = data[:after]
    return (zlib.decompress(data, 31) if data.startswith(_GZIP) else data), at + after


PARSED = "page_id bigint, url string, record_type string, refers_to bigint, digest string, payload binary"


def read_warc(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Records of the archives: page_id, url, record_type, refers_to, digest (of the header), payload (null in revisits)."""
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload", pa.binary()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        number = lambda x: int(x[len(_ID) + 1 : -1]) if x and len(x) > len(_ID) + 2 else None
        for batch in batches:
            for uri, size, at in values(batch, "file", "bytes", "offset"):
                end = min((at // chunk + 1) * chunk, size)
                store, path = pafs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as f:
                    while at < end:
                        data, at = _whole(f, uri, at)
                        fields, start = header_of(data, 0)
                        length = int(fields["content-length"])
                        block = data[start : start + length]
                        if len(block) != length or data[start + length :] != b"\r\n\r\n":
                            raise ValueError(f"{uri}: damaged record before {at}")
                        kind = fields["warc-type"]
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        out.add((number(fields["warc-record-id"]), fields["warc-target-uri"], kind, number(fields.get("warc-refers-to")), fields["warc-payload-digest"].removeprefix("sha1:"), payload), length)
                        if out.full():
                            yield out.take()
        yield out.take()

    starts = stage(entries(files, chunk))
    return starts.repartition(max(1, starts.count())).mapInArrow(read, PARSED)


def described(records: DataFrame) -> DataFrame:
    """Per record its payload's size and digest, for a revisit those of the response it refers to: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The digest of a response is computed from its payload.
    """
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = Rows(schema)
            for page_id, kind, refers_to, digest, payload in values(batch, "page_id", "record_type", "refers_to", "digest", "payload"):
                if payload is not None and digest != digest_of(payload):
                    raise ValueError(f"payload of page {page_id} does not match its digest")
                out.add((page_id, kind, refers_to, digest, None if payload is None else len(payload)))
            yield out.take()

    rows = stage(records.mapInArrow(measure, "page_id bigint, record_type string, refers_to bigint, digest string, payload_bytes bigint"))
    responses = rows.filter("record_type = 'response'")
    known = responses.groupBy(F.col("page_id").alias("refers_to"), "digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = rows.filter("record_type = 'revisit'").drop("payload_bytes").join(own_shuffle(known, "refers_to"), ["refers_to", "digest"], "left")
    return responses.unionByName(revisits).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(prepare(spark))}/factloom-warc-{uuid.uuid4().hex}"
