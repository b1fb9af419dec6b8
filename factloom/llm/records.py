"""Token ids as length-delimited binary records with a separate offset index.

A file is a row of frames:

    u64 length | u32 masked checksum of the length's 8 bytes | payload | u32 masked checksum of the payload

all little-endian. A checksum is the CRC-32 of zlib, masked by turning it right
by 15 bits and adding 0xA282EAD8, so that checksums of data which hold checksums
stay apart. A payload is one sequence: i64 doc_id, u8 flags (1: doc_id is null,
2: ids have 4 bytes in place of 2), ids. Ids take two bytes where all fit.

``<file>.idx`` has 32 bytes per record: i64 doc_id, u64 offset of its frame,
u64 number of ids, u64 ids before it in this file. With it a reader fetches any
record of a file in any order (``read_at``).

Files follow ascending doc_id (nulls first; rows with one doc_id by the hash of
their text). A task writes its file under a name of its attempt and then renames
it; the content depends on the rows only, so a repeated task writes the same.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import Rows, prepare, shared_folder, stage, text_or_empty, values
from factloom.llm.tokens import default_path, encoder

END_ID = 1
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n_tokens", "<u8"), ("start", "<u8")])
_MASK = 0xA282EAD8
_BUFFER = 1 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def payload_of(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(ids.size) and int(ids.max()) > 0xFFFF
    flags = (doc_id is None) | wide << 1
    return struct.pack("<qB", doc_id or 0, flags) + ids.astype("<u4" if wide else "<u2").tobytes()


def sequence_of(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags = struct.unpack_from("<qB", payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=9).astype("<u4")


def _exact(stream, n: int, what: str) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise ValueError(f"file ends inside a {what}")
    return data


def read_frame(stream) -> bytes | None:
    """The next payload; None at the end of the file. Raises ValueError on any damage."""
    head = stream.read(8)
    if not head:
        return None
    if len(head) != 8 or struct.unpack("<I", _exact(stream, 4, "length"))[0] != masked(head):
        raise ValueError("damaged length")
    payload = _exact(stream, struct.unpack("<Q", head)[0], "record")
    if struct.unpack("<I", _exact(stream, 4, "checksum"))[0] != masked(payload):
        raise ValueError("damaged record")
    return payload


def read_at(uri: str, numbers: list[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records of one file by number, in the order asked for: a shuffled read."""
    store, path = pafs.FileSystem.from_uri(uri)
    with store.open_input_file(path + ".idx") as f:
        index = np.frombuffer(f.read(), INDEX)
    with store.open_input_file(path) as f:
        for i in numbers:
            f.seek(int(index["offset"][i]))
            yield sequence_of(read_frame(f))


def write_records(docs: DataFrame, folder: str, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """Writes the files below ``folder``; gives a row per file: file, part, records, tokens."""
    path = tokenizer or default_path()
    schema = pa.schema([("file", pa.string()), ("part", pa.int64()), ("records", pa.int64()), ("tokens", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        task = TaskContext.get()
        store, base = pafs.FileSystem.from_uri(folder)
        name = f"part-{task.partitionId():08d}.rec"
        trial = f"{base}/.{name}-{task.taskAttemptId()}"
        index, offset, tokens = [], 0, 0
        store.create_dir(base, recursive=True)
        with store.open_output_stream(trial, buffer_size=_BUFFER) as f:
            for batch in batches:
                for doc_id, text in values(batch, "doc_id", "text"):
                    ids = np.frombuffer(encode(text) + end, "<u4")
                    data = frame(payload_of(doc_id, ids))
                    f.write(data)
                    index.append((doc_id or 0, offset, ids.size, tokens))
                    offset += len(data)
                    tokens += ids.size
        out = Rows(schema)
        if index:
            with store.open_output_stream(trial + ".idx") as f:
                f.write(np.array(index, INDEX).tobytes())
            store.move(trial + ".idx", f"{base}/{name}.idx")
            store.move(trial, f"{base}/{name}")
            out.add((f"{folder}/{name}", task.partitionId(), len(index), tokens))
        else:
            store.delete_file(trial)
        yield out.take()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    return stage(ordered.mapInArrow(write, "file string, part bigint, records bigint, tokens bigint"))


def read_records(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Reads files given by ``write_records``: doc_id, start (ids of all earlier records), n_tokens, ids (little-endian u32).

    The totals of the files, one row each, pass through the driver to place each
    file; a task then streams one file and checks every frame.
    """
    rows, base = [], 0
    for r in sorted(files.collect(), key=lambda r: r.part):
        rows.append((r.file, base, r.records))
        base += r.tokens
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in batches:
            for uri, start, records in values(batch, "file", "base", "records"):
                store, path = pafs.FileSystem.from_uri(uri)
                seen = 0
                with store.open_input_stream(path, buffer_size=_BUFFER) as f:
                    while (payload := read_frame(f)) is not None:
                        doc_id, ids = sequence_of(payload)
                        out.add((doc_id, start, ids.size, ids.tobytes()), 4 * ids.size)
                        start += ids.size
                        seen += 1
                        if out.full():
                            yield out.take()
                if seen != records:
                    raise ValueError(f"{uri}: {seen} records, {records} were written")
        yield out.take()

    listed = spark.createDataFrame(rows, "file string, base bigint, records bigint")
    return listed.repartition(max(1, len(rows))).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def new_folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared one, as a URI that workers can open."""
    root = shared_folder(prepare(spark))
    return f"{root if '://' in root or root.startswith('/') else root.replace('file:', '', 1)}/factloom-records-{uuid.uuid4().hex}"
