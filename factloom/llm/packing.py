"""Packing by power-of-two decomposition.

A document of n ids is cut into n // limit pieces of ``limit`` ids and one piece
for each binary digit of the rest. Every piece is a sequence of its own whose
length is a power of two, so no sequence crosses documents and none is padded;
pieces of equal length make up a bucket, from which batches are drawn.

Null text: only the end id. Repeated rows: each is packed. Null doc_id: kept.
Other columns are not read. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Rows, drop_caches, prepare, text_or_empty, values
from factloom.llm.tokens import WordEncoder, default_path, encoder

LIMIT = 4096
END_ID = 2
SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, offset bigint"


def binary_lengths(n: int, limit: int = LIMIT) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n ids, longest first; ``limit`` is a power of two."""
    start = 0
    for start in range(0, n - n % limit, limit):
        yield start, limit
    start = n - n % limit
    size = limit >> 1
    while size:
        if n & size:
            yield start, size
            start += size
        size >>= 1


def pack(docs: DataFrame, limit: int = LIMIT, end_id: int = END_ID, tokenizer: str | None = None, own_words: int | None = None) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian u32), doc_tokens, offset, bucket (log2 of the length), sequence_id.

    One narrow pass. ``sequence_id`` is unique, and grows with the order of the
    input's partitions; ids of different partitions are not consecutive.
    ``own_words`` gives each task a word cache of its own, of so many words a generation,
    that is freed with the task: for jobs with other Python steps, whose workers take turns
    on an executor and would each keep a full cache.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    prepare(docs.sparkSession)
    path = tokenizer or default_path()
    schema = pa.schema([
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("offset", pa.int64()),
    ])
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if own_words:
            drop_caches()
        encode = (WordEncoder(path, own_words) if own_words else encoder(path)).encode
        out = Rows(schema)
        for batch in batches:
            for doc_id, text in values(batch, "doc_id", "text"):
                ids = encode(text) + end
                n = len(ids) // 4
                for start, length in binary_lengths(n, limit):
                    out.add((doc_id, start, length, ids[4 * start : 4 * (start + length)], n, 0), 4 * length)
                    if out.full():
                        yield out.take()
        yield out.take()

    pieces = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(cut, SCHEMA)
    return pieces.withColumn("bucket", F.log2("length").cast("int")).withColumn("sequence_id", F.monotonically_increasing_id())


def write_buckets(pieces: DataFrame, folder: str) -> None:
    """One folder per length; each file holds sequences of one length only."""
    pieces.write.partitionBy("bucket").parquet(folder)
