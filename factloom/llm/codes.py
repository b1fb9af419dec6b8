"""Compression of vectors to product codes, in exact integer arithmetic.

Each component x becomes the integer floor(SCALE * x); vectors are cut into PARTS
equal consecutive parts, and each part position has a codebook of ENTRIES integer
entries, moved ROUNDS times to the floors of their parts' means.

The squared distance of a part to an entry is |x|^2 - 2 x.c + |c|^2. The products
x.c come from BLAS in float64, but exactly: integers are split into limbs of so few
bits that a product of two limbs, summed over a part, stays below 2^53 (25 bits for
parts of 8). The products of limbs are put together in int64, and the first entry of
the least distance wins. As many limbs are used as the greatest magnitude asks for.
Where a distance might leave int64, that batch is computed with Python's integers.

A round is one narrow pass over the stored integers: each task gives the sums and
counts of its parts by entry, PARTS x ENTRIES x length-of-a-part rows, summed again
by Spark. Only codebooks, whose size is fixed by the parameters, come to the driver.

Dropped: rows whose vector is null or holds null or non-finite components. The first
entries are the parts of the ENTRIES least vec_ids (nulls last; rows with one vec_id
by their integers); a table of fewer rows has fewer entries. Vectors of another
length than the commonest (of equally common ones the shortest), of a length that
PARTS does not divide, or with a component of 2^62 or more after scaling, stay
without code and error, and neither seed nor move an entry. Repeated rows count as
often as they occur. An empty table gives none. Errors beyond the greatest bigint
are given as that. Other columns are not read; a label may have any type.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import own_shuffle, prepare, stage

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
_EXACT = 53
_SAFE = 62
_TOP = (1 << 63) - 1

Books = list[list[list[int]]]


def limb_bits(length: int) -> int:
    """Bits of a limb, so that ``length`` products of two limbs sum to less than 2^53."""
    return (_EXACT - max(length - 1, 1).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """int64 as float64 limbs, lowest first; all but the last lie in [0, 2^bits), the last one keeps the sign."""
    out, top = [], int(np.abs(x).max(initial=0))
    while top >> bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
        top >>= bits
    return [*out, x.astype(np.float64)]


def exact_dots(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Dot products of all rows of ``x`` with all of ``book``, modulo 2^64 and so exact if they fit int64."""
    bits = limb_bits(x.shape[1])
    total = np.zeros((len(x), len(book)), np.int64)
    right = limbs(book, bits)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            if bits * (i + j) < 64:
                total += (a @ b.T).astype(np.int64) << np.int64(bits * (i + j))
    return total


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each row of integers; ties go to the lower index."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * x.shape[1] * top * top >> _SAFE:
        x, book = x.astype(object), book.astype(object)
        dots = x.dot(book.T)
    else:
        dots = exact_dots(x, book)
    d = (x * x).sum(1)[:, None] - 2 * dots + (book * book).sum(1)[None, :]
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


def _parts(vectors: np.ndarray, parts: int) -> np.ndarray:
    """Part by part, the rows' integers."""
    return vectors.reshape(len(vectors), parts, -1).transpose(1, 0, 2)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, dim)


def _sums(books: Books, parts: int, dim: int):
    """Sums and counts of the parts assigned to each entry: (place, total); place counts part, entry, and position or the count after them."""
    arrays = [np.array(b, np.int64) for b in books]
    width = dim // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((parts, len(arrays[0]), width + 1), object)
        for batch in batches:
            for p, x in enumerate(_parts(_matrix(batch.column(0), dim), parts)):
                at, _ = nearest(x, arrays[p])
                order = np.argsort(at, kind="stable")
                used, first = np.unique(at[order], return_index=True)
                # limbs again: a sum of int64 may leave int64
                low, high = x[order] & 0xFFFFFFFF, x[order] >> 32
                sums = np.add.reduceat(low, first).astype(object) + np.add.reduceat(high, first).astype(object) * (1 << 32) if len(used) else []
                for e, s, n in zip(used, sums, np.diff(np.append(first, len(at))), strict=True):
                    totals[p, e, :width] += s
                    totals[p, e, width] += int(n)
        flat = totals.ravel()
        some = np.flatnonzero(flat != 0)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([str(flat[i]) for i in some], pa.string())], names=["place", "total"])

    return run


def _assign(books: Books, parts: int, dim: int):
    """Code and error of each row, beside its own columns."""
    arrays = [np.array(b, np.int64) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [], np.zeros(batch.num_rows, object)
            for p, x in enumerate(_parts(_matrix(batch.column(1), dim), parts)):
                at, d = nearest(x, arrays[p])
                codes.append([f"{i:02x}" for i in at.tolist()])
                errors += d.astype(object)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(["".join(c) for c in zip(*codes, strict=True)], pa.string()), pa.array([min(int(e), _TOP) for e in errors], pa.int64())], names=["g", "code", "error"])

    return run


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """The kept rows: vec_id, label and ``x``, the integers; null where a component is too large."""
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding")).filter(sound)
    fits = F.forall("embedding", lambda c: F.abs(c * F.lit(float(scale))) < F.lit(float(1 << 62)))
    return rows.select("vec_id", "label", F.when(fits, F.transform("embedding", lambda c: F.floor(c * F.lit(float(scale))))).alias("x"))


def _length(rows: DataFrame, parts: int) -> int:
    """The commonest length that can be cut, 0 if there is none."""
    sizes = rows.groupBy(F.size("x").alias("n")).count().filter((F.col("n") > 0) & (F.col("n") % parts == 0))
    first = sizes.orderBy(F.desc("count"), "n").first()
    return first.n if first else 0


def fit(rows: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    """Codebooks of ``rows`` (vec_id, x with ``dim`` integers): part, entry, position."""
    width = dim // parts
    seeds = [r.x for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()]
    books = [[s[p * width : (p + 1) * width] for s in seeds] for p in range(parts)]
    for _ in range(rounds):
        found = rows.select("x").mapInArrow(_sums(books, parts, dim), "place bigint, total string")
        totals = {r.place: int(r.total) for r in found.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
        for p, book in enumerate(books):
            for e in range(len(book)):
                at = (p * len(book) + e) * (width + 1)
                n = totals.get(at + width, 0)
                if n:
                    book[e] = [totals.get(at + i, 0) // n for i in range(width)]
    return books


def digest(books: Books) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Books]:
    """(vec_id, label, code, error) of every kept row, and the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits name 1 to 256 entries")
    prepare(vectors.sparkSession)
    rows = stage(integers(vectors, scale).select(F.monotonically_increasing_id().alias("g"), "*"))
    dim = _length(rows, parts)
    coded = rows.filter(F.size("x") == dim) if dim else rows.filter("false")
    books = fit(coded, dim, parts, entries, rounds) if dim else []
    if not dim:
        return rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error")), books
    found = stage(coded.select("g", "x").mapInArrow(_assign(books, parts, dim), "g bigint, code string, error bigint"))
    return rows.select("g", "vec_id", "label").join(found, "g", "left").select("vec_id", "label", "code", "error"), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``label_error``: the errors summed over all rows of a label; null labels are one."""
    total = F.coalesce(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    sums = coded.groupBy(F.xxhash64("label").alias("spot"), F.col("label").alias("_of")).agg(F.least(total, F.lit(_TOP).cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    sums = own_shuffle(sums, "spot").withColumnRenamed("spot", "_at")
    joined = coded.withColumn("_spot", F.xxhash64("label")).join(sums, (F.col("_spot") == F.col("_at")) & F.col("label").eqNullSafe(F.col("_of")))
    return joined.select("vec_id", "label", "code", "error", "label_error")


def decoded(code: str, books: Books, scale: int = SCALE) -> list[float]:
    """The vector that a code stands for: the middle of each integer's interval."""
    return [(x + 0.5) / scale for p, book in enumerate(books) for x in book[int(code[2 * p : 2 * p + 2], 16)]]
