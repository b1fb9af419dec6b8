"""SimHash near-duplicates by meeting in the middle of Hamming balls.

Fingerprints within RADIUS = 3 bits are linked. Half the radius is one bit for
one side and two for the other:

- two fingerprints at distance 1 or 2 share a variant with at most one bit changed in each;
- at distance 3 one of them has an even number of ones and the other an odd one.
  The variant between them has one bit of the even one changed, and two of the odd
  one. Of three positions two lie in the same half of the 64, so only pairs of
  positions inside a half are emitted.

So an even fingerprint emits 65 variants, an odd one 65 + 992. All that emit a
variant with at most one change (near) are within two bits of each other, and
within three of all that emit it with two changes (far): a variant with a near
member joins all its members to the least near one by true links, at a linear
number of rows, and gives the same components as all pairs. A variant has at most
2,081 members, so none is hot, whatever the corpus. Links are verified again.

Before that, a sieve drops fingerprints without any neighbour, so that few emit
whole balls: of four quarters of the positions, one holds a bit of any difference;
leaving out a quarter leaves two bits at most, and so each fingerprint emits, for
each quarter, the other 48 bits with at most one change (196 keys). One that meets
no other under any key has no neighbour.

Exact copies of a text share a fingerprint and are grouped before anything else.

A null or empty text has fingerprint zero and links like any other. Null doc_id:
the row has a fingerprint; it never is a component's name unless all its group is
null. Repeated rows fall into one group. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import shingles
from factloom.llm.common import Rows, fresh, own_shuffle, prepare, stage, text_or_empty, values
from factloom.llm.components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
QUARTERS = 4
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BLOCK = 1 << 16
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
# all pairs of positions inside the lower and the upper half
_PAIRS = np.array([_BITS[i] | _BITS[j] for h in (0, 32) for i in range(h, h + 32) for j in range(i + 1, h + 32)], np.uint64)


def _hash(shingle: bytes) -> int:
    return xxhash.xxh64_intdigest(shingle, SEED)


def _hashes(text: str | None, size: int) -> Iterator[np.ndarray]:
    """Hashes of all shingles in order; words are read in blocks. A text of fewer words is one shingle."""
    kept: list[bytes] = []
    block: list[bytes] = []
    short = True

    def of(words: list[bytes]) -> np.ndarray:
        return np.fromiter((_hash(s) for s in map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))), np.uint64)

    for word in _words(text or ""):
        block.append(word)
        if len(block) >= _BLOCK:
            yield of(kept + block)
            kept, block, short = (kept + block)[-(size - 1) :] if size > 1 else [], [], False
    words = kept + block
    if len(words) >= size:
        yield of(words)
    elif short and words:
        yield np.array([_hash(b" ".join(words))], np.uint64)


def _majority(parts: Iterable[np.ndarray]) -> int:
    ones, total = np.zeros(64, np.int64), 0
    for hashes in parts:
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(_BITS[2 * ones > total].sum()) if total else 0


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Majority of the bits of all shingles' hashes."""
    return _majority(_hashes(text, size))


def _threes(text: str | None) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *_hashes(text, 3)])


def shingle_set(text: str | None) -> np.ndarray:
    """Numbers of the distinct five-word shingles of a text."""
    return shingles.shingle_set(_threes(text))


def _words(text: str) -> Iterator[bytes]:
    """Words as UTF-8. On bytes, lower() changes A-Z alone and split() cuts at the six ASCII spaces alone."""
    data = text.encode().lower()
    return iter(data.split()) if len(data) < 1 << 22 else (m[0] for m in _WORD.finditer(data))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a bigint) of every row; narrow."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = Rows(schema)
            for doc_id, text in values(batch, "doc_id", "text"):
                out.add((doc_id, signed(fingerprint(text, size))))
            yield out.take()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(fresh(compute), "doc_id bigint, fp bigint")


def _column(batch: pa.RecordBatch, name: str, kind=np.uint64) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).view(kind)


def sieve_keys(fps: np.ndarray) -> np.ndarray:
    """For each fingerprint a row of keys: quarter by quarter, the other bits with at most one change."""
    out = []
    for q in range(QUARTERS):
        inside = np.uint64(0xFFFF) << np.uint64(16 * q)
        changes = np.concatenate([[np.uint64(0)], _BITS[(_BITS & inside) == 0]])
        out.append((fps & ~inside)[:, None] ^ changes[None, :])
    return np.concatenate(out, axis=1)


def _emit(make, columns: str):
    """Runs ``make`` on the fingerprints of a batch, a few thousand at a time; it gives equal-length arrays."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = _column(batch, "fp")
            for i in range(0, len(fps), 512):
                arrays = make(fps[i : i + 512])
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64) if a.dtype == np.uint64 else a) for a in arrays], names=names)

    return run


def _sieve_rows(fps: np.ndarray) -> list[np.ndarray]:
    keys = sieve_keys(fps)
    quarter = np.repeat(np.arange(QUARTERS, dtype=np.int8), keys.shape[1] // QUARTERS)
    return [np.tile(quarter, len(fps)), keys.ravel(), np.repeat(fps, keys.shape[1])]


def ball_rows(fps: np.ndarray) -> list[np.ndarray]:
    """(variant, fp, far): all variants that a fingerprint emits."""
    odd = (np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1) & 1).astype(bool)
    near = fps[:, None] ^ np.concatenate([[np.uint64(0)], _BITS])[None, :]
    far = fps[odd][:, None] ^ _PAIRS[None, :]
    return [
        np.concatenate([near.ravel(), far.ravel()]), np.concatenate([np.repeat(fps, 65), np.repeat(fps[odd], len(_PAIRS))]),
        np.concatenate([np.zeros(near.size, bool), np.ones(far.size, bool)]),
    ]


def _runs(names: tuple[str, ...], on_runs, schema: pa.Schema):
    """Gives ``on_runs`` whole runs of equal leading column, from sorted rows, whatever the batches; a run is bounded by the method."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]
            held = new if held is None else [np.concatenate([h, x]) for h, x in zip(held, new, strict=True)]
            if not len(held[0]):
                continue
            last = np.searchsorted(held[0], held[0][-1])
            if last:
                yield pa.RecordBatch.from_arrays(on_runs([h[:last] for h in held]), schema=schema)
                held = [h[last:] for h in held]
        if held is not None and len(held[0]):
            yield pa.RecordBatch.from_arrays(on_runs(held), schema=schema)

    return run


def _met(columns: list[np.ndarray]) -> list[pa.Array]:
    """Fingerprints of runs with two or more of them; fingerprints are distinct, so a run of length two has two."""
    key, fp = columns
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    many = np.repeat(np.diff(edge) > 1, np.diff(edge))
    return [pa.array(np.unique(fp[many]))]


def _star(columns: list[np.ndarray]) -> list[pa.Array]:
    """Links of each run with a near member: its least near member to all others, checked."""
    key, fp, far = columns
    far = far.astype(bool)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    top = np.iinfo(np.int64).max
    low = np.minimum.reduceat(np.where(far, top, fp), starts)
    center = np.repeat(low, sizes)
    # the greatest bigint may be a fingerprint itself, so a run's near members are counted
    near = np.repeat(np.add.reduceat((~far).astype(np.int64), starts), sizes) > 0
    use = near & (fp != center)
    a, b = center[use], fp[use]
    apart = np.unpackbits((a ^ b).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1) if len(a) else np.zeros(0)
    pairs = np.unique(np.stack([a, b], axis=1)[apart <= RADIUS], axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])]


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that span the components of all pairs within RADIUS."""
    keys = distinct.select("fp").mapInArrow(fresh(_emit(_sieve_rows, "q byte, key bigint, fp bigint")), "q byte, key bigint, fp bigint")
    # one number for both: two keys that share it by chance only let a fingerprint pass the sieve
    one = keys.select(F.xxhash64("q", "key").alias("key"), "fp")
    met = one.repartition("key").sortWithinPartitions("key").mapInArrow(fresh(_runs(("key", "fp"), _met, pa.schema([("fp", pa.int64())]))), "fp bigint").distinct()
    balls = stage(met).mapInArrow(fresh(_emit(ball_rows, "variant bigint, fp bigint, far boolean")), "variant bigint, fp bigint, far boolean")
    pairs = balls.repartition("variant").sortWithinPartitions("variant").mapInArrow(
        fresh(_runs(("variant", "fp", "far"), _star, pa.schema([("a", pa.int64()), ("b", pa.int64())]))), "a bigint, b bigint")
    return pairs.distinct()


def _placed(found: DataFrame) -> DataFrame:
    """fp, its least doc_id (low) and its component's least fingerprint."""
    groups = found.groupBy("fp").agg(F.min("doc_id").alias("low"))
    member = components(links(stage(groups.select("fp"))))
    return groups.join(member, groups.fp == member.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))


def simhash_components(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id (least doc_id reachable) of every row."""
    found = stage(fingerprints(docs, size))
    placed = _placed(found)
    least = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    named = stage(placed.join(own_shuffle(least, "component"), "component").select("fp", "component_id"))
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp, the text's hash t, its number n of five-word shingles and their band keys of every row; narrow."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = Rows(schema)
            for doc_id, t, text in values(batch, "doc_id", "t", "text"):
                threes = _threes(text)
                found = shingles.shingle_set(threes)
                out.add((doc_id, signed(_majority([threes]) if size == 3 else fingerprint(text, size)), t, len(found), shingles.band_keys(found)))
            yield out.take()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty()).alias("t"), text_or_empty().alias("text"))
    return rows.mapInArrow(fresh(compute), "doc_id bigint, fp bigint, t bigint, n bigint, bands array<bigint>")


def near_components(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, t and component of every row: fingerprints within RADIUS, or five-word shingles alike (``shingles``), linked."""
    found = stage(sketches(docs, size))
    placed = stage(_placed(found).select("fp", "component"))
    texts = stage(found.filter("n > 0").select("t", "fp", "n").distinct().join(placed, "fp").select("t", F.col("component").alias("c"), "n"))
    # copies of a text have one row before its keys are spread
    keyed = stage(found.filter("n > 0").select("t", "bands").dropDuplicates(["t"])).select("t", F.explode("bands").alias("key"))
    member = components(shingles.links(docs, texts, keyed, shingle_set))
    joined = placed.join(member, placed.component == member.node, "left").select("fp", F.coalesce(member.component, placed.component).alias("component"))
    return found.select("doc_id", "fp", "t").join(stage(joined), "fp").select("doc_id", "t", "component")


def keep_one(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row of each component (``near_components``), with its own columns.

    The row with the least doc_id stays, of several that with the least hash of
    the text; a row without doc_id stays only where its component has none with
    one. Of rows that repeat doc_id and text one stays.
    """
    found = near_components(docs, size)
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("row"))
    kept = first.select(F.col("row.doc_id").alias("_kept_id"), F.col("row.t").alias("_kept_text"))
    # own columns inside a struct: none of their names meets one of ours
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(text_or_empty()).alias("t"), F.col("doc_id").cast("bigint").alias("id"))
    of_kept = (rows["t"] == kept["_kept_text"]) & rows["id"].eqNullSafe(kept["_kept_id"])
    return rows.join(kept, of_kept, "left_semi").dropDuplicates(["id", "t"]).select("row.*")
