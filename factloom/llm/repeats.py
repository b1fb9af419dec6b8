"""Removal of repeated passages by suffix arrays.

Removed is each byte of a string of LENGTH = 400 bytes that also starts anywhere
else in the table, the same text included. Matches never cross texts.

1. Spans. Every start of a 400-byte string has an anchor: of the hashes of all
   64-byte strings inside, the least (leftmost on a tie). Equal strings have equal
   anchors at equal places. Consecutive starts with one anchor make a span, about one
   for each 170 bytes. Only the hashes of anchor and span are shuffled.
2. An anchor met once is dropped. A span met twice is a repeat as a whole. Left are
   distinct spans that share an anchor: those around the ends of repeated passages.
3. Suffix arrays. One copy of each such span is read again, all spans of an anchor
   come to one task, and tasks sort the suffixes of about SORT_BYTES at a time in two
   stages: suffixes smaller than their successors are sorted directly, the others
   are induced by a scan over the buckets. Starts whose neighbour in the order shares
   a prefix of 400 bytes are repeats.
4. An anchor with more than GROUP_LIMIT distinct spans, such as the edge of a very
   common passage, would be a hot group for a sort. Its spans are dealt out by
   content instead, first in runs of RUN starts by the bytes that all of the run
   share, and single starts only where a run is no whole repeat. So any number of
   spans is compared completely, at a few rows a span.

Hashes: a false repeat needs two 64-bit hashes to agree by chance.

Null text counts as empty. Texts below 400 bytes never change. Rows are told apart
by doc_id and text, and repeated rows are copies of each other: all of their bytes
go if they have 400. A null doc_id is a document. Other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Rows, drop_caches, fresh, own_shuffle, prepare, stage, text_or_empty, values

LENGTH = 400
GRAM = 64
BLOCK = 1 << 20
SORT_BYTES = 128 << 10
GROUP_LIMIT = 64
RUN = 16
HOT_ROWS = 1024
SEPARATOR = 0xFF  # no byte of UTF-8
_LOW = np.uint64((1 << 24) - 1)
_ODD = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd number, of its inverse, and a number for each byte."""
    def powers(x: int) -> np.ndarray:
        out = np.full(n, x, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return powers(_ODD), powers(pow(_ODD, -1, 1 << 64)), np.random.default_rng(17).integers(0, 1 << 64, 256, np.uint64)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of each ``gram`` consecutive bytes."""
    up, down, of_byte = _powers(BLOCK + 4096)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(of_byte[data] * up[: len(data)], out=sums[1:])
    x = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    for shift in (33, 29):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive numbers."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def spans(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, anchor's place, anchor's hash) of all spans; a very long text is read in blocks."""
    parts = []
    for at in range(0, len(data) - length + 1, BLOCK):
        b = np.frombuffer(data, np.uint8, min(BLOCK + length - 1, len(data) - at), at)
        h = gram_hashes(b, gram)
        place = (_least((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        parts.append((first + at, np.diff(np.append(first, len(place))), place[first] + at, h[place[first]].view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4


def suffix_order(data: bytes, depth: int = LENGTH) -> list[int]:
    """All suffixes of ``data`` in the order of their first ``depth`` bytes, by two-stage sorting."""
    n = len(data)
    codes = np.frombuffer(data, np.uint8).astype(np.int16)
    # smaller than its successor: the next byte that differs is greater; the last suffix is greater than the empty one
    differs = np.append(np.flatnonzero(codes[1:] != codes[:-1]), n - 1)
    rises = np.append(codes[1:] > codes[:-1], False)
    smaller = rises[differs[np.searchsorted(differs, np.arange(n))]]
    sizes = np.bincount(codes, minlength=256)
    heads = np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist()
    order = [-1] * n
    # stage one: within a bucket the smaller ones come last
    direct = sorted(np.flatnonzero(smaller).tolist(), key=lambda i: data[i : i + depth])
    of_bucket = np.bincount(codes[smaller], minlength=256)
    ends, done = np.cumsum(sizes), 0
    for c in np.flatnonzero(of_bucket).tolist():
        k = int(of_bucket[c])
        order[int(ends[c]) - k : int(ends[c])] = direct[done : done + k]
        done += k
    # stage two: a suffix induces its greater predecessor at the head of that one's bucket
    small = smaller.tolist()

    def induce(i: int) -> None:
        c = data[i]
        order[heads[c]] = i
        heads[c] += 1

    induce(n - 1)
    for r in range(n):
        i = order[r] - 1
        if i >= 0 and not small[i]:
            c = data[i]
            order[heads[c]] = i
            heads[c] += 1
    return order


def adjacent_reach(data: bytes, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether the common prefix of each suffix with the one before it in the order has ``length`` bytes; never for the first.

    How long a shorter prefix is plays no part. Eight bytes each at the far end,
    in the middle and at the front tell most pairs apart; the others are compared whole.
    """
    out = np.zeros(len(order), bool)
    if len(order) < 2:
        return out
    padded = np.frombuffer(data + bytes(8), np.uint8)
    eights = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view("<u8").ravel()
    a, b = order[:-1], order[1:]
    going = np.flatnonzero(np.maximum(a, b) + length <= len(data))
    for at in (length - 8, length // 2, 0) if length >= 16 else ():
        going = going[eights[a[going] + at] == eights[b[going] + at]]
    pairs = zip(going.tolist(), a[going].tolist(), b[going].tolist(), strict=True)
    out[[k + 1 for k, i, j in pairs if data[i : i + length] == data[j : j + length]]] = True
    return out


def repeated_starts(data: bytes, valid: bytearray, length: int = LENGTH) -> list[int]:
    """Valid starts whose common prefix with a neighbour in suffix order has ``length`` bytes."""
    order = np.array(suffix_order(data, length), np.int64)
    order = order[np.frombuffer(valid, np.uint8)[order] != 0]
    alike = np.flatnonzero(adjacent_reach(data, order, length))
    return np.unique(np.concatenate([order[alike - 1], order[alike]])).tolist()


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with their key: ``k``, ``th``."""
    text = text_or_empty()
    return docs.select(F.struct("*").alias("_row"), text.alias("text"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0).cast("bigint")).alias("k"),
                       F.xxhash64(text, F.col("doc_id").isNull()).alias("th"))


_SPANS = pa.schema([("k", pa.int64()), ("th", pa.int64()), ("p", pa.int64()), ("m", pa.int32()), ("h", pa.int64()), ("sh", pa.int64())])


def _find_spans(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def take() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _SPANS, strict=True)], schema=_SPANS)

        for batch in batches:
            for k, th, text in values(batch, "k", "th", "text"):
                data = text.encode()
                if len(data) < length:
                    continue
                first, count, _, anchor = spans(data, length)
                whole = np.fromiter((xxhash.xxh64_intdigest(data[p : p + m - 1 + length]) for p, m in zip(first.tolist(), count.tolist(), strict=True)), np.uint64, len(first))
                held.append((np.full(len(first), k), np.full(len(first), th), first, count, anchor, whole.view(np.int64)))
                n += len(first)
                if n >= 50_000:
                    yield take()
                    n = 0
        if held:
            yield take()

    return run


PIECES = "k bigint, th bigint, p bigint, m int, h bigint, sh bigint, hot boolean, data binary, starts array<bigint>"
_PIECES = pa.schema([
    ("k", pa.int64()), ("th", pa.int64()), ("p", pa.int64()), ("m", pa.int32()), ("h", pa.int64()), ("sh", pa.int64()), ("hot", pa.bool_()), ("data", pa.binary()), ("starts", pa.list_(pa.int64())),
])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def runs_of_span(data: bytes, p: int, m: int, place: int, h: int, length: int, run: int = RUN) -> Iterator[tuple[int, int, int, int, list[int]]]:
    """A hot span in runs of starts, aligned on the anchor: (p, m, key of the bytes all of the run share, hash of all its bytes, hashes of its starts)."""
    lo = p
    while lo < p + m:
        q = (place - lo) // run
        hi = min(place - q * run, p + m - 1)
        # the window of every start of the whole run holds these bytes
        shared = data[place - q * run : place - q * run - run + 1 + length]
        key = xxhash.xxh64_intdigest(shared, (h ^ q) & (2**64 - 1))
        body = xxhash.xxh64_intdigest(data[lo : hi + length], (place - lo) * 4096 + (place - hi))
        yield lo, hi - lo + 1, signed(key), signed(body), [signed(xxhash.xxh64_intdigest(data[s : s + length], place - s)) for s in range(lo, hi + 1)]
        lo = hi + 1


def _read_spans(length: int):
    """The chosen spans of each text: whole bytes, or in runs if hot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(_PIECES)
        for batch in batches:
            for k, th, text, chosen in values(batch, "k", "th", "text", "chosen"):
                data = text.encode()
                places: dict[int, tuple] = {}
                if any(c["hot"] for c in chosen):
                    first, _, place, _ = spans(data, length)
                    places = dict(zip(first.tolist(), place.tolist(), strict=True))
                for c in chosen:
                    p, m, h = c["p"], c["m"], c["h"]
                    if c["hot"]:
                        for lo, n, key, body, starts in runs_of_span(data, p, m, places[p], h, length):
                            out.add((k, th, lo, n, key, body, True, None, starts), 48 + 8 * n)
                    else:
                        out.add((k, th, p, m, h, c["sh"], False, data[p : p + m - 1 + length], None), m + length)
                    if out.full():
                        yield out.take()
        yield out.take()

    return run


_CUTS = pa.schema([("k", pa.int64()), ("th", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
CUTS = "k bigint, th bigint, lo bigint, hi bigint"


def _sort_spans(length: int, sort_bytes: int):
    """Rows sorted by anchor: the intervals of repeated starts, from suffix arrays over whole groups."""
    def solve(group: list[tuple]) -> Iterator[tuple]:
        data = bytes([SEPARATOR]).join(g[4] for g in group) + bytes([SEPARATOR])
        valid, begins, at = bytearray(len(data)), [], 0
        for _, _, _, m, body in group:
            valid[at : at + m] = b"\x01" * m
            begins.append(at)
            at += len(body) + 1
        found = np.array(repeated_starts(data, valid, length), np.int64)
        for (k, th, p, m, _), begin in zip(group, begins, strict=True):
            own = found[np.searchsorted(found, begin) : np.searchsorted(found, begin + m)] - begin
            if len(own):
                gaps = np.flatnonzero(np.diff(own) > 1)
                for lo, hi in zip(own[np.append(0, gaps + 1)], own[np.append(gaps, len(own) - 1)], strict=True):
                    yield k, th, p + int(lo), p + int(hi) + length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, size, anchor = Rows(_CUTS), [], 0, None
        for batch in batches:
            for k, th, p, m, h, body in values(batch, "k", "th", "p", "m", "h", "data"):
                if h != anchor and size >= sort_bytes:
                    for row in solve(held):
                        out.add(row)
                    held, size = [], 0
                    if out.full():
                        yield out.take()
                anchor = h
                held.append((k, th, p, m, body))
                size += len(body)
        if held:
            for row in solve(held):
                out.add(row)
        yield out.take()

    return run


def _text_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Whole texts with what was found about each: by a shuffle of the texts at any size.

    The right side grows with the table, so a broadcast would only serve small tables,
    and figures taken of those would say nothing about large ones.
    """
    return left.join(right.hint("merge"), ["k", "th"], how)


def _interval(starts: Column, count: Column, length: int) -> list[Column]:
    return [F.col("k"), F.col("th"), starts.alias("lo"), (starts + count - 1 + length).alias("hi")]


def _dealt(rows: DataFrame, by: Column, parts: str = "parts") -> DataFrame:
    """``part``: which of a hot group's parts a row goes to."""
    return rows.withColumn("part", F.pmod(by, F.col(parts)).cast("int"))


def _for_all(rows: DataFrame, parts: str = "parts") -> DataFrame:
    """A copy of the row for each part of its group; a group has a part for HOT_ROWS of its rows."""
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col(parts).cast("int") - 1))).drop(parts)


def _hot_cuts(runs: DataFrame, length: int) -> DataFrame:
    """Intervals of hot spans, from counts of their runs and, where those differ, of their starts."""
    met = runs.groupBy("h").agg(F.count("*").alias("n"), F.min("sh").alias("low"), F.max("sh").alias("high")).filter("n > 1")
    met = met.select("h", (F.col("low") != F.col("high")).alias("mixed"), F.ceil(F.col("n") / HOT_ROWS).alias("parts"))
    alike = runs.join(own_shuffle(met, "h"), "h")
    alike = stage(_dealt(alike, F.xxhash64("k", "th", "p")).select("k", "th", "p", "m", "h", "sh", "starts", "mixed", "parts", "part"))
    bodies = alike.filter("mixed").groupBy("h", "sh").agg(F.count("*").alias("n"), F.max("starts").alias("starts"), F.max("parts").alias("parts"))
    starts = bodies.select("h", F.explode("starts").alias("s"), "parts").groupBy("h", "s").agg(F.count("*").alias("n"), F.max("parts").alias("parts")).filter("n > 1")
    mixed = alike.filter("mixed").join(_for_all(bodies.select("h", "sh", "n", "parts")), ["h", "sh", "part"])
    single = mixed.filter("n = 1").select("k", "th", "p", "h", "part", F.posexplode("starts").alias("i", "s")).join(_for_all(starts.select("h", "s", "parts")), ["h", "s", "part"])
    return (
        alike.filter("not mixed").select(*_interval(F.col("p"), F.col("m"), length))
        .union(mixed.filter("n > 1").select(*_interval(F.col("p"), F.col("m"), length)))
        .union(single.select(*_interval(F.col("p") + F.col("i"), F.lit(1), length)))
    )


def repeated(keyed: DataFrame, length: int = LENGTH, group_limit: int = GROUP_LIMIT, sort_bytes: int = SORT_BYTES) -> DataFrame:
    """Per text with repeats (k, th): ``cuts``, the intervals [lo, hi) of bytes to remove; they may overlap."""
    found = stage(keyed.select("k", "th", "text").mapInArrow(fresh(_find_spans(length)), "k bigint, th bigint, p bigint, m int, h bigint, sh bigint"))
    met = found.groupBy("h").agg(F.count("*").alias("n"), F.min("sh").alias("low"), F.max("sh").alias("high")).filter("n > 1")
    alike = stage(found.join(own_shuffle(met.select("h", (F.col("low") != F.col("high")).alias("mixed")), "h"), "h"))
    copy = F.min(F.struct("k", "th", "p", "m"))
    distinct = stage(alike.filter("mixed").groupBy("h", "sh").agg(F.count("*").alias("n"), copy.alias("c")).select("h", "sh", "n", "c.*"))
    whole = alike.filter("not mixed").select("k", "th", "p", "m").union(
        alike.filter("mixed").join(distinct.filter("n > 1").select("h", "sh"), ["h", "sh"], "left_semi").select("k", "th", "p", "m"))
    groups = distinct.groupBy("h").agg(F.count("*").alias("size"))
    chosen = distinct.join(own_shuffle(groups, "h"), "h").groupBy("k", "th").agg(F.collect_list(F.struct("p", "m", "h", "sh", (F.col("size") > group_limit).alias("hot"))).alias("chosen"))
    pieces = stage(_text_join(keyed.select("k", "th", "text"), chosen).mapInArrow(fresh(_read_spans(length)), PIECES), "hot")
    cold = pieces.filter("not hot").select("k", "th", "p", "m", "h", "data").repartition("h").sortWithinPartitions("h")
    hot = pieces.filter("hot").select("k", "th", "p", "m", "h", "sh", "starts")
    cuts = whole.select(*_interval(F.col("p"), F.col("m"), length)).union(cold.mapInArrow(fresh(_sort_spans(length, sort_bytes)), CUTS)).union(_hot_cuts(hot, length))
    return cuts.distinct().groupBy("k", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("cuts"))


def merged(cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intervals without overlap, in order; touching ones become one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(cuts):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, group_limit: int = GROUP_LIMIT, sort_bytes: int = SORT_BYTES, as_text: bool = False) -> DataFrame:
    """Each row as ``_row``, with n_bytes, n_removed, n_spans and ``kept``, the remaining bytes.

    ``as_text`` gives ``kept`` as text; bytes of a character that a cut has split are dropped.
    """
    prepare(docs.sparkSession)
    keyed = _keyed(docs)
    cuts = stage(repeated(keyed, length, group_limit, sort_bytes))
    # the row holds the text: it is shuffled once
    joined = _text_join(keyed.select("_row", "k", "th"), cuts, "left").select("_row", text_or_empty("_row.text").alias("text"), "cuts")

    kind = pa.string() if as_text else pa.binary()

    def cut(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        drop_caches()
        out = []
        for text, found in zip(texts, cuts, strict=True):
            data, gone = text.as_py().encode(), merged([(c["lo"], c["hi"]) for c in found.as_py() or []])
            kept, at = [], 0
            for lo, hi in gone:
                kept.append(data[at:lo])
                at = hi
            rest = b"".join([*kept, data[at:]])
            out.append((len(data), sum(hi - lo for lo, hi in gone), len(gone), rest.decode("utf-8", "ignore") if as_text else rest))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), kind), strict=True)], names=["n_bytes", "n_removed", "n_spans", "kept"])

    # only text and cuts go to Python, once; the row waits beside
    done = F.arrow_udf(cut, f"struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept: {'string' if as_text else 'binary'}>").asNondeterministic()
    return joined.select("_row", done("text", "cuts").alias("_done")).select("_row", "_done.*")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows with what is left of their texts; a text without repeats stays as it is, null too."""
    names = docs.columns
    left = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("_row.text"))
    return remove_repeats(docs, length, as_text=True).select(*(left.alias("text") if n == "text" else F.col("_row")[n].alias(n) for n in names))
