"""Near copies by word shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A five-word shingle is told by the three-word shingles at its ends, so its number
comes from the hashes that SimHash has made of the same text already.

- Each text has BANDS keys, each of ROWS least values of the set under other
  multipliers. Two texts at similarity s share a key with probability
  1 - (1 - s^ROWS)^BANDS: 0.99997 at 0.8.
- All texts with one key are paired with two centres among them, a linear number of
  rows, however common a key is. Pairs inside one component, or of sizes too far
  apart, go; the others are verified by their whole sets.
- Centres, and texts alike with one or in its component, are then done with under that
  key, and links found so far join components.
- Texts left under any key meet a second time by their rarest shingles: two sets at
  similarity 0.8 share one among the first of both, in any order that is the same for
  all. How many are first follows from both sizes, so copies of one text that have gone
  too far from each other have only shingles of their own there and do not meet, however
  many they are. All pairs that meet are verified: of the texts left none is missed.
  Not compared are a text that went with its centre under all its keys, and one unlike
  that centre: these have to meet under another key.

Texts of fewer than five words have no key: those with equal words have one
fingerprint and are linked by it.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import Rows, fresh, own_shuffle, stage, text_or_empty, values
from factloom.llm.components import components

WORDS = 5
SIMILAR = 0.8
BANDS = 20
ROWS = 4
CENTRES = 2
SLOTS = 1 << 16
_CACHED = 64
_rnd = np.random.default_rng(20)
_ODD = np.uint64(1)
_ENDS = _rnd.integers(0, 1 << 64, 2, np.uint64) | _ODD
_TIMES = _rnd.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | _ODD
_JOIN = _rnd.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | _ODD
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(threes: np.ndarray) -> np.ndarray:
    """Numbers of the distinct five-word shingles, sorted, from the hashes of the three-word shingles in order."""
    return np.unique(_mixed(threes[:-2] * _ENDS[0] + threes[2:] * _ENDS[1])) if len(threes) > 2 else np.zeros(0, np.uint64)


def band_keys(found: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles, as bigints; none of an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 1024):
        least = np.minimum(least, (_TIMES[:, None] * found[None, i : i + 1024]).min(axis=1))
    return _mixed((least.reshape(BANDS, ROWS) * _JOIN).sum(axis=1, dtype=np.uint64)).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def _verified(set_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, np.ndarray] = OrderedDict()

        def get(t: int, text: str) -> np.ndarray:
            if t not in held:
                held[t] = set_of(text)
            held.move_to_end(t)
            if len(held) > _CACHED:
                held.popitem(last=False)
            return held[t]

        for batch in batches:
            out = Rows(pa.schema([("ta", pa.int64()), ("tb", pa.int64())]))
            for ta, tb, text_a, text_b in values(batch, "ta", "tb", "text_a", "text_b"):
                if similarity(get(ta, text_a), get(tb, text_b)) >= SIMILAR:
                    out.add((ta, tb))
            yield out.take()

    return run


def _met(rows: DataFrame) -> DataFrame:
    """The rows whose key has another one."""
    several = rows.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1").select("key")
    return rows.join(own_shuffle(several, "key"), "key")


def _centred(rest: DataFrame) -> DataFrame:
    """The CENTRES texts of each key that are least by a hash: (key, e, ec, en)."""
    order = Window.partitionBy("key").orderBy(F.xxhash64("t"), "t")
    first = rest.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= CENTRES)
    return first.select("key", F.col("t").alias("e"), F.col("c").alias("ec"), F.col("n").alias("en"))


def links(docs: DataFrame, texts: DataFrame, keyed: DataFrame, set_of) -> DataFrame:
    """Links (a, b) between components that hold texts alike.

    ``texts`` has one row (t, c, n) of each text with keys: its hash, component
    and number of shingles; ``keyed`` a row (t, key) of each key of each text.
    ``set_of`` gives a text's set.
    """
    rest = stage(_met(keyed).join(own_shuffle(texts, "t"), "t").select("key", "t", "c", "n"))
    first = stage(_centred(rest))
    # a key has at most CENTRES rows on the right side
    met = rest.join(own_shuffle(first, "key"), "key").filter("t <> e")
    wanted = met.filter("c <> ec").filter(F.least("n", "en") >= F.greatest("n", "en") * F.lit(SIMILAR))
    pairs = wanted.select(F.least("t", "e").alias("ta"), F.greatest("t", "e").alias("tb")).distinct()
    alike = stage(_verify(docs, pairs, set_of))
    linked = stage(_ends(alike, texts))
    both = alike.union(alike.select(F.col("tb").alias("ta"), F.col("ta").alias("tb")))
    near = met.join(both, (met.t == both.ta) & (met.e == both.tb), "left_semi").union(met.filter("c = ec")).select("key", "t")
    gone = first.select("key", F.col("e").alias("t")).union(near).distinct()
    left = stage(_met(rest.join(gone, ["key", "t"], "left_anti")).select("t", "c", "n").distinct())
    if left.isEmpty():
        return linked
    # texts whose components have met by now need no comparing
    member = stage(components(linked))
    moved = left.join(own_shuffle(member.withColumnRenamed("node", "c"), "c"), "c", "left")
    again = _rare_pairs(docs, stage(moved.select("t", F.coalesce("component", "c").alias("c"))), set_of)
    return linked.union(_ends(stage(_verify(docs, again, set_of)), texts)).distinct()


def _ends(alike: DataFrame, texts: DataFrame) -> DataFrame:
    """The components (a, b) that texts alike belong to."""
    return alike.join(_side(texts, "a"), "ta").join(_side(texts, "b"), "tb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).filter("a <> b").distinct()


def _shown(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts (t, text) with the hashes in ``wanted``, once each."""
    shown = docs.select(F.xxhash64(text_or_empty()).alias("t"), text_or_empty().alias("text")).join(wanted, "t", "left_semi")
    return stage(shown.dropDuplicates(["t"]))


def _slot_counts(set_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for (text,) in values(batch, "text"):
                counts += np.bincount((set_of(text) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["slot", "n"])

    return run


def prefix(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles, rarest first, of which a set that is alike, and not larger, holds at least one; counts are by slot."""
    n = len(found)
    return found[np.lexsort((found, counts[(found % np.uint64(SLOTS)).astype(np.int64)]))][: n - -(-4 * n // 5) + 1]


_PREFIX = pa.schema([("w", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("p", pa.int64())])


def _prefixes(set_of, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, text in values(batch, "t", "text"):
                found = set_of(text)
                rare = prefix(found, counts.value)
                k = len(rare)
                yield pa.RecordBatch.from_arrays([pa.array(rare.view(np.int64)), pa.array(np.full(k, t)), pa.array(np.full(k, len(found))), pa.array(np.arange(1, k + 1))], schema=_PREFIX)

    return run


def _size_class(n: Column) -> Column:
    """Classes of sizes that differ by two hundredths."""
    return F.floor(F.log(n.cast("double")) * 50).cast("int")


def _rare_pairs(docs: DataFrame, left: DataFrame, set_of) -> DataFrame:
    """Pairs (ta, tb) of the texts (t, c), of two components, that share a shingle among the first of both.

    Sets of m <= n shingles at similarity 0.8 have 4 (m + n) / 9 in common, so
    the first one in common is at place m + 1 - 4 (m + n) / 9 or before in the
    smaller, the same with n in the larger. The smaller is thus met within its
    first ninth alone, and a place in the larger leaves a range of sizes m.
    """
    shown = _shown(docs, left.select("t"))
    # one number for each of a fixed count of slots
    counts = np.zeros(SLOTS, np.int64)
    for slot, n in shown.select("text").mapInArrow(fresh(_slot_counts(set_of)), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n")).collect():
        counts[slot] = n
    held = docs.sparkSession.sparkContext.broadcast(counts)
    found = stage(shown.mapInArrow(fresh(_prefixes(set_of, held)), "w bigint, t bigint, n bigint, p bigint"))
    short = F.col("p") <= F.col("n") - F.ceil(8 * F.col("n") / 9) + 1
    several = found.groupBy("w").agg(F.count("*").alias("many"), F.max(short).alias("met")).filter("many > 1 and met").select("w")
    rows = stage(found.join(own_shuffle(several, "w"), "w").join(own_shuffle(left, "t"), "t"))
    small = rows.filter(short).select("w", _size_class(F.col("n")).alias("k"), F.col("t").alias("e"), F.col("c").alias("ec"), F.col("n").alias("m"), F.col("p").alias("q"))
    least = F.ceil(4 * F.col("n") / 5)
    most = F.least("n", F.floor(9 * (F.col("n") - F.col("p") + 1) / 4) - F.col("n"))
    large = rows.filter(least <= most).withColumn("k", F.explode(F.sequence(_size_class(least), _size_class(most))))
    met = large.join(small, ["w", "k"]).filter("c <> ec and (m < n or m = n and e < t) and 5 * m >= 4 * n")
    met = met.filter("9 * (n - p + 1) >= 4 * (m + n) and 9 * (m - q + 1) >= 4 * (m + n)")
    return met.select(F.least("t", "e").alias("ta"), F.greatest("t", "e").alias("tb")).distinct()


def _side(texts: DataFrame, s: str) -> DataFrame:
    return own_shuffle(texts, "t").select(F.col("t").alias(f"t{s}"), F.col("c").alias(f"c{s}"))


def _verify(docs: DataFrame, pairs: DataFrame, set_of) -> DataFrame:
    """The pairs (ta, tb) whose texts are alike by their whole sets."""
    pairs = stage(pairs)
    shown = _shown(docs, pairs.select(F.col("ta").alias("t")).union(pairs.select("tb")).distinct())
    of = lambda s: shown.select(F.col("t").alias(f"t{s}"), F.col("text").alias(f"text_{s}"))
    both = pairs.join(of("a"), "ta").join(of("b"), "tb")
    return both.mapInArrow(fresh(_verified(set_of)), "ta bigint, tb bigint")
