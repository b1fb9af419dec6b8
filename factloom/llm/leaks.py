"""Decontamination: benchmark passages in the training texts, found with suffix arrays.

The training texts are read in shards of about SHARD_BYTES inside the tasks that scan
them; nothing is shuffled. For each shard

1. words become numbers of the benchmark's vocabulary, 0 where it has no such word.
   Only runs of known words, at least as long as the shortest window, can match;
2. the suffixes inside those runs are sorted: by as many words as fit 63 bits first,
   then, only where suffixes tie, by doubling the compared length up to the longest
   item. The common prefixes of adjacent suffixes follow, as far as a window;
3. every test suffix is looked up by binary search (all of them at once, a step each),
   keeping the common prefixes with both ends of the search. Its neighbours give its
   longest verbatim match in the shard and a place of it (``longest_matches``); the
   block of suffixes with a window in common gives all occurrences of that window.

A window is WINDOW consecutive words of an item; an item of fewer words, but not none,
is one window. Words: A-Z are lower-cased; a word is a run of characters that are
neither ASCII signs nor ASCII controls nor spaces.

The benchmark is written once to the shared folder. A worker reads it in blocks of
about BLOCK_BYTES and keeps the first; so a benchmark of any size passes in bounded
memory, and the driver never holds it.

Null or empty texts have no words and no hits; null and empty items have no window.
Rows of documents are judged one by one, repeated rows and null doc_ids included.
Items are told apart by item_id; rows with one item_id are one item, and all without
are one item of empty name. Empty tables give no rows, or no hits. A text is held
whole by one task, its words by block. Other columns are not read, or pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Rows, new_folder, prepare, text_or_empty, values

WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 8 << 20
_TEXT_BLOCK = 1 << 20
_PAIRS = 1 << 22
_SIGNS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes.maketrans(_SIGNS + bytes(range(0x41, 0x5B)), b" " * len(_SIGNS) + bytes(range(0x61, 0x7B)))


def word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in blocks that no word spans."""
    data = data.translate(_FOLD)
    at = 0
    while at < len(data):
        end = at + _TEXT_BLOCK
        if end < len(data):
            cut = data.find(b" ", end)
            end = len(data) if cut < 0 else cut
        yield data[at:end].split()
        at = end


class Items:
    """A block of benchmark items: their words as numbers, and where a window starts."""

    def __init__(self, names: list[str], texts: list[bytes], window: int = WINDOW):
        self.names, self.window, self.vocabulary = names, window, {}
        number = self.vocabulary.setdefault
        parts, sizes = [], []
        for text in texts:
            words = [number(w, len(self.vocabulary) + 1) for block in word_blocks(text) for w in block]
            parts.append(np.array([*words, 0], np.int64))
            sizes.append(len(words))
        self.sizes = np.array(sizes, np.int64)
        self.words = np.concatenate([*parts, np.zeros(1, np.int64)])
        need = np.minimum(self.sizes, window)
        count = np.where(self.sizes > 0, self.sizes - need + 1, 0)
        self.item = np.repeat(np.arange(len(sizes)), count)
        self.offset = np.arange(len(self.item)) - np.repeat(np.cumsum(count) - count, count)
        begin = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.start = begin[self.item] + self.offset if len(sizes) else np.zeros(0, np.int64)
        self.left = self.sizes[self.item] - self.offset if len(sizes) else np.zeros(0, np.int64)
        self.need = need[self.item] if len(sizes) else np.zeros(0, np.int64)
        self.least = int(self.need.min(initial=window))
        self.longest = int(self.sizes.max(initial=0))


class Shard:
    """Sorted suffixes of some texts, as far as they can match items."""

    def __init__(self, texts: list[bytes], items: Items):
        get = items.vocabulary.get
        parts, begins, at = [], [], 0
        for text in texts:
            begins.append(at)
            for block in word_blocks(text):
                parts.append(np.fromiter(map(get, block, repeat(0)), np.int64, len(block)))
                at += len(block)
            parts.append(np.zeros(1, np.int64))
            at += 1
        self.begins = np.array(begins, np.int64)
        self.ends = np.append(self.begins[1:], at) - 1
        words = np.concatenate([*parts, np.zeros(1, np.int64)])
        stops = np.flatnonzero(words == 0)
        runs = np.diff(stops, prepend=-1) - 1
        long = runs >= items.least
        begin = (stops - runs)[long]
        size = runs[long]
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        self.words, self.places, self.run = words, np.repeat(begin, size) + inside, np.repeat(size, size) - inside
        self.order = self._sorted(len(items.vocabulary).bit_length(), items.longest)
        self.common = self._common(items.window)

    def _sorted(self, bits: int, depth: int) -> np.ndarray:
        """Indices of ``places`` in the order of their suffixes, compared over ``depth`` words at least."""
        words, places, run = self.words, self.places, self.run
        have = max(1, 63 // max(bits, 1))
        key, last = np.zeros(len(places), np.int64), len(words) - 1
        for k in range(have):
            key = key << bits | np.where(run > k, words[np.minimum(places + k, last)], 0)
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(places), np.int64)
        first = np.ones(len(places), bool)
        first[1:] = key[order[1:]] != key[order[:-1]]
        rank[order] = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        index = np.zeros(len(words) + 1, np.int64)
        index[places] = np.arange(len(places))
        while have < depth:
            alone = first & np.append(first[1:], True)
            tied = np.flatnonzero(~alone)
            if not len(tied):
                break
            some = order[tied]
            then = np.where(run[some] > have, rank[index[np.minimum(places[some] + have, last)]] + 1, 0)
            to = np.lexsort((then, rank[some]))
            some, then = some[to], then[to]
            order[tied] = some
            new = np.ones(len(some), bool)
            new[1:] = (rank[some[1:]] != rank[some[:-1]]) | (then[1:] != then[:-1])
            rank[some] = np.maximum.accumulate(np.where(new, tied, 0))
            first[tied] = new
            have *= 2
        return order

    def _common(self, window: int) -> np.ndarray:
        """Words in common of each suffix with the one before it, as far as a window."""
        a, b = self.order[:-1], self.order[1:]
        common, same = np.zeros(len(self.order), np.int64), np.ones(len(b), bool)
        for k in range(window):
            same = same & (np.minimum(self.run[a], self.run[b]) > k)
            at = np.flatnonzero(same)
            same[at] = self.words[self.places[a[at]] + k] == self.words[self.places[b[at]] + k]
            common[1:] += same
        return common

    def search(self, items: Items) -> tuple[np.ndarray, np.ndarray]:
        """(length, rank) of the longest match of every test suffix, by binary search over all of them at once."""
        n, m = len(self.order), len(items.start)
        low, high = np.zeros(m, np.int64), np.full(m, n, np.int64)
        low_common, high_common = np.zeros(m, np.int64), np.zeros(m, np.int64)
        active = np.flatnonzero(low < high)
        while len(active):
            mid = (low[active] + high[active]) // 2
            at = self.order[mid]
            place, run = self.places[at], self.run[at]
            start, left = items.start[active], items.left[active]
            common = np.minimum(low_common[active], high_common[active])
            going = np.arange(len(active))
            while len(going):
                going = going[(common[going] < run[going]) & (common[going] < left[going])]
                going = going[self.words[place[going] + common[going]] == items.words[start[going] + common[going]]]
                common[going] += 1
            ended = common == left
            # a run or an item ends with 0, less than any word
            less = ~ended & (self.words[place + common] < items.words[start + common])
            low[active[less]], low_common[active[less]] = mid[less] + 1, common[less]
            high[active[~less]], high_common[active[~less]] = mid[~less], common[~less]
            active = active[low[active] < high[active]]
        after = high_common >= low_common
        return np.where(after, high_common, low_common), np.where(after, low, low - 1)

    def text_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, place, side="right") - 1

    def hits(self, items: Items, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, list[tuple[int, str]]]:
        """Which words lie in an occurrence of a window, and the (text, item) pairs that have one."""
        length, rank = found
        edge, pairs = np.zeros(len(self.words) + 1, np.int64), np.zeros(0, np.int64)
        for need in np.unique(items.need).tolist():
            of = np.flatnonzero((items.need == need) & (length >= need))
            if not len(of):
                continue
            block = np.cumsum(self.common < need)
            used, which = np.unique(block[rank[of]], return_inverse=True)
            met = np.flatnonzero(np.isin(block, used))
            place = self.places[self.order[met]]
            edge += np.bincount(place, minlength=len(edge)) - np.bincount(place + need, minlength=len(edge))
            in_texts = np.unique(np.stack([np.searchsorted(used, block[met]), self.text_of(place)], axis=1), axis=0)
            in_items = np.unique(np.stack([which, items.item[of]], axis=1), axis=0)
            lo = np.searchsorted(in_items[:, 0], in_texts[:, 0])
            many = np.searchsorted(in_items[:, 0], in_texts[:, 0], side="right") - lo
            total = np.cumsum(many)
            at = 0
            while at < len(many):
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS, side="right")))
                n = many[at:to]
                item = in_items[np.repeat(lo[at:to], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n), 1]
                pairs = np.unique(np.concatenate([pairs, np.repeat(in_texts[at:to, 1], n) * len(items.names) + item]))
                at = to
        k = max(len(items.names), 1)
        return np.cumsum(edge)[:-1] > 0, [(int(p) // k, items.names[int(p) % k]) for p in pairs]


def item_blocks(uri: str, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The stored benchmark, block by block; the first one is kept by the worker."""
    first, total = _first_block(uri, window, block_bytes)
    yield first
    if total > 1:
        for i, items in enumerate(_read_blocks(uri, window, block_bytes)):
            if i:
                yield items


@lru_cache(maxsize=1)
def _first_block(uri: str, window: int, block_bytes: int) -> tuple[Items, int]:
    blocks = _read_blocks(uri, window, block_bytes)
    first = next(blocks, None) or Items([], [], window)
    return first, 1 + (next(blocks, None) is not None)


def _read_blocks(uri: str, window: int, block_bytes: int) -> Iterator[Items]:
    store, path = pafs.FileSystem.from_uri(uri)
    names, texts, size = [], [], 0
    for batch in pads.dataset(path, filesystem=store, format="parquet").to_batches(batch_size=1024):
        for name, text in values(batch, "item", "text"):
            data = text.encode()
            if texts and size + len(data) > block_bytes:
                yield Items(names, texts, window)
                names, texts, size = [], [], 0
            names.append(name)
            texts.append(data)
            size += len(data)
    if texts:
        yield Items(names, texts, window)


def store_items(benchmark: DataFrame) -> str:
    """Writes the items that have a text to the shared folder; gives its URI."""
    uri = new_folder(benchmark.sparkSession, "benchmark")
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_or_empty().alias("text"))
    rows.filter(F.length("text") > 0).write.parquet(uri)
    return uri


def _shards(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], shard_bytes: int) -> Iterator[tuple[list[tuple], list[bytes]]]:
    """Rows without their text, and the texts, in shards."""
    rows, texts, size = [], [], 0
    for batch in batches:
        for *row, text in values(batch, *names, "text"):
            data = text.encode()
            if texts and size + len(data) > shard_bytes:
                yield rows, texts
                rows, texts, size = [], [], 0
            rows.append(tuple(row))
            texts.append(data)
            size += len(data)
    if texts:
        yield rows, texts


def scan_shard(texts: list[bytes], blocks: Iterator[Items]) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """For each text of a shard: its number of words, the runs [lo, hi) of hit words, the names of items with a window in it."""
    hit, items = None, [set() for _ in texts]
    for block in blocks:
        shard = Shard(texts, block)
        found, pairs = shard.hits(block, shard.search(block))
        hit = found if hit is None else hit | found
        for i, name in pairs:
            items[i].add(name)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).reshape(-1, 2)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for (lo, hi), i in zip(edges.tolist(), shard.text_of(edges[:, 0]).tolist(), strict=True):
        spans[i].append((lo - int(shard.begins[i]), hi - int(shard.begins[i])))
    return (shard.ends - shard.begins).tolist(), spans, [sorted(s) for s in items]


SCANNED = "doc_id bigint, text_hash bigint, n_words bigint, n_hit bigint, items array<string>, spans array<struct<lo: bigint, hi: bigint>>"
_SCANNED = pa.schema([
    ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
])


def _rows_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Of every row: doc_id, text_hash, n_words, n_hit, the items with a window in it, the runs of hit words; narrow."""
    prepare(docs.sparkSession)
    uri = store_items(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(_SCANNED)
        for rows, texts in _shards(batches, ("doc_id", "text_hash"), shard_bytes):
            n_words, spans, items = scan_shard(texts, item_blocks(uri, window, block_bytes))
            for row, n, own, names in zip(rows, n_words, spans, items, strict=True):
                out.add((*row, n, sum(hi - lo for lo, hi in own), names, [{"lo": lo, "hi": hi} for lo, hi in own]), 64 + 16 * len(own) + 16 * len(names))
                if out.full():
                    yield out.take()
        yield out.take()

    return _rows_of(docs).mapInArrow(run, SCANNED)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every word of an item where a match of a window or more starts: item, item_start, the longest length, and its first place (doc_id, doc_start)."""
    prepare(docs.sparkSession)
    uri = store_items(benchmark)
    schema = pa.schema([("item", pa.string()), ("item_start", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("doc_start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _shards(batches, ("doc_id",), shard_bytes):
            for items in item_blocks(uri, window, block_bytes):
                shard = Shard(texts, items)
                length, rank = shard.search(items)
                of = np.flatnonzero(length >= items.need)
                # suffixes alike as far as the longest match, the first of them in the shard
                place = shard.places[shard.order[rank[of]]]
                i = shard.text_of(place)
                yield pa.RecordBatch.from_arrays([
                    pa.array([items.names[k] for k in items.item[of]], pa.string()), pa.array(items.offset[of]), pa.array(length[of]),
                    pa.array([rows[k][0] for k in i], pa.int64()), pa.array(place - shard.begins[i])], schema=schema)

    found = _rows_of(docs).select("doc_id", "text").mapInArrow(run, "item string, item_start bigint, length bigint, doc_id bigint, doc_start bigint")
    best = F.max(F.struct("length", (-F.col("doc_id")).alias("_d"), (-F.col("doc_start")).alias("_s"))).alias("best")
    return found.groupBy("item", "item_start").agg(best).select("item", "item_start", "best.length", (-F.col("best._d")).alias("doc_id"), (-F.col("best._s")).alias("doc_start"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows, with their own columns, that hold no window of the benchmark."""
    gone = scan(docs, benchmark, window).filter("n_hit > 0").select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_text")).distinct()
    same = (F.xxhash64(text_or_empty()) == F.col("_gone_text")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("_gone_id"))
    return docs.join(gone, same, "left_anti")
