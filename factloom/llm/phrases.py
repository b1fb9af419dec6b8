"""Collocations by best-first growth of phrases from their prefixes, branch and bound.

A phrase of 2 or 3 words with a = f(phrase) >= LEAST occurrences is cut after its
first k words into parts with l and r occurrences; its score is the least of
floor(SCALE * a * a / (l * r)) over the cuts. Each language gives its first TOP.

Growth goes level by level, since a phrase can't be more frequent than its parts:

1. One pass counts words and pairs, summed per task before the shuffle. Pairs of LEAST
   or more are nodes of the search: leaves themselves, and prefixes of phrases of three.
2. Bounds. Of a prefix w1 w2 with p occurrences no child w1 w2 w3 scores above
   floor(SCALE * p / f(w1)), since a <= p and a <= f(w2 w3). Seen from its last two
   words with s occurrences, none scores above floor(SCALE * s / f(w3)).
3. Expansion, best first and per language: a threshold, that of the pair with the
   (WIDEN * TOP)-th best score, opens the nodes whose bound reaches it. A second pass
   over the texts counts the phrases of three below open nodes, and those that hold a
   pair which reaches the threshold, since they decide whether that pair survives.
4. All surviving phrases at or above the threshold are then known. A language with at
   least TOP of them is settled, ties included; for the others the threshold goes to a
   WIDEN times lower rank, at the end to 0, where everything is open.

Which nodes are open is told to the workers by a table of flags under hashes of the
pairs: up to FLAGS bytes, whatever the number of pairs, written to the shared folder.
Two pairs may share a place; then more is counted than needed, never less or wrongly.

Words: A-Z are lower-cased, texts are cut at . , ; : ! ? and the line ends U+000A to
U+000D into pieces, and those at spaces and tabs. A phrase lies inside one piece.
A candidate goes if a longer one (itself gone or not) holds its words side by side and
has at least half its occurrences. Scores and comparisons are exact (decimals of 38
digits). Null text is empty, null lang is ``und``; an empty table gives no rows, a
language of fewer candidates all of them. Repeated rows and rows without doc_id count
like others; no other column is read. Words of a very long text are read in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import new_folder, prepare, stage, text_or_empty, values

LEAST = 10
TOP = 2000
SCALE = 1_000_000
SHARE = 50
WIDEN = 4
FLAGS = 1 << 24
FLUSH_WORDS = 1 << 20
_BLOCK = 1 << 20
_FOLD = bytes.maketrans(bytes(range(0x41, 0x5B)) + b",;:!?\n\x0b\x0c\r\t", bytes(range(0x61, 0x7B)) + b"......... ")
_CUT = 0  # number of the sign that ends a piece
PREFIX, SUFFIX, REACHES, FREQUENT = 1, 2, 4, 8
_MUL = np.uint64(0x9E3779B97F4A7C15)


def word_blocks(text: str) -> Iterator[list[bytes]]:
    """Words, and ``.`` for each end of a piece, in blocks that no word spans."""
    data = text.encode().translate(_FOLD)
    at = 0
    while at < len(data):
        end = at + _BLOCK
        if end < len(data):
            cut = data.find(b" ", end)
            end = len(data) if cut < 0 else cut
        yield data[at:end].replace(b".", b" . ").split()
        at = end


class Numbers:
    """Words of a worker's batch as numbers; 0 ends a piece."""

    def __init__(self):
        self.of, self.words = {b".": _CUT}, [b"."]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        of, held = self.of, self.words
        for word in words:
            if word not in of:
                of[word] = len(held)
                held.append(word)
        return np.fromiter(map(of.__getitem__, words), np.int64, len(words))


def grams(ids: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """The words of all phrases of ``size`` words inside pieces, position by position."""
    n = len(ids) - size + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(size))
    ok = np.ones(n, bool)
    for k in range(size):
        ok &= ids[k : k + n] != _CUT
    at = np.flatnonzero(ok)
    return tuple(ids[at + k] for k in range(size))


def _counted(parts: tuple[np.ndarray, ...], width: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Distinct phrases and their counts; ``width`` is above all word numbers."""
    key = parts[0]
    if len(parts) < 3 or width < 1 << 21:
        for p in parts[1:]:
            key = key * width + p
        keys, n = np.unique(key, return_counts=True)
        out = []
        for _ in parts[1:]:
            out.append(keys % width)
            keys = keys // width
        return (keys, *reversed(out)), n
    order = np.lexsort(parts[::-1])
    cols = [p[order] for p in parts]
    first = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)]))
    return tuple(c[first] for c in cols), np.diff(np.append(first, len(order)))


def _in_lang(batches: Iterator[pa.RecordBatch], emit) -> Iterator[pa.RecordBatch]:
    """Collects the words of each language and gives ``emit`` (lang, numbers, words) once there are FLUSH_WORDS."""
    held: dict[str, list[np.ndarray]] = {}
    numbers, total = Numbers(), 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal numbers, total
        for lang, parts in held.items():
            yield from emit(lang, np.concatenate(parts), numbers.words)
        held.clear()
        numbers, total = Numbers(), 0

    for batch in batches:
        for lang, text in values(batch, "lang", "text"):
            own = held.setdefault(lang, [])
            for block in word_blocks(text):
                own.append(numbers.numbers(block))
                total += len(block)
            own.append(np.zeros(1, np.int64))
            if total >= FLUSH_WORDS:
                yield from flush()
    yield from flush()


_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def _batch(lang: str, words: pa.Array, parts: tuple[np.ndarray, ...], n: np.ndarray) -> pa.RecordBatch:
    columns = [words.take(pa.array(p)) for p in parts]
    phrase = pc.binary_join_element_wise(*columns, pa.scalar(" ")) if len(columns) > 1 else columns[0]
    return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(n), np.int64))), phrase, pa.array(n)], schema=_COUNTS)


def count_pairs(docs: DataFrame) -> DataFrame:
    """(lang, phrase, n): occurrences of all words and pairs; the empty phrase has the number of all words."""
    def emit(lang: str, ids: np.ndarray, words: list[bytes]) -> Iterator[pa.RecordBatch]:
        names = pa.array([w.decode() for w in words], pa.string())
        one = ids[ids != _CUT]
        if not len(one):
            return
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([""]), pa.array([len(one)])], schema=_COUNTS)
        n = np.bincount(one, minlength=len(words))
        some = np.flatnonzero(n)
        yield _batch(lang, names, (some,), n[some])
        yield from _sliced(lang, names, *_counted(grams(ids, 2), len(words)))

    return _texts(docs).mapInArrow(lambda batches: _in_lang(batches, emit), "lang string, phrase string, n bigint")


def _sliced(lang: str, names: pa.Array, parts: tuple[np.ndarray, ...], n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(n), 1 << 16):
        yield _batch(lang, names, tuple(p[at : at + (1 << 16)] for p in parts), n[at : at + (1 << 16)])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7)


def spots(lang: np.ndarray, first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    """Places of pairs in a table of ``size`` flags, from the hashes of language and words."""
    x = (first * _MUL + second) ^ lang
    x = (x ^ (x >> np.uint64(31))) * _MUL
    return ((x ^ (x >> np.uint64(29))) & np.uint64(size - 1)).astype(np.int64)


_PLACES = pa.schema([("place", pa.int32()), ("flags", pa.int8())])


def _hashes(texts: list[str]) -> np.ndarray:
    return np.fromiter((word_hash(t.encode()) for t in texts), np.uint64, len(texts))


def _places(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = spots(*(_hashes(batch.column(i).to_pylist()) for i in range(3)), size)
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), batch.column(3)], schema=_PLACES)

    return run


@lru_cache(maxsize=1)
def _flags(uri: str, size: int) -> np.ndarray:
    """The table of flags, read once by a worker."""
    out = np.zeros(size, np.int8)
    store, path = pafs.FileSystem.from_uri(uri)
    for batch in pads.dataset(path, filesystem=store, format="parquet").to_batches():
        np.bitwise_or.at(out, batch.column(0).to_numpy(), batch.column(1).to_numpy())
    return out


def count_triples(docs: DataFrame, uri: str, size: int) -> DataFrame:
    """(lang, phrase, n): occurrences of the phrases of three words that the flags open, and of some that share a place."""
    def emit(lang: str, ids: np.ndarray, words: list[bytes]) -> Iterator[pa.RecordBatch]:
        flags, of_lang = _flags(uri, size), _hashes([lang])
        a, b, c = grams(ids, 3)
        if not len(a):
            return
        hashes = np.fromiter(map(word_hash, words), np.uint64, len(words))
        left, right = flags[spots(of_lang, hashes[a], hashes[b], size)], flags[spots(of_lang, hashes[b], hashes[c], size)]
        both = (left & right & FREQUENT) != 0
        at = np.flatnonzero(both & (((left & PREFIX) != 0) & ((right & SUFFIX) != 0) | ((left | right) & REACHES != 0)))
        if len(at):
            yield from _sliced(lang, pa.array([w.decode() for w in words], pa.string()), *_counted((a[at], b[at], c[at]), len(words)))

    return _texts(docs).mapInArrow(lambda batches: _in_lang(batches, emit), "lang string, phrase string, n bigint")


def _exact(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def _score(a: str, left: str, right: str, scale: int) -> Column:
    """floor(scale * a * a / (left * right)) as a bigint, exactly."""
    top = (_exact(F.col(a)) * _exact(F.col(a)) * F.lit(scale).cast("decimal(10,0)")).cast("decimal(38,0)")
    return F.call_function("div", top, (_exact(F.col(left)) * _exact(F.col(right))).cast("decimal(38,0)"))


def _summed(counts: DataFrame, least: int) -> DataFrame:
    return counts.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter((F.col("f") >= least) | (F.col("phrase") == ""))


def _with(rows: DataFrame, of: DataFrame, phrase: str, name: str) -> DataFrame:
    """``name``: the occurrences of the phrase in column ``phrase``."""
    side = of.select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), F.col("f").alias(name))
    return rows.join(side, (F.col("lang") == F.col("_l")) & (F.col(phrase) == F.col("_p"))).drop("_l", "_p")


def _thresholds(pairs: DataFrame, rank: int) -> DataFrame:
    """(lang, t): the score of the pair of that rank, 0 for languages of fewer. A language has no more rows here than scores."""
    sums = pairs.groupBy("lang", "score").agg(F.count("*").alias("n"))
    above = sums.withColumn("above", F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("score"))))
    return above.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("above") >= rank, F.col("score"))), F.lit(0)).cast("bigint").alias("t"))


def _surviving(pairs: DataFrame, triples: DataFrame, share: int) -> DataFrame:
    """Candidates that no longer one with enough occurrences holds."""
    inside = triples.select("lang", "a", F.explode(F.array(F.concat_ws(" ", "w1", "w2"), F.concat_ws(" ", "w2", "w3"))).alias("phrase"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("a").alias("most")).select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), "most")
    left = pairs.join(longer, (F.col("lang") == F.col("_l")) & (F.col("phrase") == F.col("_p")), "left")
    left = left.filter(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a")))
    columns = ["lang", "phrase", "a", "l", "r", "score"]
    return left.select(*columns).union(triples.select(*columns))


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, scale: int = SCALE, share: int = SHARE, widen: int = WIDEN, flags: int = FLAGS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``top`` surviving phrases of every language."""
    spark = prepare(docs.sparkSession)
    counts = stage(_summed(count_pairs(docs), least))
    words = F.split("phrase", " ")
    pairs = counts.filter(F.size(words) == 2).select("lang", "phrase", F.col("f").alias("a"), words[0].alias("w1"), words[1].alias("w2"))
    pairs = _with(_with(pairs, counts, "w1", "l"), counts, "w2", "r").withColumn("score", _score("a", "l", "r", scale))
    pairs = stage(pairs)
    size = min(flags, 1 << max(16, (8 * pairs.count()).bit_length()))
    done, open_langs, rank = None, None, widen * top
    while True:
        limits = _thresholds(pairs, rank)
        if open_langs is not None:
            limits = limits.join(open_langs, "lang", "left_semi")
        limits = stage(limits)
        known = pairs.join(limits, "lang")
        reaches = lambda bound, flag: F.when(bound >= F.col("t"), flag).otherwise(0)
        bound = lambda over: F.call_function("div", F.col("a") * F.lit(scale), F.col(over))
        flagged = known.select("lang", "w1", "w2", (
            F.lit(FREQUENT) + reaches(bound("l"), PREFIX) + reaches(bound("r"), SUFFIX) + reaches(F.col("score"), REACHES)).cast("tinyint").alias("flags"))
        uri = new_folder(spark, "flags")
        places = flagged.mapInArrow(_places(size), "place int, flags tinyint")
        places.groupBy("place").agg(F.bit_or("flags").alias("flags")).write.parquet(uri)
        triples = _summed(count_triples(docs, uri, size), least).select("lang", "phrase", F.col("f").alias("a"), words[0].alias("w1"), words[1].alias("w2"), words[2].alias("w3"))
        triples = triples.withColumns({"p12": F.concat_ws(" ", "w1", "w2"), "p23": F.concat_ws(" ", "w2", "w3")})
        for phrase, name in (("w1", "f1"), ("w3", "f3"), ("p12", "f12"), ("p23", "f23")):
            triples = _with(triples, counts, phrase, name)
        triples = triples.withColumns({"s1": _score("a", "f1", "f23", scale), "s2": _score("a", "f12", "f3", scale)})
        first = F.col("s1") <= F.col("s2")
        triples = stage(triples.select(
            "lang", "phrase", "w1", "w2", "w3", "a", F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"),
            F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score")))
        found = _surviving(known.drop("t"), triples, share).join(limits, "lang").filter(F.col("score") >= F.col("t"))
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        best = stage(found.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top))
        settled = limits.join(best.groupBy("lang").agg(F.max("rank").alias("have")), "lang", "left")
        settled = stage(settled.select("lang", ((F.col("t") <= 0) | (F.coalesce("have", F.lit(0)) >= top)).alias("settled")))
        part = best.join(settled.filter("settled"), "lang", "left_semi")
        done = part if done is None else done.unionByName(part)
        open_langs = settled.filter("not settled").select("lang")
        if open_langs.isEmpty():
            break
        rank *= widen
    totals = counts.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    return done.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
