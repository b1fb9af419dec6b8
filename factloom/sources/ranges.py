"""Large text files by byte ranges, as if each had been read whole.

A file of any size, also beyond the two gigabytes of one value, is cut into ranges of
``size`` bytes. A range owns the lines that start in it: a task opens the file there,
skips to the first line start and reads to the end of its last line. Lines and characters of
earlier ranges are sums over small rows, one a range, so that line numbers and offsets
are those of the whole file.

A match belongs to the range it starts in and may go on for ``reach`` bytes behind it;
``back`` bytes before it are there to look at. What a range must skip because a match
from an earlier one goes on into it is found by repeating: ranges whose skip has changed
are searched again, until none has. So the matches are those of one search over
the whole file, if none is longer than ``reach`` and no pattern looks farther back.

Invalid UTF-8 is decoded leniently and a byte order mark dropped, as for small files.
Files are opened by the URI that the listing gives, in stores that pyarrow knows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.operators.ordered import running_sum
from factloom.session import stage_table
from factloom.sources.files import _case_glob, relative
from factloom.sources.versions import store_of

SIZE = 64 << 20
REACH = 64 << 10
BACK = 4 << 10
_STEP = 1 << 20


def list_ranges(spark: SparkSession, root: str, size: int = SIZE, extensions: list[str] | None = None) -> DataFrame:
    """(path, uri, length, number) of all ranges; no content is read. An empty file has one range."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if extensions:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(_case_glob(e) for e in extensions) + "}")
    files = reader.load(root).select(relative(F.col("path"), root).alias("path"), F.col("path").alias("uri"), "length")
    last = F.floor((F.greatest(F.col("length"), F.lit(1)) - 1) / size)
    return files.select("path", "uri", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("number"))


def _line_start(f, at: int, length: int) -> int:
    """Where the first line at or behind ``at`` starts; the end of the file if none does."""
    if at == 0:
        return 0
    at -= 1
    while at < length:
        f.seek(at)
        data = f.read(min(_STEP, length - at))
        cut = data.find(b"\n")
        if cut >= 0:
            return at + cut + 1
        at += len(data)
    return length


def _decoded(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def read_range(uri: str, length: int, number: int, size: int, back: int = 0, reach: int = 0) -> tuple[str, str, str]:
    """Text before, own text and text behind of one range."""
    store, path = store_of(uri)
    with store.open_input_file(path) as f:
        start = min(_line_start(f, min(number * size, length), length), length)
        end = min(_line_start(f, min((number + 1) * size, length), length), length)
        f.seek(max(0, start - back))
        before = f.read(start - max(0, start - back))
        own = f.read(end - start) if end > start else b""
        behind = f.read(min(reach, length - end)) if end > start else b""
    if start == 0 and own.startswith(b"\xef\xbb\xbf"):
        own = own[3:]
    return _decoded(before), _decoded(own), _decoded(behind)


_HITS = (
    "path string, number bigint, pattern_seq int, start bigint, line bigint, text string, groups array<string>, context string, n_chars bigint, n_lines bigint, over array<bigint>"
)
_SCHEMA = pa.schema([
    ("path", pa.string()), ("number", pa.int64()), ("pattern_seq", pa.int32()), ("start", pa.int64()), ("line", pa.int64()), ("text", pa.string()),
    ("groups", pa.list_(pa.string())), ("context", pa.string()), ("n_chars", pa.int64()), ("n_lines", pa.int64()), ("over", pa.list_(pa.int64())),
])


def _search(patterns: Sequence[str], flags: int, size: int, back: int, reach: int, before: int, after: int):
    """Rows (path, uri, length, number, skip): a row per match with local places, and one per range with its sums and what its matches take of later ranges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(p, flags) for p in patterns]
        for batch in batches:
            for row in batch.to_pylist():
                left, own, right = read_range(row["uri"], row["length"], row["number"], size, back, reach)
                body, low, high = left + own + right, len(left), len(left) + len(own)
                over, out, taken = [], [], 0
                for p, pattern in enumerate(compiled):
                    skip = (row["skip"] or [0] * len(compiled))[p]
                    line, seen, end = 0, low, low + skip
                    for hit in pattern.finditer(body, low + skip) if low + skip < high else ():
                        if hit.start() >= high:
                            break
                        line += body.count("\n", seen, hit.start())
                        seen, end = hit.start(), hit.end()
                        around = body[max(0, seen - before) : end + after].replace("\n", " ").strip() if before or after else ""
                        out.append((row["path"], row["number"], p, seen - low, line, hit.group(), [g or "" for g in hit.groups()], around, None, None, None))
                        taken += 64 + 2 * (len(around) + len(hit.group()))
                        if taken > 8 << 20:
                            yield _batch(out)
                            out, taken = [], 0
                    over.append(max(0, end - high))
                out.append((row["path"], row["number"], None, None, None, None, None, None, len(own), own.count("\n"), over))
                yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def match_files(
    spark: SparkSession, root: str, patterns: Sequence[str], size: int = SIZE, flags: int = 0, before: int = 0, after: int = 0,
    reach: int = REACH, back: int = BACK, extensions: list[str] | None = None,
) -> DataFrame:
    """path, pattern_seq, match_seq, start, line, text, groups, context of all matches in all files, as ``match_all`` gives them for whole texts."""
    listed = stage_table(list_ranges(spark, root, size, extensions).withColumn("skip", F.lit(None).cast("array<bigint>")))
    search = _search(patterns, flags, size, back, reach, before, after)
    # ranges are dealt out one by one: a range is a task's work, not a row of it
    dealt = lambda rows: rows.repartition(F.col("path"), F.col("number"))
    found = stage_table(dealt(listed).mapInArrow(search, _HITS))
    none = F.array_repeat(F.lit(0).cast("bigint"), len(patterns))
    used = listed.select("path", "number", none.alias("used"))
    while True:
        sums = found.where("n_chars is not null")
        goes_on = sums.where(F.exists("over", lambda x: x > 0)).select("path", (F.col("number") + 1).alias("number"), "over")
        # a match that takes a whole range goes on behind it: then that range's own ``over`` says so
        now = used.join(goes_on, ["path", "number"], "left").select("path", "number", "used", F.coalesce("over", none).alias("skip"))
        changed = stage_table(now.where(F.col("skip") != F.col("used")).select("path", "number", "skip"))
        if changed.isEmpty():
            break
        again = listed.drop("skip").join(changed, ["path", "number"])
        kept = found.join(changed.select("path", "number"), ["path", "number"], "left_anti")
        found = stage_table(kept.unionByName(dealt(again).mapInArrow(search, _HITS)))
        used = stage_table(now.select("path", "number", F.col("skip").alias("used")))
    sums = stage_table(found.where("n_chars is not null").select("path", "number", "n_chars", "n_lines"))
    earlier = running_sum(sums, ["path"], "number", F.col("n_chars"), "chars_before", before_only=True)
    earlier = earlier.select("path", "number", "chars_before").join(
        running_sum(sums, ["path"], "number", F.col("n_lines"), "lines_before", before_only=True).select("path", "number", "lines_before"), ["path", "number"])
    hits = found.where("pattern_seq is not null").select("path", "number", "pattern_seq", "start", "line", "text", "groups", "context").join(earlier, ["path", "number"])
    placed = stage_table(hits.select(
        "path", "pattern_seq", (F.col("start") + F.col("chars_before")).alias("start"), (F.col("line") + F.col("lines_before") + 1).alias("line"), "text", "groups", "context"))
    from factloom.operators.ordered import row_numbers

    numbered = row_numbers(placed, ["path", "pattern_seq"], "start", "_n")
    return numbered.select("path", "pattern_seq", (F.col("_n") - 1).alias("match_seq"), "start", "line", "text", "groups", "context")
