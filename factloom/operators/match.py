"""Match-all over whole texts, and first-wins de-duplication."""

from __future__ import annotations

import re
from collections.abc import Callable, Hashable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MATCH_COLUMNS = (
    "pattern_seq int, match_seq int, start int, line int, text string, "
    "groups array<string>, context string"
)


def match_all(
    df: DataFrame,
    text: str,
    patterns: Sequence[str],
    keep: Sequence[str],
    before: int = 0,
    after: int = 0,
    flags: int = 0,
    prefilter: str | None = None,
    first_by: Callable[[int, re.Match], Hashable] | None = None,
    needs: Sequence[str] | None = None,
) -> DataFrame:
    """One row per match of each pattern: offset, line, groups and context.

    Spark's built-in expressions give the texts of all matches but not their
    offsets, so the scan runs in Arrow batches in the Python workers. It is a
    narrow step: nothing is shuffled, and a row is read once for all patterns.
    ``prefilter`` is a cheap pattern every match implies; rows without it stay
    in the JVM. ``context`` is the match with ``before``/``after`` characters
    around it, on one line. ``first_by`` gives a key per (pattern number, match);
    of the matches of one row with the same key only the first stays, in
    pattern order. A row is one file, so this first-wins needs no shuffle.
    ``needs`` names, per pattern, a lower-case text all its matches contain; the
    pattern is skipped on ASCII texts without it (other texts have letters that
    only equal ASCII ones when case is ignored).
    """
    source = df.select(*keep, F.col(text).alias("_text"))
    if prefilter:
        source = source.where(F.col("_text").rlike(prefilter))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_text")
    n_keep = len(keep)
    flag_value = int(flags)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        compiled = [re.compile(p, flag_value) for p in patterns]
        types = [pa.int32()] * 4 + [pa.string(), pa.list_(pa.string()), pa.string()]

        def found(batch: pa.RecordBatch, rows: list[int], hits: list[list]) -> pa.RecordBatch:
            index = pa.array(rows, pa.int64())
            columns = [batch.column(i).take(index) for i in range(n_keep)]
            columns += [pa.array(h, t) for h, t in zip(hits, types)]
            names = batch.schema.names[:n_keep] + [c.split()[0] for c in MATCH_COLUMNS.split(", ")]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            rows: list[int] = []
            hits: list[list] = [[], [], [], [], [], [], []]
            size = 0
            for r, value in enumerate(batch.column(n_keep)):
                body = value.as_py()
                if body is None:
                    continue
                met = set()
                lower = body.lower() if needs and body.isascii() else None
                for p, pattern in enumerate(compiled):
                    if lower is not None and needs[p] not in lower:
                        continue
                    line, seen = 1, 0
                    for m, hit in enumerate(pattern.finditer(body)):
                        if first_by:
                            key = first_by(p, hit)
                            if key in met:
                                continue
                            met.add(key)
                        start, end = hit.span()
                        line += body.count("\n", seen, start)
                        seen = start
                        around = ""
                        if before or after:
                            around = body[max(0, start - before):end + after].replace("\n", " ").strip()
                        rows.append(r)
                        size += 2 * len(around) + 2 * len(hit.group())
                        for column, item in zip(
                            hits, (p, m, start, line, hit.group(), [g or "" for g in hit.groups()], around)
                        ):
                            column.append(item)
                        # dense texts give many more bytes of hits than they have
                        if len(rows) >= 20_000 or size >= 8 << 20:
                            yield found(batch, rows, hits)
                            rows, hits, size = [], [[], [], [], [], [], [], []], 0
            yield found(batch, rows, hits)

    return source.mapInArrow(scan, f"{fields}, {MATCH_COLUMNS}" if fields else MATCH_COLUMNS)


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the lowest order per key.

    A ``min_by`` aggregate: each task keeps one row per key before the
    shuffle, so a key holding a third of all rows costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    )
    return picked.select(*keys, *[F.col("_first")[c].alias(c) for c in rest]).select(*df.columns)
