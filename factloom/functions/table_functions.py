"""Table functions for SQL: match-all, lines and facts over any query.

    register(spark)
    SELECT * FROM match_all(TABLE(SELECT doc_id, text FROM documents), 'text', array('[a-z]+'))

``match_all`` and ``text_lines`` take any table: their columns are those of the table
without the text, then their own, worked out by ``analyze`` before the query runs. They are
narrow: no PARTITION BY is needed, each task streams its rows. ``code_facts`` has fixed
columns and gets whole Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import arrow_udtf, udtf
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _kept(table: AnalyzeArgument, text: AnalyzeArgument, new: list[tuple[str, DataType]]) -> StructType:
    """The table's columns without its text, and ``new`` ones; names must not meet."""
    if not isinstance(table.dataType, StructType):
        raise ValueError("the first argument must be a TABLE")
    if not text.isConstantExpression or not isinstance(text.value, str) or text.value not in table.dataType.names:
        raise ValueError("the second argument must be the name of one of the table's columns")
    schema = StructType()
    for f in table.dataType.fields:
        if f.name != text.value:
            if f.name.lower() in {n for n, _ in new}:
                raise ValueError(f"column {f.name} meets one of the function's own: rename it")
            schema = schema.add(f.name, f.dataType, f.nullable)
    for name, kind in new:
        schema = schema.add(name, kind)
    return schema


class MatchAll:
    """A row per match of each pattern: pattern_seq, match_seq, start, line, match_text, groups. A null text has none."""

    _NEW = [("pattern_seq", IntegerType()), ("match_seq", IntegerType()), ("start", LongType()), ("line", LongType()), ("match_text", StringType()), ("groups", ArrayType(StringType()))]

    def __init__(self):
        self.compiled: tuple[tuple, list[re.Pattern]] = ((), [])

    @staticmethod
    def analyze(table: AnalyzeArgument, text: AnalyzeArgument, patterns: AnalyzeArgument) -> AnalyzeResult:
        if patterns.dataType != ArrayType(StringType(), False) and patterns.dataType != ArrayType(StringType(), True):
            raise ValueError("the third argument must be an array of patterns")
        for pattern in patterns.value or [] if patterns.isConstantExpression else []:
            re.compile(pattern)
        return AnalyzeResult(schema=_kept(table, text, MatchAll._NEW))

    def eval(self, row: Row, text: str, patterns: list[str]) -> Iterator[tuple]:
        body = row[text]
        if body is None:
            return
        if self.compiled[0] != tuple(patterns):
            self.compiled = (tuple(patterns), [re.compile(p) for p in patterns])
        kept = tuple(row[n] for n in row.__fields__ if n != text)
        for p, pattern in enumerate(self.compiled[1]):
            line, seen = 1, 0
            for m, hit in enumerate(pattern.finditer(body)):
                line += body.count("\n", seen, hit.start())
                seen = hit.start()
                yield (*kept, p, m, seen, line, hit.group(), [g or "" for g in hit.groups()])


class TextLines:
    """A row per line of the text: line_no from 1, line_text. A null text has none."""

    _NEW = [("line_no", LongType()), ("line_text", StringType())]

    @staticmethod
    def analyze(table: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(schema=_kept(table, text, TextLines._NEW))

    def eval(self, row: Row, text: str) -> Iterator[tuple]:
        if row[text] is not None:
            kept = tuple(row[n] for n in row.__fields__ if n != text)
            for i, line in enumerate(row[text].split("\n"), 1):
                yield (*kept, i, line)


_FACT = pa.schema([("path", pa.string()), ("fact", pa.string()), ("seq", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("caller", pa.string())])


class CodeFacts:
    """Symbols, imports and calls of a table with the columns path, language and content."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        from factloom.operators.extract import file_facts

        rows: list[tuple] = []
        for path, language, content in zip(*(batch.column(n).to_pylist() for n in ("path", "language", "content")), strict=True):
            for f in file_facts(path, language, content):
                rows.append(tuple(f.get(n, "") if n not in ("seq", "line") else f.get(n, 0) for n in _FACT.names))
            if len(rows) > 20_000:
                yield _table(rows)
                rows = []
        yield _table(rows)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in _FACT]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FACT, strict=True)], schema=_FACT)


def register(spark: SparkSession) -> None:
    """Makes the functions known to this session's SQL."""
    spark.udtf.register("match_all", udtf(MatchAll, useArrow=True))
    spark.udtf.register("text_lines", udtf(TextLines, useArrow=True))
    spark.udtf.register("code_facts", arrow_udtf(CodeFacts, returnType="path string, fact string, seq int, name string, kind string, line int, caller string"))
