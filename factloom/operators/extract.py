"""Symbols, imports and call edges of source files."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom import fixed_values as V, schema
from factloom.functions.languages import EXTRACTORS, python_facts
from factloom.operators.facts import sql_functions, sql_statements

_PARAM = pa.struct([("name", pa.string()), ("type", pa.string()), ("default", pa.string())])
_ARROW = pa.schema([
    ("path", pa.string()), ("fact", pa.string()), ("seq", pa.int32()), ("name", pa.string()),
    ("kind", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("signature", pa.string()),
    ("return_type", pa.string()), ("params", pa.list_(_PARAM)), ("docstring", pa.string()),
    ("parent", pa.string()), ("visibility", pa.string()), ("is_static", pa.bool_()),
    ("is_abstract", pa.bool_()), ("module", pa.string()), ("caller", pa.string()),
])
# value of each column, in schema order, where a fact has none
_DEFAULTS = {
    "path": "", "fact": "", "seq": 0, "name": "", "kind": "", "line": 0, "end_line": 0, "signature": "", "return_type": "", "params": [],
    "docstring": "", "parent": "", "visibility": "", "is_static": False, "is_abstract": False,
    "module": "", "caller": "",
}


# the columns that facts of each kind fill
_PLAIN = ["path", "fact", "seq", "name"]
_FILLED = {
    "symbol": [c for c in _DEFAULTS if c not in ("module", "caller")], "import": [*_PLAIN, "line", "module"],
    "call": [*_PLAIN, "line", "caller"], "error": _PLAIN,
}


def _batch(facts: list[dict], names: Sequence[str]) -> pa.RecordBatch:
    fields = [_ARROW.field(n) for n in names]
    columns = []
    for f in fields:
        name, default = f.name, _DEFAULTS[f.name]
        columns.append(pa.array([fact.get(name, default) for fact in facts], f.type))
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))


def _first(facts: list[dict]) -> list[dict]:
    """The first fact of each kind and name, by path and number."""
    found: dict[tuple, dict] = {}
    for fact in facts:
        key = fact["fact"], fact["name"]
        known = found.get(key)
        if known is None or (fact["path"], fact["seq"]) < (known["path"], known["seq"]):
            found[key] = fact
    return list(found.values())


def file_facts(path: str, language: str, content: str | None, table: dict[str, Callable[[str], list[dict]]] | None = None) -> list[dict]:
    """The facts of one file, numbered by kind; a language without an extractor, or no content, gives none."""
    table = table or EXTRACTORS
    if language not in table or content is None:
        return []
    try:
        facts = table[language](content)
    except Exception as error:  # one bad file is a row, not a failed job
        facts = [{"fact": "error", "name": f"extract error: {error}"}]
    seqs: dict[str, int] = {}
    for fact in facts:
        kind = fact["fact"]
        fact["path"] = path
        fact["seq"] = seqs[kind] = seqs.get(kind, -1) + 1
    return facts


def extract(
    files: DataFrame, path: str = "path", language: str = "language", content: str = "content",
    extractors: dict[str, Callable[[str], list[dict]]] | None = None,
    only: Sequence[str] | None = None, columns: Sequence[str] | None = None, first_names: bool = False,
) -> DataFrame:
    """One tagged row per fact of each file (see ``schema.FACT``).

    A narrow step over Arrow batches: a file is read by one task, nothing is
    shuffled. Pass ``extractors`` to add a language or replace one. ``only``
    names the kinds of facts that are wanted: others do not leave the worker,
    nor do columns that the wanted kinds leave empty. ``columns`` names fewer.
    ``first_names`` is for readers that want the first fact of each kind and name, by
    path and number: in a batch of files, later ones do not leave the worker either.
    """
    table = dict(extractors or EXTRACTORS)
    filled = {c for kind in only for c in _FILLED.get(kind, _DEFAULTS)} if only else set(_DEFAULTS)
    names = [n for n in _DEFAULTS if n in (columns or filled)]
    kinds = frozenset(only or ())
    if kinds and table.get("Python") is python_facts:
        table["Python"] = partial(python_facts, wanted=kinds.union(names))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for file_path, lang, body in zip(*(c.to_pylist() for c in batch.columns)):
                facts = file_facts(file_path, lang, body, table)
                out += [f for f in facts if f["fact"] in kinds] if kinds else facts
                if len(out) > 20_000:
                    yield _batch(_first(out) if first_names else out, names)
                    out = []
            yield _batch(_first(out) if first_names else out, names)

    chosen = files.where(F.col(language).isin(*table)).select(path, language, content)
    types = dict(field.split(" ", 1) for field in schema.FACT.split(", "))
    return chosen.mapInArrow(run, ", ".join(f"{n} {types[n]}" for n in names))


def symbols(facts: DataFrame) -> DataFrame:
    rows = facts.where(F.col("fact") == "symbol")
    if "docstring" in facts.columns:
        # the whole SQL text travels in docstring; it is no docstring
        doc = F.when(F.col("kind") == "sql_in_xml", F.lit("")).otherwise(F.col("docstring"))
        rows = rows.withColumn("docstring", doc)
    return rows.select(*[c for c in schema.SYMBOL_COLUMNS if c in facts.columns])


def _named(facts: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Those of the columns that were extracted, with another name for ``name``."""
    return facts.select(*[F.col(c).alias(name if c == "name" else c) for c in columns if c in facts.columns])


def imports(facts: DataFrame) -> DataFrame:
    return _named(facts.where(F.col("fact") == "import"), ["path", "seq", "name", "line", "module"], "source")


def errors(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("fact") == "error").select("path", F.col("name").alias("error"))


def direct_calls(facts: DataFrame) -> DataFrame:
    return _named(facts.where(F.col("fact") == "call"), ["path", "seq", "caller", "name", "line"], "callee")


def xml_sql(facts: DataFrame) -> DataFrame:
    """SQL texts found in XML elements, whole."""
    return facts.where(F.col("kind") == "sql_in_xml").select(
        "path", "seq", F.col("parent").alias("element"), F.col("docstring").alias("sql"), "line"
    )


def xml_sql_calls(facts: DataFrame, function_table: DataFrame) -> DataFrame:
    """A call edge from the XML element to each SQL function in its text."""
    found = sql_functions(xml_sql(facts), function_table, ["path", "seq", "element"], line=F.col("line"))
    return found.select("path", "seq", F.col("element").alias("caller"), F.col("name").alias("callee"), "line")


def sql_symbols(files: DataFrame) -> DataFrame:
    """Statements of SQL files as symbols."""
    found = sql_statements(files.where(F.col("language") == "SQL"))
    empty = F.lit("")
    return found.select(
        "path", "seq", "name", F.lit("sql_statement").alias("kind"), "line", "end_line", "signature",
        empty.alias("return_type"), F.array().cast("array<" + schema.PARAM + ">").alias("params"),
        empty.alias("docstring"), empty.alias("parent"), empty.alias("visibility"),
        F.lit(False).alias("is_static"), F.lit(False).alias("is_abstract"),
    )


def call_graph(direct: DataFrame, xml_calls: DataFrame, indirect: DataFrame) -> DataFrame:
    """Direct edges, then indirect ones, with an order that puts indirect last.

    ``edge_seq`` orders the edges of one file; indirect edges come after all
    direct edges, as in the stored graph.
    """
    late = 1 << 40
    d = direct.unionByName(xml_calls).select(
        "path", F.col("seq").cast("bigint").alias("edge_seq"), "caller", "callee", "line",
        F.lit("direct").alias("edge_type"), F.lit("").alias("field"), F.lit(1).cast("bigint").alias("copies"),
    )
    i = indirect.select(
        "path", (F.lit(late) + F.col("line")).cast("bigint").alias("edge_seq"), "caller", "callee", "line",
        "edge_type", "field", "copies",
    )
    return d.unionByName(i)


def capped(graph: DataFrame, limit: int | None = None) -> DataFrame:
    """The stored view of a graph: direct edges before indirect, all of them or the first ``limit``."""
    rest = [c for c in ("caller", "callee", "line") if c in graph.columns]
    ordered = graph.orderBy(F.col("edge_type") == "indirect", "path", "edge_seq", *rest)
    return ordered if limit is None else ordered.limit(limit)
