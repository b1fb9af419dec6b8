"""Queries that validate generated text against the code facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import extract as X, facts, truth
from factloom.plans import corpus as P
from factloom.plans.q_code import PB, QB, SB, _PY_CALLS, i, python_edges, python_graph, python_names, rows
from factloom.plans.registry import query
from factloom.session import stage_table


@query("mentions", rows(PB, *(f"CAST(k AS BIGINT) AS doc, {n} AS name" for n in (
    "'run_' || k", "'load'", "'helper_' || c", "'core.load'", "'store'"))))
def mentions(spark, d):
    return truth.mentions(P.analyses(spark, d), ["doc"])


@query("table_mentions", rows(PB, "CAST(k AS BIGINT) AS doc, 'raw' AS table_name", "CAST(k AS BIGINT) AS doc, 'ghost_' || s AS table_name"))
def table_mentions(spark, d):
    return truth.table_mentions(P.analyses(spark, d), ["doc"])


def _index(spark, d):
    symbols, calls = python_names(spark, d)
    return truth.truth_index(calls, symbols, facts.udf_registrations(P.scala_files(spark, d)))


_FIRST = f"""
WITH e AS (SELECT callee, path, seq, line FROM ({_PY_CALLS})),
t AS (SELECT callee AS name, CAST(0 AS INTEGER) AS rank, path, seq, line, 'call' AS kind FROM e
  UNION ALL SELECT unnest(['LIMIT', '_cache', 'Job' || k, 'source_rows', 'run_' || k]), 1, path, unnest([0, 1, 3, 4, 2]), unnest([4, 5, 16, 17, 7]),
    unnest(['variable', 'variable', 'class', 'method', 'function']) FROM {PB}
  UNION ALL SELECT 'udf_' || n, 2, path, 0, 6, 'udf' FROM {SB}),
truth AS (SELECT name, CAST(min(rank) AS INTEGER) AS rank, arg_min(path, (rank, path, seq)) AS found_in,
    CAST(arg_min(line, (rank, path, seq)) AS INTEGER) AS line, arg_min(kind, (rank, path, seq)) AS kind FROM t GROUP BY name)
"""


@query("truth_index", _FIRST + "SELECT name, rank, found_in, line, kind FROM truth")
def truth_index(spark, d):
    return _index(spark, d)


def _checked(spark, d, index):
    return truth.validate_calls(truth.mentions(P.analyses(spark, d), ["doc"]), index)


def _validated(spark, d):
    """Checked mentions beside the symbols and calls that a second chance needs whole."""
    py, calls = python_graph(spark, d)
    symbols = X.symbols(py)
    index = truth.truth_index(calls, symbols, facts.udf_registrations(P.scala_files(spark, d)))
    return _checked(spark, d, index), symbols, calls


_MENTION = "(" + rows(PB, *(f"CAST(k AS BIGINT) AS doc, {n} AS name" for n in (
    "'run_' || k", "'load'", "'helper_' || c", "'core.load'", "'store'"))) + ")"
_VALID = _FIRST + f""", v AS (SELECT doc, m.name, CASE WHEN t.name IS NULL THEN 'unverified' ELSE 'verified' END AS status,
  CASE WHEN t.name IS NULL THEN '' ELSE 'exact' END AS match_type, coalesce(found_in, '') AS found_in,
  CAST(coalesce(line, 0) AS INTEGER) AS line, coalesce(kind, '') AS kind FROM {_MENTION} m LEFT JOIN truth t ON t.name = m.name)
"""


@query("validated_calls", _VALID + "SELECT * FROM v")
def validated_calls(spark, d):
    return _checked(spark, d, _index(spark, d))


_RESCUED = _VALID + """, r AS (SELECT doc, name, found_in, line, kind,
  CASE WHEN name = 'core.load' THEN 'verified' ELSE status END AS status, CASE WHEN name = 'core.load' THEN 'fuzzy' ELSE match_type END AS match_type,
  CASE WHEN name = 'core.load' THEN 'load' ELSE '' END AS matched_to FROM v)
"""


@query("rescued_calls", _RESCUED + "SELECT * FROM r")
def rescued_calls(spark, d):
    checked, symbols, calls = _validated(spark, d)
    return truth.rescue(stage_table(checked), truth.known_names(calls, symbols))


@query("accuracy", _RESCUED + """
SELECT doc, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'unverified') AS unverified,
  count(*) FILTER (status = 'verified') / count(*) AS accuracy FROM r GROUP BY doc""")
def accuracy(spark, d):
    checked, symbols, calls = _validated(spark, d)
    saved = truth.rescue(stage_table(checked), truth.known_names(calls, symbols))
    return truth.accuracy(saved, ["doc"], P.analyses(spark, d))


@query("known_names", f"""
SELECT DISTINCT unnest([caller, callee]) AS name FROM ({_PY_CALLS})
UNION SELECT unnest(['LIMIT', '_cache', 'Job' || k, 'source_rows']) FROM {PB}""")
def known_names(spark, d):
    py, calls = python_graph(spark, d)
    return truth.known_names(calls, X.symbols(py))


@query("call_edges", f"SELECT DISTINCT caller, callee FROM ({_PY_CALLS})")
def call_edges(spark, d):
    return truth.call_edges(python_edges(spark, d, "caller", "name"))


@query("missing_calls", f"""
SELECT DISTINCT callee FROM ({_PY_CALLS}) WHERE callee NOT IN (SELECT name FROM {_MENTION} m)""")
def missing_calls(spark, d):
    found = truth.mentions(P.analyses(spark, d), ["doc"])
    return truth.missing_calls(python_edges(spark, d, "name"), found)


@query("imports_index", rows(PB, *(f"path, '{s}' AS source" for s in ("os", "json", "load", "save"))))
def imports_index(spark, d):
    return truth.imports_index(X.imports(X.extract(P.python_files(spark, d), only=["import"], columns=["fact", "path", "name"])))


@query("known_tables", f"""
SELECT DISTINCT unnest(['IF', 'db', 'cust', 'base_' || s, 't1', 't2', 'TABLE', 'old_' || s]) AS table_name FROM {QB}""")
def known_tables(spark, d):
    return truth.known_tables(P.sql_files(spark, d).select(F.col("content").alias("sql")))


@query("udfs_in_text", f"""
WITH u AS (SELECT DISTINCT 'udf_' || n AS name FROM {SB})
SELECT CAST(k AS BIGINT) AS doc, name FROM {PB} b JOIN u ON contains('udf_' || (o_custkey % 30), name) OR contains('udf_99', name)""")
def udfs_in_text(spark, d):
    udfs = facts.udf_registrations(P.scala_files(spark, d))
    return truth.udfs_in_text(P.analyses(spark, d), ["doc"], udfs)


@query("unknown_udf_mentions", rows(
    PB, f"CAST(k AS BIGINT) AS doc, {i(0)} AS seq, CAST(o_custkey % 30 AS VARCHAR) AS name",
    f"CAST(k AS BIGINT) AS doc, {i(1)} AS seq, '99' AS name"))
def unknown_udf_mentions(spark, d):
    udfs = facts.udf_registrations(P.scala_files(spark, d))
    return truth.unknown_udf_mentions(P.analyses(spark, d), ["doc"], udfs)


@query("validation_summary", _RESCUED + """
, c AS (SELECT doc, count(*) FILTER (status = 'verified') AS v, count(*) AS n,
  string_agg('  - `' || name || '`' || CASE WHEN found_in <> '' THEN ' @ ' || found_in || ':' || line ELSE '' END, chr(10) ORDER BY name COLLATE "C") FILTER (status = 'verified') AS ok,
  string_agg('  - `' || name || '` (not found)', chr(10) ORDER BY name) FILTER (status = 'unverified') AS bad FROM r GROUP BY doc)
SELECT doc, concat_ws(chr(10), '## Validation', '### Verified (' || v || ')', ok, '### Not verified (' || (n - v) || ')', bad,
  '**Accuracy**: ' || CAST(round(100.0 * v / n) AS INTEGER) || '% (' || v || '/' || n || ')') AS summary FROM c""".replace(' COLLATE "C"', ""))
def validation_summary(spark, d):
    from factloom.plans.reports import validation_summary as summary

    checked, symbols, calls = _validated(spark, d)
    saved = stage_table(truth.rescue(stage_table(checked), truth.known_names(calls, symbols)))
    return summary(saved, ["doc"])


@query("correction_prompts", rows(PB, """CAST(k AS BIGINT) AS doc,
  'Correct the text below. These names could not be verified:' || chr(10) || '1. `core.load` is in no call graph or symbol table' || chr(10)
  || '2. `helper_' || c || '` is in no call graph or symbol table' || chr(10)
  || 'Use the verified name, or mark the statement as a guess. Keep everything else.' AS head"""))
def correction_prompts(spark, d):
    from factloom.plans.reports import correction_prompts as prompts

    checked = stage_table(_checked(spark, d, _index(spark, d)))
    found = prompts(P.analyses(spark, d), checked, ["doc"])
    return found.select("doc", F.substring_index("prompt", "\n\n", 1).alias("head"))
