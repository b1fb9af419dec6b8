"""Queries on the code corpora: symbols, calls, callbacks, SQL, outputs, lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import callbacks as C, extract as X, facts, outputs as O, taxonomy
from factloom.plans import corpus as P
from factloom.plans.registry import query
from factloom.session import stage_table

SYMBOLS = ["path", "seq", "name", "kind", "line", "end_line", "signature", "return_type", "parent", "visibility"]


def rows(base: str, *tuples: str) -> str:
    """One SELECT per expected fact over the same base rows."""
    return " UNION ALL ".join(f"SELECT {t} FROM {base}" for t in tuples)


def i(n: int) -> str:
    return f"CAST({n} AS INTEGER)"


def sym(seq, name, kind, line, end, sig="''", ret="''", parent="''", vis="''") -> str:
    return (
        f"path, {i(seq)} AS seq, {name} AS name, '{kind}' AS kind, {i(line)} AS line, {i(end)} AS end_line, "
        f"{sig} AS signature, {ret} AS return_type, {parent} AS parent, {vis} AS visibility"
    )


def call(seq, caller, callee, line) -> str:
    return f"path, {i(seq)} AS seq, {caller} AS caller, {callee} AS callee, {i(line)} AS line"


def imp(seq, source, line, module="''") -> str:
    return f"path, {i(seq)} AS seq, {source} AS source, {i(line)} AS line, {module} AS module"


CB = """(SELECT 'src/' || lower(p_type) || '/part_' || p_partkey || '.c' AS path, CAST(p_partkey AS VARCHAR) AS k, lower(p_type) AS t,
  CAST(p_size AS VARCHAR) AS s, replace(p_brand, 'Brand#', '') AS b FROM part)"""
JB = """(SELECT 'java/' || lower(c_mktsegment) || '/Customer' || c_custkey || '.java' AS path, CAST(c_custkey AS VARCHAR) AS k,
  CAST(c_nationkey AS VARCHAR) AS n, lower(c_mktsegment) AS g FROM customer)"""
SB = JB.replace("'java/'", "'scala/'").replace("'/Customer'", "'/Job'").replace("'.java'", "'.scala'")
PB = """(SELECT 'py/' || lower(o_orderstatus) || '/order_' || o_orderkey || '.py' AS path, CAST(o_orderkey AS VARCHAR) AS k,
  lower(o_orderstatus) AS s, CAST(o_custkey AS VARCHAR) AS c, o_orderkey, o_custkey FROM orders)"""
QB = PB.replace("'py/'", "'sql/'").replace("'/order_'", "'/o_'").replace("'.py'", "'.sql'")
XB = """(SELECT 'conf/nation_' || s_nationkey || '/pipe_' || s_suppkey || '.xml' AS path, CAST(s_suppkey AS VARCHAR) AS k,
  CAST(s_nationkey AS VARCHAR) AS n FROM supplier)"""


# C ------------------------------------------------------------------------

@query("c_symbols", rows(
    CB,
    sym(0, "'ops_' || s", "struct", 4, 8),
    sym(1, "'size'", "variable", 5, 5, "'int size'", parent="'ops_' || s"),
    sym(2, "'(*on_' || t || ')(int code, char *msg)'", "variable", 6, 6, "'int (*on_' || t || ')(int code, char *msg)'", parent="'ops_' || s"),
    sym(3, "'(*handler)(void *ctx)'", "variable", 7, 7, "'void (*handler)(void *ctx)'", parent="'ops_' || s"),
    sym(4, "'run_' || k", "function", 10, 18, "'static int run_' || k || '(struct ops_' || s || ' *p, int n)'", "'int'"),
))
def c_symbols(spark, d):
    return X.symbols(X.extract(P.c_files(spark, d), only=["symbol"])).select(*SYMBOLS)


@query("c_imports", rows(CB, imp(0, "'<stdio.h>'", 1), imp(1, "'\"brand_' || b || '.h\"'", 2)))
def c_imports(spark, d):
    return X.imports(X.extract(P.c_files(spark, d), only=["import"]))


_C_CALLS = rows(CB, call(0, "'run_' || k", "'p->handler'", 16), call(1, "'run_' || k", "'helper_' || s", 17))


@query("c_calls", _C_CALLS)
def c_calls(spark, d):
    return X.direct_calls(X.extract(P.c_files(spark, d), only=["call"]))


@query("c_params", rows(
    CB, "path, 'run_' || k AS name, ['*p', 'n'] AS names, ['struct ops_' || s, 'int'] AS types"))
def c_params(spark, d):
    s = X.symbols(X.extract(P.c_files(spark, d), only=["symbol"])).where("kind = 'function'")
    return s.select("path", "name", F.col("params.name").alias("names"), F.col("params.type").alias("types"))


@query("pointer_fields", rows(
    CB,
    f"path, 'ops_' || s AS struct, 'on_' || t AS field, 'int' AS return_type, {i(6)} AS line",
    f"path, 'ops_' || s AS struct, 'handler' AS field, 'void' AS return_type, {i(7)} AS line",
))
def pointer_fields(spark, d):
    return C.pointer_fields(P.c_files(spark, d))


_REGS = rows(
    CB,
    f"path, 'p' AS var, 'on_' || t AS field, 'handle_' || b AS func, {i(12)} AS line",
    f"path, 'p' AS var, 'handler' AS field, 'cb_' || b AS func, {i(13)} AS line",
)


@query("callback_registrations", _REGS)
def callback_registrations(spark, d):
    return C.registrations(P.c_files(spark, d))


@query("indirect_calls", rows(CB, f"path, 'p->handler' AS expression, 'handler' AS field, {i(16)} AS line"))
def indirect_calls(spark, d):
    return C.indirect_calls(P.c_files(spark, d))


_INDIRECT = f"""
SELECT c.path, 'p->handler' AS caller, r.func AS callee, {i(16)} AS line, 'indirect' AS edge_type, 'handler' AS field, r.copies
FROM {CB} c, (SELECT 'cb_' || b AS func, count(*) AS copies FROM {CB} GROUP BY ALL) r"""


def callback_facts(spark, d):
    """Pointer fields, registrations and indirect calls, found once and stored."""
    files = P.c_files(spark, d)
    return stage_table(C.pointer_fields(files)), stage_table(C.registrations(files)), stage_table(C.indirect_calls(files))


@query("indirect_edges", _INDIRECT)
def indirect_edges(spark, d):
    files = P.c_files(spark, d)
    return C.indirect_edges(stage_table(C.indirect_calls(files)), stage_table(C.registrations(files)))


@query("dispatch_tables", f"""
WITH f AS (SELECT 'ops_' || s AS struct, unnest(['on_' || t, 'handler']) AS field FROM {CB}),
r AS ({_REGS}), n AS (SELECT field, count(*) AS n FROM r GROUP BY field)
SELECT struct, (SELECT count(*) FROM f g WHERE g.struct = d.struct) AS n_fields, CAST(sum(n) AS BIGINT) AS n_registrations
FROM (SELECT DISTINCT struct, field FROM f) d JOIN n USING (field) GROUP BY struct""")
def dispatch_tables(spark, d):
    files = P.c_files(spark, d)
    return C.dispatch_tables(stage_table(C.pointer_fields(files)), C.registrations(files))


@query("dispatch_callbacks", f"""
WITH f AS (SELECT DISTINCT 'ops_' || s AS struct, unnest(['on_' || t, 'handler']) AS field FROM {CB}),
r AS (SELECT field, func, count(*) AS copies FROM ({_REGS}) GROUP BY ALL)
SELECT struct, field, func, copies FROM f JOIN r USING (field)""")
def dispatch_callbacks(spark, d):
    fields, regs, _ = callback_facts(spark, d)
    return C.dispatch_callbacks(fields, regs)


@query("callback_summary", f"""
WITH c AS (SELECT count(*) AS n, count(DISTINCT s) AS s FROM {CB})
SELECT unnest(['func_pointer_fields', 'callback_registrations', 'indirect_calls', 'dispatch_tables', 'enhanced_edges']) AS fact,
       unnest([2 * n, 2 * n, n, s, n * n]) AS n FROM c""")
def callback_summary(spark, d):
    fields, regs, calls = callback_facts(spark, d)
    return C.callback_summary(fields, regs, calls, C.dispatch_tables(fields, regs), C.indirect_edges(calls, regs))


@query("callback_cap", f"SELECT * FROM ({_REGS})")
def callback_cap(spark, d):
    return C.stored_view(C.registrations(P.c_files(spark, d)))


@query("extract_errors", rows(CB, "path, 'extract error' AS error"))
def extract_errors(spark, d):
    wrong = P.c_files(spark, d).withColumn("language", F.lit("Python"))
    return X.errors(X.extract(wrong)).select("path", F.substring_index("error", ":", 1).alias("error"))


@query("structure_totals", f"""
WITH c AS (SELECT count(*) AS n FROM {CB}), j AS (SELECT count(*) AS n FROM {JB})
SELECT 'symbol' AS fact, CAST(5 * c.n + 4 * j.n AS BIGINT) AS n FROM c, j
UNION ALL SELECT 'import', 2 * c.n + 2 * j.n FROM c, j UNION ALL SELECT 'call', 2 * c.n + 2 * j.n FROM c, j""")
def structure_totals(spark, d):
    files = P.c_files(spark, d).unionByName(P.java_files(spark, d))
    return X.extract(files).groupBy("fact").agg(F.count("*").alias("n"))


@query("symbol_names", f"""
SELECT name, count(*) AS n, min(path) AS path FROM (
  SELECT unnest(['LIMIT', '_cache', 'source_rows', 'run_' || k, 'Job' || k]) AS name, path FROM {PB}) GROUP BY name""")
def symbol_names(spark, d):
    from factloom.operators.truth import first_reference

    return first_reference(X.symbols(X.extract(P.python_files(spark, d), only=["symbol"])), "name", ["path", "seq"], ["path"])


@query("call_graph", f"""
SELECT path, caller, callee, line, 'direct' AS edge_type, '' AS field, CAST(1 AS BIGINT) AS copies FROM ({_C_CALLS})
UNION ALL SELECT path, caller, callee, line, edge_type, field, copies FROM ({_INDIRECT})
UNION ALL SELECT path, 'pipeline/step', 'upper', {i(3)}, 'direct', '', CAST(1 AS BIGINT) FROM {XB}
UNION ALL SELECT path, 'pipeline/step', 'rank_' || n, {i(3)}, 'direct', '', CAST(1 AS BIGINT) FROM {XB}""")
def call_graph(spark, d):
    files = P.c_files(spark, d)
    xml = X.xml_sql_calls(X.extract(P.xml_files(spark, d)), taxonomy.function_table(spark))
    indirect = C.indirect_edges(C.indirect_calls(files), C.registrations(files))
    return X.call_graph(X.direct_calls(X.extract(files, only=["call"])), xml, indirect).drop("edge_seq")


@query("call_graph_cap", f"""
SELECT path, caller, callee FROM ({_C_CALLS}) UNION ALL SELECT path, caller, callee FROM ({_INDIRECT})""")
def call_graph_cap(spark, d):
    files = P.c_files(spark, d)
    facts_ = X.extract(files)
    none = X.direct_calls(facts_).where("false")
    indirect = C.indirect_edges(C.indirect_calls(files), C.registrations(files))
    graph = X.call_graph(X.direct_calls(facts_), none, indirect)
    return X.capped(graph).select("path", "caller", "callee")


# Java -----------------------------------------------------------------------

@query("java_symbols", rows(
    JB,
    sym(0, "'Customer' || k", "class", 5, 12, "'class Customer' || k || ' extends Base' || n || ' implements Audit' || n || ', Scored'"),
    sym(1, "'score'", "variable", 6, 6, parent="'Customer' || k"),
    sym(2, "'rate'", "method", 7, 10, "'public static int rate(int base, String label, double w) {'", "'int'", "'Customer' || k", "'public'"),
    sym(3, "'audit'", "method", 11, 11, "'protected abstract void audit()'", "'void'", "'Customer' || k", "'protected'"),
))
def java_symbols(spark, d):
    return X.symbols(X.extract(P.java_files(spark, d), only=["symbol"])).select(*SYMBOLS)


@query("java_methods", rows(
    JB,
    "path, 'rate' AS name, true AS is_static, false AS is_abstract, ['base', 'label', 'w'] AS names, ['int', 'String', ''] AS types",
    "path, 'audit' AS name, false AS is_static, true AS is_abstract, CAST([] AS VARCHAR[]) AS names, CAST([] AS VARCHAR[]) AS types",
))
def java_methods(spark, d):
    s = X.symbols(X.extract(P.java_files(spark, d), only=["symbol"])).where("kind = 'method'")
    return s.select(
        "path", "name", "is_static", "is_abstract", F.col("params.name").alias("names"), F.col("params.type").alias("types")
    )


@query("java_imports", rows(JB, imp(0, "'java.util.List'", 2), imp(1, "'com.acme.Util.log'", 3)))
def java_imports(spark, d):
    return X.imports(X.extract(P.java_files(spark, d), only=["import"]))


@query("java_calls", rows(
    JB, call(0, "'Customer' || k || '.rate'", "'log.info'", 8), call(1, "'Customer' || k || '.rate'", "'helper' || n", 9)))
def java_calls(spark, d):
    return X.direct_calls(X.extract(P.java_files(spark, d), only=["call"]))


def _history(spark, d):
    """The Java corpus after three updates: older texts of all files, all but every third file, all files."""
    from uuid import uuid4

    from factloom.session import ensure_checkpoint_dir
    from factloom.streaming import changes

    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/factloom-facts-{uuid4().hex}"
    files = stage_table(P.java_files(spark, d).select("path", "language", "content"))
    third = F.regexp_extract("path", r"(\d+)\.java", 1).cast("bigint") % 3 == 0
    changes.update_from(files.withColumn("content", F.replace("content", F.lit("log.info"), F.lit("log.debug"))), out)
    changes.update_from(files.where(~third), out)
    return changes.update_from(files, out)


_EDGES = " UNION ALL ".join(f"SELECT {c} FROM {JB}" for c in ("'Customer' || k || '.rate' AS caller, 'log.info' AS callee", "'Customer' || k || '.rate', 'helper' || n"))


@query("changed_edges", f"SELECT caller, callee, count(*) AS copies FROM ({_EDGES}) GROUP BY ALL")
def changed_edges(spark, d):
    return _history(spark, d)["edges"]


@query("changed_names", f"""
SELECT name, count(*) AS n, min(path) AS path, min(line) AS line, min(kind) AS kind FROM (
  SELECT unnest(['Customer' || k, 'score', 'rate', 'audit', 'log.info', 'helper' || n]) AS name, path, unnest([5, 6, 7, 11, 8, 9]) AS line,
    unnest(['class', 'variable', 'method', 'method', 'call', 'call']) AS kind FROM {JB}) GROUP BY name""")
def changed_names(spark, d):
    return _history(spark, d)["names"]


@query("java_dispatch", rows(
    JB, *(f"path, 'Customer' || k AS class, {i(5)} AS line, '{rel}' AS relation, {target} AS target" for rel, target in (
        ("extends", "'Base' || n"), ("implements", "'Audit' || n"), ("implements", "'Scored'")))))
def java_dispatch(spark, d):
    return C.java_dispatch(X.symbols(X.extract(P.java_files(spark, d), only=["symbol"])))


# Scala ----------------------------------------------------------------------

@query("scala_symbols", rows(
    SB,
    sym(0, "'Job' || k", "object", 4, 14),
    sym(1, "'run'", "method", 5, 12, "'def run(spark: SparkSession): Unit = {'", parent="'Job' || k"),
    sym(2, "'twice'", "method", 13, 13, "'def twice(a: Int) = plus(a)'", parent="'Job' || k"),
))
def scala_symbols(spark, d):
    return X.symbols(X.extract(P.scala_files(spark, d), only=["symbol"])).select(*SYMBOLS)


@query("scala_calls", rows(
    SB, *(call(n, "'Job' || k || '.run'", f"'{c}'", 6 + n) for n, c in enumerate((
        "spark.udf.register", "XMLLoader.load", "spark.sql", "df.write.parquet", "df.write.saveAsTable", "XMLLoader.load"))),
    call(6, "'Job' || k || '.twice'", "'plus'", 13)))
def scala_calls(spark, d):
    return X.direct_calls(X.extract(P.scala_files(spark, d), only=["call"]))


@query("scala_imports", rows(SB, imp(0, "'org.apache.spark.sql.SparkSession'", 2)))
def scala_imports(spark, d):
    return X.imports(X.extract(P.scala_files(spark, d), only=["import"]))


@query("udf_registrations", rows(
    SB, f"path, 'udf_' || n AS name, 'Job' || k AS class_name, {i(6)} AS line, 'spark.udf.register' AS registration_type"))
def udf_registrations(spark, d):
    return facts.udf_registrations(P.scala_files(spark, d))


@query("xml_loaders", rows(
    SB, f"path, 'conf/' || g || '.xml' AS xml_file, {i(7)} AS line, 'XMLLoader.load' AS method"))
def xml_loaders(spark, d):
    return facts.xml_loaders(P.scala_files(spark, d)).drop("context")


@query("scala_outputs", rows(
    SB,
    f"'/out/cust_' || k AS name, 'spark_file' AS output_type, path, {i(9)} AS line, 'Spark write.format: .write.parquet(\"/out/cust_' || k || '\"' AS evidence",
    f"'mart.cust_' || n AS name, 'spark_table' AS output_type, path, {i(10)} AS line, 'Spark saveAsTable: .saveAsTable(\"mart.cust_' || n || '\"' AS evidence",
))
def scala_outputs(spark, d):
    return O.regex_outputs(P.scala_files(spark, d)).select("name", "output_type", "path", "line", "evidence")


@query("scala_embedded_sql", rows(
    SB, f"path, 'SELECT c_custkey, my_udf(c_name) FROM crm.cust_' || n || ' WHERE c_acctbal > 0' AS sql, {i(8)} AS line"))
def scala_embedded_sql(spark, d):
    return facts.embedded_sql(P.scala_files(spark, d)).drop("seq")


# Python ---------------------------------------------------------------------

@query("python_symbols", rows(
    PB,
    sym(0, "'LIMIT'", "variable", 4, 4, "'LIMIT = ' || c"),
    sym(1, "'_cache'", "variable", 5, 5, "'_cache = {}'"),
    sym(2, "'run_' || k", "function", 7, 14, "'def run_' || k || '(src: str, n=10) -> int:'", "'int'"),
    sym(3, "'Job' || k", "class", 16, 18, "'class Job' || k || '(Base)'"),
    sym(4, "'source_rows'", "method", 17, 18, "'def source_rows(self, spark):'", parent="'Job' || k"),
))
def python_symbols(spark, d):
    return X.symbols(X.extract(P.python_files(spark, d), only=["symbol"])).select(*SYMBOLS)


@query("python_functions", rows(
    PB, "path, 'run_' || k AS name, 'Load order ' || k || '.' AS docstring, ['src', 'n'] AS names, ['str', ''] AS types, ['', '10'] AS defaults"))
def python_functions(spark, d):
    s = X.symbols(X.extract(P.python_files(spark, d), only=["symbol"])).where("kind = 'function'")
    return s.select(
        "path", "name", "docstring", F.col("params.name").alias("names"), F.col("params.type").alias("types"),
        F.col("params.default").alias("defaults"),
    )


@query("python_imports", rows(
    PB, imp(0, "'os'", 1), imp(1, "'json'", 1), imp(2, "'load'", 2, "'app.core'"), imp(3, "'save'", 2, "'app.core'")))
def python_imports(spark, d):
    return X.imports(X.extract(P.python_files(spark, d), only=["import"]))


_PY_CALLS = rows(
    PB, *(call(n, "'run_' || k", f"'{c}'", line) for n, (c, line) in enumerate((
        ("load", 9), ("open", 11), ("f.write", 12), ("bus.send", 13), ("store", 14)))),
    call(5, "'Job' || k || '.source_rows'", "'spark.table(\"t\").count'", 18),
    call(6, "'Job' || k || '.source_rows'", "'spark.table'", 18), call(7, "'<module>'", "'run_' || k", 21))


@query("python_calls", _PY_CALLS)
def python_calls(spark, d):
    return X.direct_calls(X.extract(P.python_files(spark, d), only=["call"]))


_PY_SQL = "'INSERT OVERWRITE TABLE dw.orders_' || s || ' SELECT * FROM raw.orders_' || s"


@query("embedded_sql", rows(PB, f"path, {i(0)} AS seq, {_PY_SQL} AS sql, {i(10)} AS line"))
def embedded_sql(spark, d):
    return facts.embedded_sql(P.python_files(spark, d))


_PY_OUTPUTS = rows(
    PB,
    f"'dw.orders_' || s AS name, 'db_table' AS output_type, path, {i(10)} AS line, 'SQL INSERT: INSERT OVERWRITE TABLE dw.orders_' || s AS evidence",
    f"'out/order_' || k || '.csv' AS name, 'file' AS output_type, path, {i(11)} AS line, 'Python open(w): open(\"out/order_' || k || '.csv\", \"w' AS evidence",
    f"'topic_' || s AS name, 'message' AS output_type, path, {i(13)} AS line, 'Kafka/RabbitMQ send: .send(\"topic_' || s || '\"' AS evidence",
)


@query("regex_outputs", _PY_OUTPUTS)
def regex_outputs(spark, d):
    return O.regex_outputs(P.python_files(spark, d)).select("name", "output_type", "path", "line", "evidence")


@query("output_context", rows(
    PB, "path, 'topic_' || s AS name, 'w\") as f:         f.write(data)     bus.send(\"topic_' || s || '\")     return store(data)  class Job' || k || '(Base):     de' AS context").replace(
        "'(Base):     de'", "left('(Base):     def source_rows(self, spark):', greatest(0, 60 - length(')' || chr(10) || '    return store(data)' || chr(10) || chr(10) || 'class Job' || k)))"))
def output_context(spark, d):
    found = O.regex_outputs(P.python_files(spark, d)).where("output_type = 'message'")
    # the part before the match starts inside a line whose length varies
    return found.select("path", "name", F.regexp_replace("context", r'^.*?w"\) as', 'w") as').alias("context"))


@query("sql_text_outputs", rows(
    PB, f"'dw.orders_' || s AS name, 'db_table' AS output_type, path, {i(10)} AS line, 'sql' AS detection_layer, 'SQL INSERT OVERWRITE dw.orders_' || s AS evidence"))
def sql_text_outputs(spark, d):
    stmts = facts.embedded_sql(P.python_files(spark, d))
    return O.sql_outputs(stmts).select("name", "output_type", "path", "line", "detection_layer", "evidence")


@query("sql_file_outputs", rows(
    QB,
    f"'mart.ord_' || k AS name, 'SQL CREATE TABLE mart.ord_' || k AS evidence, path, {i(2)} AS line",
    f"'log_' || s AS name, 'SQL INSERT INTO log_' || s AS evidence, path, {i(6)} AS line",
))
def sql_file_outputs(spark, d):
    stmts = facts.sql_statements(P.sql_files(spark, d)).select("path", F.col("signature").alias("sql"), "line")
    return O.sql_outputs(stmts).select("name", "evidence", "path", "line")


def _merged(spark, d):
    py = P.python_files(spark, d)
    again = O.regex_outputs(py, confidence="medium", layer="ast")
    return O.merge_layers([O.regex_outputs(py), again, O.sql_outputs(facts.embedded_sql(py))])


@query("merged_outputs", f"""
SELECT *, 'high' AS confidence, 'regex' AS detection_layer, CAST(0 AS INTEGER) AS rank FROM ({_PY_OUTPUTS})""")
def merged_outputs(spark, d):
    return O.ranked(_merged(spark, d)).drop("context")


@query("output_histogram", f"""
SELECT output_type, count(*) AS n, count(*) AS high, CAST(0 AS BIGINT) AS medium, CAST(0 AS BIGINT) AS low FROM ({_PY_OUTPUTS}) GROUP BY output_type""")
def output_histogram(spark, d):
    return O.type_histogram(_merged(spark, d))


_GRAPH_COLUMNS = ["path", "fact", "seq", "name", "kind", "line", "signature", "caller"]


def python_edges(spark, d, *columns):
    """Call edges of the Python files for a single reader, with the wanted columns alone: no table is stored between them."""
    return X.direct_calls(X.extract(P.python_files(spark, d), only=["call"], columns=["fact", *columns]))


def python_graph(spark, d, *only):
    """Facts and call edges of the Python files; ``only`` the kinds of facts that are wanted (symbols and calls)."""
    only = only or ("symbol", "call")
    py = stage_table(X.extract(P.python_files(spark, d), only=only, columns=_GRAPH_COLUMNS))
    calls = X.direct_calls(py)
    return py, calls.select("path", F.col("seq").alias("edge_seq"), "caller", "callee", "line")


def python_names(spark, d):
    """Symbols and callees of the Python files: of each name the first of a batch of files, and no columns but those that place it."""
    py = stage_table(X.extract(P.python_files(spark, d), only=("symbol", "call"), columns=["fact", "path", "seq", "name", "kind", "line"], first_names=True))
    calls = X.direct_calls(py)
    return X.symbols(py), calls.select("path", F.col("seq").alias("edge_seq"), "callee", "line")


@query("output_container", f"""
SELECT name, output_type, path, line, 'run_' || regexp_extract(path, '_(\\d+)', 1) AS container FROM ({_PY_OUTPUTS})""")
def output_container(spark, d):
    found = O.regex_outputs(P.python_files(spark, d)).select("name", "output_type", "path", "line")
    return O.containing_function(found, python_graph(spark, d, "call")[1])


@query("output_inputs", f"""
WITH o AS (SELECT *, regexp_extract(path, '_(\\d+)', 1) AS k, regexp_extract(path, 'py/(.)/', 1) AS s FROM ({_PY_OUTPUTS}))
SELECT name, output_type, path, line, 'upstream_caller' AS relationship, 'function' AS source_type, '<module>' AS source_name, path AS source_path, {i(21)} AS source_line FROM o
UNION ALL SELECT name, output_type, path, line, 'sql_input', 'db_table', 'raw.orders_' || s, path, {i(10)} FROM o
UNION ALL SELECT name, output_type, path, line, 'data_read', 'data_read', 'source_rows', path, {i(17)} FROM o""")
def output_inputs(spark, d):
    found = stage_table(O.regex_outputs(P.python_files(spark, d)).drop("found_at"))
    py, calls = python_graph(spark, d)
    return O.trace_inputs(found, calls, facts.embedded_sql(P.python_files(spark, d)), X.symbols(py))


# SQL ------------------------------------------------------------------------

_STMT = {
    "CREATE": ("'CREATE TABLE IF NOT EXISTS mart.ord_' || k || ' AS' || chr(10) || 'SELECT upper(o_comment), my_fn(o_key), sum(left(x, 2)) FROM db.orders_' || s || ' o JOIN `cust` c ON o.k = c.k'"),
    "INSERT": "'INSERT INTO TABLE log_' || s || ' VALUES (''a;b'', now())'",
    "DELETE": "'DELETE FROM old_' || s || ' WHERE id = ' || k",
}


@query("sql_symbols", rows(
    QB,
    sym(0, "'SQL_CREATE_2'", "sql_statement", 2, 3, _STMT["CREATE"]),
    sym(2, "'SQL_INSERT_6'", "sql_statement", 6, 6, _STMT["INSERT"]),
    sym(3, "'SQL_DELETE_7'", "sql_statement", 7, 7, _STMT["DELETE"]),
))
def sql_symbols(spark, d):
    return X.sql_symbols(P.sql_files(spark, d)).select(*SYMBOLS)


def _scripts(spark, d):
    return P.sql_files(spark, d).select("path", F.col("content").alias("sql"))


@query("sql_functions", rows(
    QB, *(f"path, '{n}' AS name, {i(line)} AS line, {b} AS is_builtin, '{c}' AS category" for n, line, b, c in (
        ("upper", 3, "true", "string"), ("my_fn", 3, "false", "unknown"), ("sum", 3, "true", "aggregate"), ("now", 6, "true", "datetime")))))
def sql_functions(spark, d):
    found = facts.sql_functions(_scripts(spark, d), taxonomy.function_table(spark), ["path"])
    return found.drop("context", "match_seq")


@query("stmt_tables", rows(
    QB, *(f"path, {t} AS table_name, {i(n)} AS seq" for n, t in enumerate((
        "'IF'", "'db.orders_' || s", "'cust'", "'base_' || s", "'t1'", "'t2'", "'TABLE'", "'old_' || s")))))
def stmt_tables(spark, d):
    return facts.table_refs(_scripts(spark, d), ["path"])


@query("stmt_ctes", rows(QB, f"path, {i(0)} AS seq, 't1' AS cte"))
def stmt_ctes(spark, d):
    return facts.cte_names(_scripts(spark, d), ["path"])


# XML ------------------------------------------------------------------------

_XSQL = "'SELECT upper(s_name), rank_' || n || '(s_acctbal)' || chr(10) || '    FROM ext.supp_' || n || ' WHERE s_acctbal > 0'"


@query("xml_symbols", rows(
    XB,
    sym(0, "'pipeline'", "xml_element", 2, 9, "'<pipeline name=p' || k || ', owner=n' || n || '>'"),
    sym(1, "'step'", "xml_element", 3, 6, "'<step id=1>'", parent="'pipeline'"),
    sym(2, "'SQL_step_3'", "sql_in_xml", 3, 6, _XSQL, parent="'pipeline/step'"),
    sym(3, "'note'", "xml_element", 7, 7, "'<note>'", parent="'pipeline'"),
))
def xml_symbols(spark, d):
    return X.symbols(X.extract(P.xml_files(spark, d), only=["symbol"])).select(*SYMBOLS)


@query("xml_sql_calls", rows(
    XB, *(f"path, {i(2)} AS seq, 'pipeline/step' AS caller, {c} AS callee, {i(3)} AS line" for c in ("'upper'", "'rank_' || n"))))
def xml_sql_calls(spark, d):
    return X.xml_sql_calls(X.extract(P.xml_files(spark, d)), taxonomy.function_table(spark))


@query("xml_tables", rows(XB, f"path, 'ext.supp_' || n AS table_name, {i(0)} AS seq"))
def xml_tables(spark, d):
    return facts.table_refs(X.xml_sql(X.extract(P.xml_files(spark, d))), ["path"])


# SQL longer than any display column: the table stands after 600 characters and more --------------

_LONG = "'INSERT OVERWRITE TABLE dw.long_' || (o_orderkey % 97) || ' SELECT ' || repeat('column_name_' || o_orderkey || ', ', 40 + CAST(o_orderkey % 9 AS INTEGER)) || 'x FROM raw.deep_' || (o_orderkey % 89)"


def _long_sql(spark, d):
    """A Python file per order with one long statement."""
    sql = (
        "concat('INSERT OVERWRITE TABLE dw.long_', o_orderkey % 97, ' SELECT ', repeat(concat('column_name_', o_orderkey, ', '), 40 + int(o_orderkey % 9)), "
        "'x FROM raw.deep_', o_orderkey % 89)"
    )
    return P.table(spark, d, "orders").selectExpr("concat('sql/o_', o_orderkey, '.py') AS path", f"concat('x = 1\\nq = \"', {sql}, '\"\\n') AS content")


@query("long_sql_tables", """
SELECT 'sql/o_' || o_orderkey || '.py' AS path, unnest(['dw.long_' || (o_orderkey % 97), 'raw.deep_' || (o_orderkey % 89)]) AS table_name FROM orders""")
def long_sql_tables(spark, d):
    return facts.table_refs(facts.embedded_sql(_long_sql(spark, d)), ["path"]).select("path", "table_name")


@query("long_sql_outputs", f"""
SELECT 'sql/o_' || o_orderkey || '.py' AS path, 'dw.long_' || (o_orderkey % 97) AS name, {i(2)} AS line, length({_LONG})::INTEGER AS chars FROM orders""")
def long_sql_outputs(spark, d):
    stmts = facts.embedded_sql(_long_sql(spark, d)).select("path", "sql", "line")
    found = O.sql_outputs(stmts).select("path", "name", "line")
    return found.join(stmts.select("path", F.length("sql").alias("chars")), "path")


# every form of a pattern table, one file per row, the form chosen by its key ---------------------

# (text, registration type)
_UDF_FORMS = [
    ('spark.udf.register("u_{k}", f)', "spark.udf.register"), ('session.udf.register("u_{k}", f)', "udf.register"), ('val u = UDF("u_{k}")', "udf.register"),
    ('ctx.registerFunction("u_{k}", f)', "registerFunction"), ('reg.registerJavaFunction("u_{k}", "com.A")', "registerJavaFunction"), ("@udf class u_{k}", "@UDF annotation"),
    ('@UDF(1) object u_{k}', "@UDF annotation"), ('UDFRegistration("u_{k}")', "udf.register"), ('functions.register("u_{k}", f)', "udf.register"),
]
# (text, method)
_XML_FORMS = [
    ('spark.read.xml("c/{k}.xml")', "spark.read.xml"), ('spark.read.format("xml").option("a", "b").load("c/{k}.xml")', "spark.read.format(xml)"), ('XMLLoader.load("c/{k}.xml")', "XMLLoader.load"),
    ('new XmlReader("c/{k}.xml")', "XmlReader"), ('x.load("c/{k}.xml")', ".load(xml)"), ('Source.fromFile("c/{k}.xml")', "scala.io.Source"), ('XML.parse("c/{k}.xml")', "scala.xml.XML"),
    ('configPath = "c/{k}.xml"', ".load(xml)"),
]
# (text, name, types)
_OUTPUT_FORMS = [
    ("INSERT INTO TABLE a.t_{k}", "a.t_{k}", "db_table"), ("CREATE TABLE t_{k}", "t_{k}", "db_table"), ("MERGE INTO t_{k}", "t_{k}", "db_table"), ('x.write.csv("/o/{k}")', "/o/{k}", "spark_file"),
    ('x.save("o_{k}")', "o_{k}", "spark_file"), ('x.saveAsTable("t_{k}")', "t_{k}", "spark_table"), ('x.insertInto("t_{k}")', "t_{k}", "spark_table"),
    ('spark.sql("a INSERT INTO TABLE t_{k}")', "t_{k}", "db_table spark_table"), ('x.option("dbtable", "t_{k}")', "t_{k}", "db_table"), ('open("f_{k}.txt", "wb")', "f_{k}.txt", "file"),
    ('x.to_json("f_{k}")', "f_{k}", "file"), ('json.dump(x, open("f_{k}"))', "f_{k}", "file"), ('Path("f_{k}").write_text(1)', "f_{k}", "file api_endpoint"), ('@app.route("/r_{k}")', "/r_{k}", "api_endpoint"),
    ('@app.get("/r_{k}")', "/r_{k}", "api_endpoint"), ('path("r_{k}")', "r_{k}", "api_endpoint"), ('@GetMapping(value="/r_{k}")', "/r_{k}", "api_endpoint"), ('x.send("m_{k}")', "m_{k}", "message"),
    ('x.publish("m_{k}")', "m_{k}", "message"), ('x.emit("m_{k}")', "m_{k}", "message"),
]


def _form_sql(forms: list[tuple], column: int, key: str) -> str:
    listed = ", ".join("'" + f[column].replace("'", "''") + "'" for f in forms)
    return f"replace([{listed}][{key} % {len(forms)} + 1], '{{k}}', {key}::VARCHAR)"


def _form_files(spark, d, table: str, key: str, forms: list[tuple], before: str, after: str, ext: str):
    text = F.element_at(F.array(*[F.lit(f[0]) for f in forms]), (F.col(key) % len(forms) + 1).cast("int"))
    body = F.replace(F.concat(F.lit(before), text, F.lit(after)), F.lit("{k}"), F.col(key).cast("string"))
    return P.table(spark, d, table).select(F.concat(F.lit("f/"), F.col(key).cast("string"), F.lit(ext)).alias("path"), body.alias("content"))


@query("udf_forms", f"""
SELECT 'f/' || c_custkey || '.scala' AS path, 'u_' || c_custkey AS name, 'Job' || c_custkey AS class_name, {i(2)} AS line, {_form_sql(_UDF_FORMS, 1, 'c_custkey')} AS registration_type FROM customer""")
def udf_forms(spark, d):
    return facts.udf_registrations(_form_files(spark, d, "customer", "c_custkey", _UDF_FORMS, "class Job{k} {\n  ", "\n}\n", ".scala"))


@query("xml_load_forms", f"""
SELECT 'f/' || c_custkey || '.scala' AS path, 'c/' || c_custkey || '.xml' AS xml_file, {i(2)} AS line, {_form_sql(_XML_FORMS, 1, 'c_custkey')} AS method,
  'class Job' || c_custkey || ' {{   ' || {_form_sql(_XML_FORMS, 0, 'c_custkey')} || ' }}' AS context FROM customer""")
def xml_load_forms(spark, d):
    found = facts.xml_loaders(_form_files(spark, d, "customer", "c_custkey", _XML_FORMS, "class Job{k} {\n  ", "\n}\n", ".scala"))
    return found.withColumn("context", F.when(F.col("context").startswith("class"), F.col("context")))


@query("output_forms", f"""
WITH f AS (SELECT o_orderkey AS k, string_split({_form_sql(_OUTPUT_FORMS, 2, 'o_orderkey')}, ' ') AS types FROM orders)
SELECT {_form_sql(_OUTPUT_FORMS, 1, 'k')} AS name, unnest(types) AS output_type, 'f/' || k || '.py' AS path, {i(2)} AS line, {_form_sql(_OUTPUT_FORMS, 0, 'k')} AS context FROM f""")
def output_forms(spark, d):
    found = O.regex_outputs(_form_files(spark, d, "orders", "o_orderkey", _OUTPUT_FORMS, "\n", "\n", ".py"))
    return found.select("name", "output_type", "path", "line", "context")


@query("short_sql", f"""
SELECT 'f/' || p_partkey || '.py' AS path, 'SELECT ' || repeat('a', p_partkey % 10) || ' FROM t' AS sql, {i(1)} AS line FROM part WHERE p_partkey % 10 > 6""")
def short_sql(spark, d):
    """Texts around the length that counts as SQL."""
    body = F.concat(F.lit('q = "SELECT '), F.repeat(F.lit("a"), (F.col("p_partkey") % 10).cast("int")), F.lit(' FROM t"\n'))
    files = P.table(spark, d, "part").select(F.concat(F.lit("f/"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), body.alias("content"))
    return facts.embedded_sql(files).select("path", "sql", "line")


@query("dispatch_field_counts", """
SELECT 'ops_' || p_partkey AS struct, p_partkey % 4 AS n_fields, CAST(1 AS BIGINT) AS n_registrations FROM part WHERE p_partkey % 4 >= 2""")
def dispatch_field_counts(spark, d):
    """Structs with none to three pointer fields; one alone makes no dispatch table."""
    k = F.col("p_partkey").cast("string")
    fields = F.array_join(F.transform(F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (F.col("p_partkey") % 4).cast("int")), lambda f: F.concat(F.lit("  int (*"), f, F.lit("_"), k, F.lit(")(int);\n"))), "")
    body = F.concat(F.lit("struct ops_"), k, F.lit(" {\n  int n;\n"), fields, F.lit("};\nvoid set(struct ops_"), k, F.lit(" *p) {\n  p->a_"), k, F.lit(" = h_"), k, F.lit(";\n}\n"))
    files = P.table(spark, d, "part").select(F.concat(F.lit("f/"), k, F.lit(".c")).alias("path"), body.alias("content"))
    return C.dispatch_tables(stage_table(C.pointer_fields(files)), stage_table(C.registrations(files)))
