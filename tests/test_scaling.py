"""What keeps queries within memory and time on large tables: measured broadcasts, even tasks, narrow facts."""

import ast

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from factloom import session
from factloom.functions.languages import _CHILDREN, python_facts
from factloom.operators import extract as X, joins, line_html, outputs as O, truth
from factloom.plans import corpus as P, q_truth, reports as R
from factloom.session import FILES_PER_TASK, RUNTIME_CONF, spread, tune


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _orders(folder, n: int) -> str:
    keys = pa.array(range(n), pa.int64())
    rows = pa.table({"o_orderkey": keys, "o_orderstatus": pa.array(["O"] * n), "o_custkey": keys})
    pq.write_table(rows, f"{folder}/orders.parquet", row_group_size=n)
    return str(folder)


def test_rows_made_from_a_scan_are_not_broadcast_unmeasured(spark, tmp_path):
    tune(spark)
    spark.range(20_000).select(F.col("id").alias("p_partkey"), F.concat(F.lit("part "), F.col("id").cast("string")).alias("p_name")).write.parquet(f"{tmp_path}/part.parquet")
    pages = R.html_pages(P.part_reports(spark, str(tmp_path)), ["doc"], "markdown", F.lit("t"))
    assert "BroadcastHashJoin" not in _plan(pages)
    files = P.python_files(spark, _orders(tmp_path, 60_000))
    texts = files.select(F.concat(F.lit("x/"), "path").alias("module"), F.lit("# T\n## Interface\nrun").alias("markdown"))
    assert "BroadcastHashJoin" not in _plan(R.related_analyses(files.select("path"), texts))


def test_a_session_keeps_its_own_broadcasts_where_asked(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    tune(spark, own_broadcasts=True)
    own = spark.conf.get(key)
    tune(spark)
    assert spark.conf.get(key) == RUNTIME_CONF[key] != own


def test_one_row_group_is_dealt_to_all_tasks(spark, tmp_path):
    orders = spark.read.parquet(_orders(tmp_path, 40_000) + "/orders.parquet")
    sizes = [r["count"] for r in spread(orders, 1_000).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 40 and max(sizes) < 2_000
    files = P.python_files(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() >= max(spark.sparkContext.defaultParallelism, 40_000 // FILES_PER_TASK)


def test_a_task_takes_no_more_files_of_a_larger_table(spark, tmp_path):
    files = P.python_files(spark, _orders(tmp_path, 120_000))
    sizes = [r["count"] for r in files.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 120_000 and max(sizes) <= 10_100


def test_single_readers_take_edges_and_imports_from_the_parser(spark, tmp_path):
    d = _orders(tmp_path, 20)
    before = len(session._staged)
    edges = {(r.caller, r.callee) for r in q_truth.call_edges(spark, d).collect()}
    assert ("run_3", "load") in edges and ("<module>", "run_19") in edges and len(edges) == 20 * 8
    sources = q_truth.imports_index(spark, d)
    assert sources.columns == ["path", "source"] and sources.count() == 20 * 4
    assert len(session._staged) == before


def test_visitor_reads_child_fields_alone():
    assert _CHILDREN[ast.Call] == ("func", "args", "keywords") and _CHILDREN[ast.Attribute] == ("value",)
    code = """
@deco(a())
class K(base(), metaclass=meta()):
    x: kind() = value()
    async def f(self, p: t() = d(), *q: u(), k=v(), **r) -> w():
        async with ctx() as c, other():
            yield [e() for e in src() if cond()] + {k(): y() for z in zs()}
        try:
            raise err() from cause()
        except exc() as x:
            assert ok(), msg()
        match subject():
            case Point(x=0) if guard():
                del sub()[index():stop()]
                lam(lambda q=deft(): body())
        return f"{fmt()!r:{width()}}" if not neg() else (n := walrus()) < cmp() and ~inv() or await aw()
"""
    found = [f["name"] for f in python_facts(code) if f["fact"] == "call"]
    walked = [ast.get_source_segment(code, n.func) for n in ast.walk(ast.parse(code)) if isinstance(n, ast.Call)]
    assert sorted(found) == sorted(walked) and len(found) > 30


CODE = "import os\nLIMIT = 1\ndef run(a, b: int = 2):\n    'text'\n    go(a)\n    open('x')\n"


def test_wanted_kinds_of_facts_leave_the_worker_alone(spark):
    files = spark.createDataFrame([("a.py", "Python", CODE), ("b.py", "Python", "def ("), (None, "Python", "f()")], "path string, language string, content string")
    every = X.extract(files)
    for kind, of in (("call", X.direct_calls), ("import", X.imports), ("symbol", X.symbols), ("error", X.errors)):
        some = X.extract(files, only=[kind])
        assert {r.fact for r in some.select("fact").collect()} == {kind}
        assert sorted(map(str, of(some).collect())) == sorted(map(str, of(every).collect()))
    narrow = X.extract(files, only=["symbol", "call"], columns=["path", "fact", "seq", "name", "line", "caller"])
    assert narrow.columns == ["path", "fact", "seq", "name", "line", "caller"]
    assert X.symbols(narrow).columns == ["path", "seq", "name", "line"]


def test_container_of_an_output_takes_one_window_per_file(spark):
    outputs = spark.createDataFrame([("o", "file", "a.py", 9_000), ("p", "file", "a.py", 1), ("q", "file", "b.py", 5)], "name string, output_type string, path string, line int")
    calls = spark.createDataFrame([("a.py", 2, 0, "early"), ("a.py", 8_999, 1, "late"), ("a.py", 9_001, 2, "after"), ("b.py", 5, 0, "same")], "path string, line int, edge_seq int, caller string")
    found = O.containing_function(outputs, calls)
    assert {(r.name, r.container) for r in found.collect()} == {("o", "late"), ("q", "same")}
    assert _plan(found).count("Join") == 0


def test_word_sets_meet_without_shuffling_their_words(spark):
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    sets = [[w for k, w in enumerate(words) if mask >> k & 1] for mask in range(1, 64)]
    cands = spark.createDataFrame([("_".join(s),) for s in sets] + [("_".join(reversed(s)),) for s in sets], "name string")
    names = spark.createDataFrame([("_".join(s) + "_",) for s in sets], "name string")
    found = joins.similar_words(names, cands.withColumnRenamed("name", "candidate"), 0.7)
    want = set()
    for s in sets:
        alike = [c for t in sets if len({*s} & {*t}) >= 0.7 * len({*s} | {*t}) for c in ("_".join(t), "_".join(reversed(t)))]
        want.add(("_".join(s) + "_", min(alike)))
    assert {tuple(r) for r in found.collect()} == want
    assert "Window" not in _plan(found)


def test_truth_index_takes_the_first_of_each_name_from_the_worker(spark, tmp_path):
    source = "def run():\n    load()\n    load()\nLIMIT = 1\n"
    files = spark.createDataFrame([(f"f{i:03d}.py", "Python", source) for i in range(40)], "path string, language string, content string").repartition(2)
    whole = X.extract(files, only=["symbol", "call"])
    facts = X.extract(files, only=["symbol", "call"], columns=["fact", "path", "seq", "name", "kind", "line"], first_names=True)
    # a row of each kind and name for a task, where 40 files have 160 facts
    assert whole.count() == 160 and facts.count() <= 6
    udfs = spark.createDataFrame([("z.scala", "run", 6), ("z.scala", "twice", 9), ("b.scala", "twice", 12), (None, None, 1)], "path string, name string, line int")

    def index(found):
        calls = X.direct_calls(found).withColumnRenamed("seq", "edge_seq")
        plan = truth.truth_index(calls, X.symbols(found), udfs)
        assert _plan(plan).count("Exchange hashpartitioning") == 1
        return sorted(map(tuple, plan.collect()))

    assert index(facts) == index(whole) == [
        ("LIMIT", 1, "f000.py", 4, "variable"), ("load", 0, "f000.py", 2, "call"), ("run", 1, "f000.py", 1, "function"), ("twice", 2, "b.scala", 12, "udf")]


def test_html_lines_are_walked_once(spark):
    lines = spark.createDataFrame([("", i, t) for i, t in enumerate(["# T", "", "## A", "text", "<details>", "- x"])], "doc string, at bigint, line string")
    body, heads = line_html.html_lines(lines, "doc", "at", "line")
    assert "MapInArrow" not in _plan(body.join(heads, "at"))
    assert [r.title for r in heads.collect()] == ["A"]


def test_python_facts_leave_out_what_no_reader_takes():
    code = '''import os, a.b as c
from .x import y
LIMIT = max(1,
  2)
_t: int = f(
  "é")
@deco(one())
class K(Base, meta=m()):
    """Doc."""
    async def run(self, p: t() = d(), /, *q: u(), k=v(), **r: w()) -> z(1):
        "Text."
        return (lambda a=b(): a.c(d)(e[g()]))(
            h.i().j(x for x in l() if n()))
def plain(): pass
'''
    for source in (code, code.replace("é", "e"), code.replace("_t", "_ä"), code.replace("deco", "ｄeco")):
        whole = python_facts(source)
        for wanted in (["symbol", "call", "name", "line", "caller", "signature", "parent"], ["call", "name", "caller"], ["import", "name", "line", "module"], ["symbol", "name", "kind"]):
            kept = [{k: v for k, v in f.items() if k in wanted} for f in whole if f["fact"] in wanted]
            assert [{k: v for k, v in f.items() if k in wanted} for f in python_facts(source, frozenset(wanted)) if f["fact"] in wanted] == kept
        less = python_facts(source, frozenset(["symbol", "name"]))
        assert {f["fact"] for f in less} == {"symbol"} and not any("params" in f for f in less)
        # calls as they are written, a name in other letters too
        calls = [f["name"] for f in whole if f["fact"] == "call"]
        assert calls[:3] == ["max", "f", "deco" if "deco" in source else "ｄeco"] and len(calls) == 20
    # a line end that only the parser counts: the text of line 2 is not there
    for wanted in (None, frozenset(["symbol", "name"])):
        try:
            python_facts("a = 1\rdef f(): pass", wanted)
            raise AssertionError("no error")
        except IndexError:
            pass


def test_substrings_that_are_like_no_name_stay_out_of_the_join(spark):
    names = ["src_a_one_c", "src_b_two_c", "é", "ab", "x", "lib_three_h", ""]
    hays = [f"m_{n}_doc" for n in names] + ["src_a_one_c", "ab", "", "src_a_one_h", "nothing like it", "éé ab x", None, "ab"]
    n = spark.createDataFrame([(v,) for v in [*names, None, "ab"]], "n string")
    t = spark.createDataFrame([(v,) for v in hays], "t string")
    for fold in (True, False):
        whole = sorted(map(tuple, joins.contains_join(t, "t", n, "n", fold).collect()))
        assert sorted(map(tuple, joins.contains_join(t, "t", n, "n", fold, sieve=True).collect())) == whole
        assert sorted(set(whole)) == sorted({(h, v) for h in hays for v in names if h and v and v in h})
    paths = spark.range(300).select(F.concat(F.lit("py_o_order_"), F.col("id").cast("string"), F.lit("_py")).alias("n"))
    texts = paths.select(F.concat(F.lit("x_"), "n", F.lit("_doc")).alias("_text"))
    # a text has more than 20 substrings of those lengths
    assert joins._sieved_pieces(texts, paths.select(F.col("n").alias("_key")), lambda c: c).count() == 300
