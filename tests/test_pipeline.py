"""Folder scan, all stages with a stub generator, and the file stream."""

import pytest

from factloom import fixed_values as V
from factloom.operators import callbacks as C, modules as MO, outputs as O
from factloom.plans import pipeline
from factloom.sources import artefacts as A, chat, files as S
from factloom.streaming import incremental

SOURCES = {
    "src/main.c": '#include "ops.h"\ntypedef struct ops {\n  int (*init)(int);\n  void (*handler)(void);\n} ops_t;\nint run(ops_t *o) {\n  o->handler = on_event;\n  o->handler();\n  return go(1);\n}\n',
    "src/app.py": 'def source_rows():\n    prepare()\n    sql = "INSERT OVERWRITE TABLE dw.t SELECT a FROM raw.t1"\n    return run_all(sql)\n\ndef top():\n    source_rows()\n',
    "src/Job.scala": 'object Job {\n  def run() = {\n    spark.udf.register("clean_name", f)\n    XMLLoader.load("conf/p.xml")\n  }\n}\n',
    "src/A.java": "class A extends B implements C {\n  void m() { x.send(\"topic\"); }\n}\n",
    "conf/p.xml": "<p><s>SELECT upper(a) FROM ext.t2 WHERE b</s></p>",
    "sql/a.sql": "-- c\nCREATE TABLE x AS SELECT 1;\nWITH y AS (SELECT 1) SELECT 1;",
    "tests/test_a.py": "import pytest\n",
    "node_modules/x.py": "def hidden(): pass\n",
    ".hidden/y.py": "def hidden(): pass\n",
    "bad.py": "def (",
    "a b+c%20.py": "X = 1\n",
    "Makefile": "all:\n",
    "README": "x\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("source")
    for name, text in SOURCES.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (folder / "bytes.py").write_bytes(b"A = '\xff\xfeok'\n")
    (folder / "big.py").write_bytes(b"#" * (V.MAX_FILE_BYTES + 1))
    (folder / "mark.py").write_bytes(b"\xef\xbb\xbfdef marked():\n    pass\n")
    return str(folder)


def test_scan_filters_guard_and_bytes(spark, root):
    rows = {r.path: r for r in S.source_files(spark, root, max_bytes=V.MAX_FILE_BYTES).collect()}
    assert S.source_files(spark, root).where("path = 'big.py' and error = '' and length(content) > 2000000").count() == 1
    assert rows["mark.py"].content.startswith("def marked")
    assert "node_modules/x.py" not in rows and ".hidden/y.py" not in rows and "Makefile" not in rows
    assert "a b+c%20.py" in rows and rows["big.py"].error == "file too large" and rows["big.py"].content == ""
    assert rows["bytes.py"].content == "A = 'ok'\n"
    assert rows["src/main.c"].language == "C" and rows["bad.py"].module == "<root>"
    fewer = {r.path for r in S.source_files(spark, root, skip_tests=True).collect()}
    assert "tests/test_a.py" in rows and "tests/test_a.py" not in fewer
    assert [r.path for r in S.source_files(spark, root, max_files=2).orderBy("path").collect()] == sorted(rows)[:2]


def make_client():
    # nested, so that it travels to the workers by value
    def client():
        calls = []

        def generate(system, user):
            calls.append(user)
            if user.startswith("flaky") and len(calls) == 1:
                raise TimeoutError("slow")
            if user.startswith("Correct the text"):
                return "It calls go(1) and source_rows()."
            return "## Flow\n```mermaid\nflowchart TD\nA[f(x)] --> B\n```\nIt calls nothing_real(1), other_thing(2)." + "." * 200

        return generate

    return client


client = make_client()


def make_broken():
    def client():
        def generate(system, user):
            raise RuntimeError("not to be called")

        return generate

    return client


broken = make_broken()


def test_all_stages(spark, root, tmp_path):
    out = str(tmp_path / "out")
    t = pipeline.run(spark, root, out, make_client=client, title="Demo")
    names = lambda df, c: {r[0] for r in df.select(c).collect()}
    assert {"run", "source_rows", "Job", "A", "SQL_CREATE_2", "SQL_s_1"} <= names(t["symbols"], "name")
    assert names(t["udfs"], "name") == {"clean_name"} and names(t["xml_loaders"], "xml_file") == {"conf/p.xml"}
    edges = {(r.caller, r.callee, r.edge_type) for r in t["calls"].collect()}
    assert ("o->handler", "on_event", "indirect") in edges and ("run", "go", "direct") in edges and ("p/s", "upper", "direct") in edges
    assert {(r.struct, r.n_fields) for r in t["dispatch_tables"].collect()} == {("ops", 2), ("ops_t", 2)}
    assert {"bad.py"} == names(t["errors"], "path") and "marked" in names(t["symbols"], "name")
    assert {(r["class"], r.relation, r.target) for r in t["java_dispatch"].collect()} == {("A", "extends", "B"), ("A", "implements", "C")}
    outputs = {(r.name, r.output_type) for r in t["outputs"].collect()}
    assert {("dw.t", "db_table"), ("topic", "message")} <= outputs
    inputs = {(r.relationship, r.source_name) for r in t["output_inputs"].collect()}
    assert {("upstream_caller", "top"), ("sql_input", "raw.t1"), ("data_read", "source_rows")} <= inputs
    assert t["totals"].first().build_systems == ["Make"]
    assert {r.fact: r.n for r in pipeline.summary(t).collect()}["errors"] == 1
    texts = {r.module: r.markdown for r in t["analyses"].collect()}
    assert "src" in texts and 'A["fx"]' in texts["src"] and "<details>" in texts["src"]
    document = "\n".join(r.value for r in spark.read.text(f"{out}/report").collect())
    assert "# Demo" in document and "## 4. Rebuild guide" in document and "make\n" in document
    assert spark.read.parquet(f"{out}/module_pages").count() == len(texts)
    stored = A.read_modules(spark, out, "path string, symbols array<struct<name:string>>, module string")
    assert stored.where("path = 'src/app.py' and module = 'src'").count() == 1
    again = pipeline.analyse_modules(f"{out}/again", t, client, cached=t["analyses"])
    assert {r.module: r.markdown for r in again.collect()} == texts
    # the stored texts are taken, and neither replaced nor lost
    for how in ({"cached": A.read_table(spark, out, "analyses")}, {"resume": True}):
        assert {r.module: r.markdown for r in pipeline.analyse_modules(out, t, broken, **how).collect()} == texts
    assert "## Flow" in document and t["cross_flows"].count() == 1 and t["synthesis"].first().text in document
    for name in ("report_html", "io_flows_html"):
        page = "\n".join(r.value for r in spark.read.text(f"{out}/{name}").collect())
        assert "<title>Demo</title>" in page and "</html>" in page
    # a second run takes every stored text, and its prompts are the same
    second = pipeline.run(spark, root, out, make_client=broken, title="Demo")
    assert {r.module: r.markdown for r in second["analyses"].collect()} == texts
    for name in ("cross_flows", "synthesis"):
        assert sorted(r.text for r in second[name].collect()) == sorted(r.text for r in t[name].collect())
    later = pipeline.run(spark, root, out, "4", make_client=broken, title="Again")
    assert {r.module for r in later["analyses"].collect()} == set(texts)
    document = "\n".join(r.value for r in spark.read.text(f"{out}/report").collect())
    assert "# Again" in document and t["synthesis"].first().text in document


def test_generate_validate_refine(spark, root, tmp_path):
    out = str(tmp_path / "out")
    t = pipeline.run(spark, root, out, "0-1")
    prompts = spark.createDataFrame([("flows", "s", "describe")], "module string, system string, user string")
    row = pipeline.generate_and_refine(prompts, t, client, out).first()
    assert row.accuracy == 1.0 and "go(1)" in row.text and "## Validation" in row.text


def test_generator_retries(spark):
    prompts = spark.createDataFrame([("m", "s", "flaky prompt")], "module string, system string, user string").coalesce(1)
    assert chat.generate(prompts, client, wait=0.01).first().error == ""

    def dead():
        def call(system, user):
            raise ConnectionError("down")
        return call

    assert chat.generate(prompts, dead, retries=2, wait=0.01).first().error.startswith("ConnectionError")


def test_phase_range():
    assert [pipeline.phase_range(x) for x in ("all", "0-1", "2")] == [(0, 4), (0, 1), (2, 2)]


def test_file_stream_reads_new_files_once(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()
    (folder / "a.py").write_text("def f():\n    g()\n")
    incremental.follow(spark, str(folder), out, checkpoint).awaitTermination()
    (folder / "b.py").write_text("def h(): pass\n")
    incremental.follow(spark, str(folder), out, checkpoint).awaitTermination()
    rows = spark.read.parquet(out)
    assert sorted(r.name for r in rows.where("fact = 'symbol'").collect()) == ["f", "h"]
    assert rows.select("batch").distinct().count() == 2


def test_markdown_folder(spark, tmp_path):
    (tmp_path / "a b+c.md").write_text("# x\ny")
    (tmp_path / "skip.txt").write_text("z")
    assert [tuple(r) for r in A.read_markdown(spark, str(tmp_path)).collect()] == [("a b+c", "# x\ny")]


def test_typedef_struct_counts_under_both_names(spark):
    df = spark.createDataFrame([("a.c", "typedef struct a {\n int (*f)(int);\n} b;")], "path string, content string")
    assert sorted((r.struct, r.line) for r in C.pointer_fields(df).collect()) == [("a", 2), ("b", 2)]


def test_every_output_pattern(spark):
    lines = [
        "INSERT INTO TABLE a.b", "CREATE TABLE c", "MERGE INTO d", 'x.write.csv("/e")', 'x.save("f")', 'x.saveAsTable("g")',
        'x.insertInto("h")', 'spark.sql("a INSERT INTO TABLE i")', 'x.option("dbtable", "j")', 'open("k.txt", "wb")', 'x.to_json("l")',
        'json.dump(x, open("m"', 'Path("n").write_text(1)', '@app.route("/o")', '@app.get("/p")', 'path("q"', '@GetMapping(value="/r")',
        'x.send("s")', 'x.publish("t")', 'x.emit("u")', "INSERT INTO v",
    ]
    df = spark.createDataFrame([("f.py", "\n".join(lines))], "path string, content string")
    got = {(r.name, r.output_type, r.line) for r in O.regex_outputs(df).collect()}
    assert got == {
        ("a.b", "db_table", 1), ("c", "db_table", 2), ("d", "db_table", 3), ("/e", "spark_file", 4), ("f", "spark_file", 5), ("g", "spark_table", 6),
        ("h", "spark_table", 7), ("i", "db_table", 8), ("i", "spark_table", 8), ("j", "db_table", 9), ("k.txt", "file", 10), ("l", "file", 11),
        ("m", "file", 12), ("n", "file", 13), ("n", "api_endpoint", 13), ("/o", "api_endpoint", 14), ("/p", "api_endpoint", 15), ("q", "api_endpoint", 16),
        ("/r", "api_endpoint", 17), ("s", "message", 18), ("t", "message", 19), ("u", "message", 20),
    }


def test_lenient_insert(spark):
    df = spark.createDataFrame([("f", "insert into t values (1)", 3)], "path string, sql string, line int")
    assert O.sql_outputs(df).count() == 0
    assert O.sql_outputs(df, lenient_insert=True).first().name == "t"


def test_long_file_preview(spark):
    body = "\n".join(f"line {i}" + "x" * 300 for i in range(1, 61))
    files = spark.createDataFrame([("m", "p", "Python", body, 1)], "module string, path string, language string, content string, file_seq long")
    symbols = spark.createDataFrame([("p", 0, "f", "function", 40), ("p", 1, "g", "function", 5)], "path string, seq int, name string, kind string, line int")
    text = MO.source_preview(files, symbols, "file_seq", max_tokens=10_000).first().text
    assert "30 more lines" in text and "--- function f (line 40) ---" in text and "line 45x" in text and "line 46x" not in text and "function g" not in text
