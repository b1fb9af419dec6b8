"""Table functions in SQL."""

import pytest

from factloom.functions.table_functions import register


@pytest.fixture(scope="module")
def sql(spark):
    register(spark)
    spark.createDataFrame([(1, "a1 b\na22", "x"), (2, None, "y"), (3, "", "z")], "k int, body string, tag string").createOrReplaceTempView("fn_texts")
    spark.createDataFrame([("a/b.py", "Python", "import os\ndef f():\n    g()\n"), ("c.zz", "None", "x"), ("d.py", "Python", None), ("e.py", "Python", "def (")], "path string, language string, content string").createOrReplaceTempView("fn_files")
    return spark.sql


def test_match_all(sql):
    df = sql("SELECT * FROM match_all(TABLE(fn_texts), 'body', array('a(\\\\d+)', 'b'))")
    assert df.columns == ["k", "tag", "pattern_seq", "match_seq", "start", "line", "match_text", "groups"]
    assert sorted(map(tuple, df.collect())) == [(1, "x", 0, 0, 0, 1, "a1", ["1"]), (1, "x", 0, 1, 5, 2, "a22", ["22"]), (1, "x", 1, 0, 3, 1, "b", [])]


def test_text_lines(sql):
    df = sql("SELECT tag, line_no, line_text FROM text_lines(TABLE(SELECT tag, body FROM fn_texts), 'body')")
    assert sorted(map(tuple, df.collect())) == [("x", 1, "a1 b"), ("x", 2, "a22"), ("z", 1, "")]


def test_code_facts(sql):
    rows = {(r.path, r.fact, r.name) for r in sql("SELECT * FROM code_facts(TABLE(fn_files))").collect()}
    assert ("a/b.py", "symbol", "f") in rows and any(f == "call" for _, f, _ in rows) and any(p == "e.py" and f == "error" for p, f, _ in rows)
    assert not {p for p, _, _ in rows} & {"c.zz", "d.py"}


@pytest.mark.parametrize(("query", "message"), [
    ("SELECT * FROM match_all(TABLE(fn_texts), 'none', array('a'))", "name of one"), ("SELECT * FROM match_all(TABLE(fn_texts), 'body', 'a')", "array of patterns"),
    ("SELECT * FROM text_lines(TABLE(SELECT k AS line_no, body FROM fn_texts), 'body')", "rename it"), ("SELECT * FROM match_all(TABLE(fn_texts), 'body', array('('))", "unterminated"),
])
def test_told_before_the_query_runs(sql, query, message):
    with pytest.raises(Exception, match=message):
        sql(query)
