"""Match-all against Python's own finditer, and first-wins."""

import random
import re

import pytest
from pyspark.sql import functions as F

from factloom import fixed_values as V
from factloom.functions import text as T
from factloom.operators.match import first_wins, match_all

PIECES = ["FROM x", "from été", "\n", " ", "é", "a_b", "JOIN `t.u`", "SELECT a FROM b", '"', "'", "(", "f(", "x->y = z;", "INTO", "\t", ";", "日本"]


def texts(n=200):
    rng = random.Random(7)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("pattern", [V.TABLE_QUALIFIED, V.EMBEDDED_SQL, V.C_ASSIGNMENT, V.SQL_CALL, V.TABLE_MENTION])
def test_match_all_and_native_forms_agree_with_python(spark, pattern):
    data = list(enumerate(texts()))
    df = spark.createDataFrame(data, "id long, body string")
    got = {
        (r.id, r.match_seq): (r.start, r.line, r.text, r.groups)
        for r in match_all(df, "body", [pattern], ["id"]).collect()
    }
    want = {
        (k, n): (m.start(), body.count("\n", 0, m.start()) + 1, m.group(), [g or "" for g in m.groups()])
        for k, body in data for n, m in enumerate(re.finditer(pattern, body))
    }
    assert got == want and want
    native = df.select(
        "id", T.find_all(F.col("body"), pattern).alias("g"), T.match_lines(F.col("body"), pattern).alias("l")
    ).collect()
    assert {(r.id, i): (r.g[i], r.l[i]) for r in native for i in range(len(r.l))} == {k: (v[3][0], v[1]) for k, v in want.items()}


def test_context_is_one_line(spark):
    df = spark.createDataFrame([("a\nbb hit cc\ndd",)], "body string")
    row = match_all(df, "body", ["hit"], [], before=4, after=5).first()
    assert row.context == "bb hit cc d" and row.line == 2


def test_first_wins_keeps_columns(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("j", 3, "c")], "key string, seq int, v string")
    assert sorted(map(tuple, first_wins(df, ["key"], ["seq"]).collect())) == [("j", 3, "c"), ("k", 1, "a")]


def test_line_count(spark):
    df = spark.createDataFrame([("",), ("a",), ("a\n",), ("a\nb",), ("\n\n",)], "s string")
    assert [r[0] for r in df.select(T.line_count(F.col("s"))).collect()] == [0, 1, 1, 2, 2]


def test_extension_and_modules(spark):
    df = spark.createDataFrame([("a/b.C",), (".bashrc",), ("x.tar.gz",), ("a.b/c",), ("..x.y",)], "p string")
    assert [r[0] for r in df.select(T.extension(F.col("p"))).collect()] == [".c", "", ".gz", "", ".y"]
    assert [r[0] for r in df.select(T.module_of(F.col("p"))).collect()] == ["a", "<root>", "<root>", "a.b", "<root>"]


def test_identifier_tokens_follow_python(spark):
    names = ["web_httpHandleCall2", "HTTPServer", "getX", "a.b_C", "XMLParser_ID", "x1y2", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    want = [
        [t.lower() for part in re.split(r"[_.]", n) for t in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)", part)] for n in names
    ]
    assert [r[0] for r in df.select(T.identifier_tokens(F.col("n"))).collect()] == want


def test_anchor(spark):
    df = spark.createDataFrame([("1. `Foo` Bar.baz!",), ("模块 职责：x",), ("--a  b--",)], "h string")
    assert [r[0] for r in df.select(T.anchor(F.col("h"))).collect()] == ["1-foo-bar-baz", "模块-职责：x", "a-b"]
