"""HTML by lines: the finite-state pass against a plain loop, and whole pages."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import line_html as L, markdown as M
from factloom.operators.ordered import line_rank
from factloom.operators.transducer import walk
from factloom.plans import reports as R

TEXT = """# Title
para *one* `x`
two
| a | b |
|---|---|
| 1 | **2** |
- item
1. first
```py
# no <heading>
| no | table |
```
```mermaid
A --> B
```
<details>
<summary>S</summary>

---
## Sub `q`
<details>
</details>
- last"""

HTML = """<h1 id="title">Title</h1>
<p>
para <em>one</em> <code>x</code>
two
</p>
<table>
<tr><th>a</th><th>b</th></tr>
<tr><td>1</td><td><strong>2</strong></td></tr>
</table>
<ul>
<li>item</li>
</ul>
<ol>
<li>first</li>
</ol>
<pre><code class="language-py">
# no &lt;heading&gt;
| no | table |
</code></pre>
<div class="mermaid">
A --&gt; B
</div>
<details>
<summary>S</summary>
<hr>
<h2 id="sub-q">Sub <code>q</code></h2>
<details>
</details>
<ul>
<li>last</li>
</ul>
</details>"""


@pytest.mark.parametrize(("block", "fan"), [(8192, 4096), (3, 2), (1, 3)])
def test_walk(spark, block, fan):
    rnd = random.Random(block)
    rows = [(d, i, rnd.randrange(11)) for d in ("", "x", "y") for i in range({"": 61, "x": 1, "y": 30}[d])]
    want, last = [], {}
    for d, i, c in rows:
        state = last.get(d, 0)
        want.append((d, i, c, state))
        last[d] = L.STEPS[c][state]
    rnd.shuffle(rows)
    found, exits = walk(spark.createDataFrame(rows, "doc string, at bigint, cls int"), "doc", "at", "cls", L.STEPS, "state", block=block, fan=fan)
    assert sorted(map(tuple, found.collect())) == want
    assert {r.key: r.exit for r in exits.collect()} == last


@pytest.mark.parametrize("block", [8192, 4])
def test_html_lines(spark, block):
    docs = {"a": (TEXT, HTML), "b": ("```\n<x>", "<pre><code>\n&lt;x&gt;\n</code></pre>"), "c": ("</details>\n<details>", "</details>\n<details>\n</details>"), "d": ("", "")}
    rows = [(d, i, line) for d, (text, _) in docs.items() for i, line in enumerate(text.split("\n"))]
    found, heads = L.html_lines(spark.createDataFrame(rows, "d string, n int, l string"), "d", "n", "l", block)
    lines = {}
    for r in sorted(found.collect(), key=lambda r: (r.doc, r["at"], r.part)):
        lines.setdefault(r.doc, []).append(r.html)
    assert {d: "\n".join(lines.get(d, [])) for d in docs} == {d: html for d, (_, html) in docs.items()}
    assert [tuple(r) for r in heads.collect()] == [("a", 19, 2, "Sub `q`", "sub-q")]


def test_page(spark, tmp_path):
    rows = [(0, 0, 0, "0000", "# T"), (1, 0, 0, "0", "## A & B\n\ntext"), (2, 0, 0, "0", "- x")]
    lines = spark.createDataFrame(rows, "section int, n bigint, sub int, pos string, line string")
    page = R.html_document(lines, "A < B")
    R.write_document(page, str(tmp_path / "page"))
    text = "\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / "page").glob("part-*")) if p.stat().st_size)
    assert text.startswith("<!DOCTYPE html>\n<html>\n<head>\n<meta charset=\"utf-8\">\n<title>A &lt; B</title>\n<style>")
    assert text.endswith(
        '<nav>\n<a href="#a-b" style="padding-left:16px">A &amp; B</a>\n</nav>\n<main>\n<h1 id="t">T</h1>\n<h2 id="a-b">A & B</h2>\n'
        "<p>\ntext\n</p>\n<ul>\n<li>x</li>\n</ul>\n</main>\n</body>\n</html>")


def test_no_lines(spark):
    empty = spark.createDataFrame([], "section int, n bigint, sub int, pos string, line string")
    assert R.html_document(empty, "T").count() == 10


def test_strip_and_cells_follow_the_patterns(spark):
    signs = [chr(i) for i in range(1, 0x3100) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame([(c + "a" + c + "b" + c,) for c in signs], "t string")
    plain = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    assert rows.where(M.strip(F.col("t")) != plain).count() == 0
    cells = ["| *a | b* | `c | d` |", "| **x** |  | [l](u) | [m | n](v) |", "|| a & <b> ||", "| `p` | *q* * |"]
    df = spark.createDataFrame([("", i, t) for i, t in enumerate(cells)], "doc string, at bigint, line string")
    escaped = T.escape_html(F.regexp_replace("line", r"^\|+|\|+$", ""))
    each = F.transform(F.split(escaped, r"\|"), lambda c: M.inline_html(M.strip(c)))
    want = [r.c for r in df.select(each.alias("c")).collect()]
    found = [r.html for r in L.html_lines(df, "doc", "at", "line")[0].orderBy("at", "part").collect() if r.html.startswith("<tr>")]
    tags = ["th", "td", "td", "td"]
    assert found == ["<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in row) + "</tr>" for tag, row in zip(tags, want)]


def test_texts_are_sorted_whole_and_html_has_no_filter_over_arrays(spark):
    rows = [(n, "\n".join(f"{n}.{k}" for k in range(n % 4 + 1))) for n in range(500)]
    lines = spark.createDataFrame(random.Random(1).sample(rows, 500), "n int, line string").repartition(7)
    ranked = sorted((r["at"], r.line) for r in line_rank(lines, ["n"], "line", "at").collect())
    assert ranked == list(enumerate(line for _, text in rows for line in text.split("\n")))
    body = L._with_html(spark.createDataFrame([("", 0, "| a |", L.ROW, L.NONE)], "doc string, at bigint, line string, cls int, state int"))
    assert "lambda" not in body._jdf.queryExecution().executedPlan().toString()
