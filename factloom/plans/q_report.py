"""Queries on Markdown, module texts and report documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from factloom.operators import callbacks as C, extract as X, facts, markdown as M, modules, outputs as O, stats
from factloom.plans import corpus as P, reports as R
from factloom.plans.q_code import CB, JB, PB, SB, XB, _PY_OUTPUTS, callback_facts, i, python_graph, rows
from factloom.plans.q_text import _paths
from factloom.plans.registry import ORACLES, query
from factloom.session import stage_table

NL = " || chr(10) || "


def sql_text(template: str, **values: str) -> str:
    """SQL expression for a corpus template."""
    out, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if head:
            out.append("'" + head.replace("'", "''") + "'")
        out.append({"(": "'{'", ")": "'}'"}.get(name, values.get(name)))
    out.append("'" + rest.replace("'", "''") + "'")
    return "(" + " || ".join(out) + ")"


_DOC = {"k": "doc_id", "text": "text", "e": "' '"}
_PART = {"k": "p_partkey", "text": "p_name", "e": "' '", "name": "p_name"}

_NORMAL = P.REPORT.replace("# Doc", "### Doc").replace("##{e}\n", "").replace("## Dropped parent\n", "").replace(
    "### Core", "##### Core").replace("### Notes", "##### Notes").replace("## Empty end", "#### Empty end")


@query("normalized_headings", f"SELECT doc_id AS doc, {sql_text(_NORMAL, **_DOC)} AS markdown FROM documents")
def normalized_headings(spark, d):
    return M.normalize_headings(P.reports(spark, d), ["doc"], "markdown", 3, "markdown")


@query("toc_entries", """
WITH b AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)
SELECT doc_id AS doc, CAST(unnest([3, 4, 11 + n, 22 + n]) AS INTEGER) AS pos, CAST(unnest([2, 3, 3, 2]) AS INTEGER) AS level,
  unnest(['Dropped parent', 'Core Flow', 'Notes ' || doc_id, 'Empty end']) AS title,
  unnest(['dropped-parent', 'core-flow', 'notes-' || doc_id, 'empty-end']) AS anchor,
  unnest(['- [Dropped parent](#dropped-parent)', '  - [Core Flow](#core-flow)', '  - [Notes ' || doc_id || '](#notes-' || doc_id || ')', '- [Empty end](#empty-end)']) AS entry
FROM b""")
def toc_entries(spark, d):
    return M.toc(P.reports(spark, d), ["doc"], "markdown")


_PIECES = P.REPORT.split("## Dropped")[1]
_S4 = "### Core Flow" + _PIECES.split("### Core Flow")[1].split("\n# no heading")[0]
_S6 = "### Notes" + _PIECES.split("### Notes")[1].split("\n## Empty")[0]
_SECTION_LIST = "[" + ", ".join(sql_text(t, **_DOC) for t in (
    "# Doc {k}\n", "##{e}", "## Dropped parent", _S4, "# no heading\n```", _S6, "## Empty end\n")) + "]"
_SECTIONS = f"""
WITH b AS (SELECT doc_id AS doc, {_SECTION_LIST} AS l FROM documents),
s AS (SELECT doc, unnest(range(1, 8)) AS section, unnest(l) AS content FROM b)
"""


@query("sections", _SECTIONS + """
SELECT doc, section, trim(string_split(content, chr(10))[1]) AS header, content, section = 4 AS is_priority FROM s""")
def sections(spark, d):
    return M.sections(P.reports(spark, d), ["doc"], "markdown")


@query("key_sections", _SECTIONS + """
, r AS (SELECT *, row_number() OVER w AS rank, 2000 - coalesce(sum(length(content)) OVER (PARTITION BY doc ORDER BY section <> 4, section
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM s WINDOW w AS (PARTITION BY doc ORDER BY section <> 4, section)),
f AS (SELECT *, length(content) <= rest AS fits FROM r),
g AS (SELECT *, coalesce(bool_and(fits) OVER (PARTITION BY doc ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS ok FROM f)
SELECT doc, string_agg(CASE WHEN fits THEN content ELSE left(content, CAST(rest AS BIGINT)) || '...' END, chr(10) ORDER BY rank) AS summary
FROM g WHERE ok AND (fits OR rest > 200) GROUP BY doc""")
def key_sections(spark, d):
    return M.key_sections(P.reports(spark, d), ["doc"], "markdown")


@query("diagram_blocks", "SELECT doc, CAST(block AS INTEGER) AS block, body FROM (SELECT p_partkey AS doc, unnest([0, 1]) AS block, unnest(["
       + ", ".join(sql_text(b.split("```")[0].strip(), k="p_partkey") for b in P.DIAGRAM.split("```mermaid\n")[1:]) + "]) AS body FROM part)")
def diagram_blocks(spark, d):
    return M.diagram_blocks(P.diagrams(spark, d), ["doc"], "markdown")


_FIXED = (
    P.DIAGRAM.replace("```mermaid\n", "```mermaid\n\n").replace("    end\n```\nThen", "    end\n\n    end\n```\nThen")
    .replace('A->>B: set x = "v{k}"', "A->> B: set x =v{k}").replace("a;b;c", "a#59;b#59;c")
    .replace('subgraph "Part {k}"', 'subgraph sg0 ["Part {k}"]').replace('{(}size = "big"{)}', '{(}"size is big"{)}')
    .replace("|calls f(x)|", "|calls fx|").replace("Q[load(x)]", 'Q["loadx"]').replace("---ox\n    end\n```", "--- ox\n    end\n\n```")
)


@query("fixed_diagrams", f"SELECT p_partkey AS doc, {sql_text(_FIXED, k='p_partkey')} AS markdown FROM part")
def fixed_diagrams(spark, d):
    return M.fix_diagrams(P.diagrams(spark, d), ["doc"], "markdown", "markdown")


_WRAPPED = (
    _FIXED.replace("```mermaid\n\nseq", "<details>\n<summary>Sequence Diagram (3 messages)</summary>\n\n```mermaid\n\nseq")
    .replace("    end\n```\nThen", "    end\n```\n\n</details>\nThen")
    .replace("```mermaid\n\nflow", "<details>\n<summary>Flowchart (1 edges)</summary>\n\n```mermaid\n\nflow")
    .replace("    end\n\n```\n", "    end\n\n```\n\n</details>\n")
)


@query("wrapped_diagrams", f"SELECT p_partkey AS doc, {sql_text(_WRAPPED, k='p_partkey')} AS markdown FROM part")
def wrapped_diagrams(spark, d):
    fixed = M.fix_diagrams(P.diagrams(spark, d), ["doc"], "markdown", "markdown")
    return M.wrap_diagrams(fixed, ["doc"], "markdown", "markdown")


_HTML = """<h1 id="doc-{k}">Doc {k}</h1>
<h2 id=""></h2>
<h2 id="dropped-parent">Dropped parent</h2>
<h3 id="core-flow">Core Flow</h3>
<p>{text}</p>
<pre><code class="language-mermaid">
flowchart TD
    A{k}[call(x)] --&gt; B[&quot;a = b&quot;]
    B --&gt; C[&quot;end&quot;]
# no heading
</code></pre>
<h3 id="notes-{k}">Notes {k}</h3>
<ul>
<li>one <strong>b{k}</strong></li>
<li>two</li>
</ul>
<ol>
<li><code>x</code> < 2</li>
</ol>
<table>
<tr><th>a</th><th>b</th></tr>
<tr><td>{k}</td><td>&lt;i&gt;</td></tr>
</table>
<hr>
<h2 id="empty-end">Empty end</h2>"""


@query("report_html", f"SELECT p_partkey AS doc, {sql_text(_HTML, **_PART)} AS html FROM part")
def report_html(spark, d):
    return M.to_html(P.part_reports(spark, d), ["doc"], "markdown", "html")


_MERMAID = _HTML[_HTML.index("<pre>"):_HTML.index("</pre>") + 6]
_PAGE_BODY = _HTML.replace("<p>{text}</p>\n" + _MERMAID, (
    '<p>{text} <div class="mermaid">flowchart TD\n    A{k}[call(x)] --&gt; B[&quot;a = b&quot;]\n    B --&gt; C[&quot;end&quot;]\n# no heading</div></p>'))
_PAGE = (
    '<!DOCTYPE html>\n<html>\n<head>\n<meta charset="utf-8">\n<title>Part {k} &amp; co</title>\n<style>@STYLE@</style>\n</head>\n<body>\n<nav>\n'
    '<a href="#dropped-parent" style="padding-left:16px">Dropped parent</a>\n<a href="#core-flow" style="padding-left:32px">Core Flow</a>\n'
    '<a href="#notes-{k}" style="padding-left:32px">Notes {k}</a>\n<a href="#empty-end" style="padding-left:16px">Empty end</a>\n</nav>\n<main>\n'
    + _PAGE_BODY + "\n</main>\n</body>\n</html>"
)


@query("html_pages", f"SELECT p_partkey AS doc, replace({sql_text(_PAGE, **_PART)}, '@STYLE@', '{R._STYLE}') AS html FROM part")
def html_pages(spark, d):
    title = F.concat(F.lit("Part "), F.col("doc").cast("string"), F.lit(" & co"))
    return R.html_pages(P.part_reports(spark, d), ["doc"], "markdown", title)


# modules ----------------------------------------------------------------------

@query("symbol_index", rows(
    JB,
    *(f"'java/' || g AS module, path, {i(n)} AS seq, {t} AS text" for n, t in (
        (-1, "'### ' || path || ' (Java)'"),
        (0, "'  class Customer' || k || ' sig: class Customer' || k || ' extends Base' || n || ' implements Audit' || n || ', Scored'"),
        (1, "'  variable Customer' || k || '.score'"),
        (2, "'  public method Customer' || k || '.rate → int (base: int, label: String, w)'"),
        (3, "'  protected method Customer' || k || '.audit → void sig: protected abstract void audit()'"),
    ))))
def symbol_index(spark, d):
    files = P.java_files(spark, d)
    return modules.symbol_index(X.symbols(X.extract(files, only=["symbol"])), files)


_JAVA_SQL = sql_text(P.JAVA_FILE, k="c_custkey", n="c_nationkey")


@query("source_preview", f"""
WITH b AS (SELECT c_custkey AS file_seq, 'java/' || lower(c_mktsegment) AS module, 'java/' || lower(c_mktsegment) || '/Customer' || c_custkey || '.java' AS path,
  {_JAVA_SQL} AS content FROM customer),
t AS (SELECT *, chr(10) || repeat('=', 60) || chr(10) || '### ' || path || ' (Java, ' || length(content) || ' chars)' || chr(10) || repeat('=', 60) || chr(10) || content AS block FROM b),
r AS (SELECT *, 16000 - coalesce(sum(length(block)) OVER (PARTITION BY module ORDER BY file_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM t)
SELECT module, path, file_seq, CASE WHEN length(block) <= rest THEN block ELSE left(block, CAST(rest AS BIGINT)) END AS text
FROM r WHERE length(block) <= rest OR rest > 500""")
def source_preview(spark, d):
    files = P.java_files(spark, d)
    return modules.source_preview(files, X.symbols(X.extract(files, only=["symbol"])), "file_seq")


@query("modules_to_analyse", """
SELECT DISTINCT 'java/' || lower(c_mktsegment) AS module FROM customer WHERE length('java/' || lower(c_mktsegment)) * 15 <= 200""")
def modules_to_analyse(spark, d):
    files = P.java_files(spark, d)
    mods = files.select("module").distinct()
    cached = mods.select("module", F.repeat(F.lit("x"), F.length("module") * 15).alias("markdown"))
    return modules.to_analyse(mods, files, X.symbols(X.extract(files, only=["symbol"])), cached)


@query("module_outputs", f"""
SELECT 'py/' || regexp_extract(path, 'py/(.)/', 1) AS module, path, line, name,
  '  - 🟢 `' || name || '` (' || output_type || ') @ ' || path || ':' || line || ' — ' || evidence AS text FROM ({_PY_OUTPUTS})""")
def module_outputs(spark, d):
    files = P.python_files(spark, d)
    return modules.module_outputs(files, O.regex_outputs(files))


_HEADERS = ["include", "src", "API", "headers"]


def _library(spark, d):
    part = P.table(spark, d, "part").select("p_partkey", "p_size")
    k = F.col("p_partkey").cast("string")
    folder = F.element_at(F.array(*[F.lit(x) for x in _HEADERS]), (F.col("p_partkey") % 4 + 1).cast("int"))
    ext = F.when(F.col("p_size") % 2 == 0, ".h").otherwise(".c")
    headers = part.select(F.concat(F.lit("core/"), folder, F.lit("/p_"), k, ext).alias("path"), F.lit("").alias("content"))
    build = part.agg(F.count("*").alias("n")).select(
        F.lit("CMakeLists.txt").alias("path"), F.concat(F.lit("add_library(core "), F.col("n").cast("string"), F.lit(")")).alias("content")
    )
    return headers.unionByName(build)


_LIBRARY = f"""
SELECT 'p_' || p_partkey AS name, 'public_header' AS output_type, 'core/' || {_HEADERS}[p_partkey % 4 + 1] || '/p_' || p_partkey || '.h' AS path,
  {i(1)} AS line, 'high' AS confidence, 'library_api' AS detection_layer, 'Public header in ' || lower({_HEADERS}[p_partkey % 4 + 1]) || '/' AS evidence,
  'Library API surface: core/' || {_HEADERS}[p_partkey % 4 + 1] || '/p_' || p_partkey || '.h' AS context
FROM part WHERE p_size % 2 = 0 AND p_partkey % 4 <> 1
UNION ALL SELECT 'CMakeLists.txt', 'library_build', 'CMakeLists.txt', {i(1)}, 'medium', 'build_file', 'Library target in CMakeLists.txt',
  'add_library(core ' || count(*) || ')' FROM part"""


@query("library_outputs", _LIBRARY)
def library_outputs(spark, d):
    return O.library_outputs(_library(spark, d))


@query("library_fallback", _LIBRARY)
def library_fallback(spark, d):
    none = O.regex_outputs(P.java_files(spark, d))  # Java corpus: no output point
    return O.with_library_fallback(none, O.library_outputs(_library(spark, d)))


@query("related_analyses", rows(
    PB, *(f"path, 'x/' || path || '/doc' AS module, {i(n)} AS rank, {t} AS line" for n, t in (
        (1, "'## Public Interface'"), (2, "'run_' || k"), (3, "'## Core Algorithm'"), (4, "''")))))
def related_analyses(spark, d):
    files = P.python_files(spark, d)
    name = F.regexp_extract("path", r"_(\d+)", 1)
    texts = files.select(
        F.concat(F.lit("x/"), "path", F.lit("/doc")).alias("module"),
        F.concat(F.lit("# T\nskip\n## Public Interface\nrun_"), name, F.lit("\n## Other\nskip\n## Core Algorithm\n")).alias("markdown"),
    )
    return R.related_analyses(files.select("path"), texts)


# documents ----------------------------------------------------------------------

@query("callback_info", f"""
WITH f AS (SELECT DISTINCT 'src/' || t AS module, 'ops_' || s AS struct, unnest(['on_' || t, 'handler']) AS field FROM {CB}),
g AS (SELECT 'on_' || t AS field, 'handle_' || b AS func FROM {CB} UNION SELECT 'handler', 'cb_' || b FROM {CB}),
any_f AS (SELECT DISTINCT struct, field FROM f),
r AS (SELECT 'src/' || t AS module, path, 12 AS line, 'p.on_' || t || ' = handle_' || b AS text FROM {CB}
      UNION ALL SELECT 'src/' || t, path, 13, 'p.handler = cb_' || b FROM {CB}),
rn AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY path, line) AS k FROM r),
cn AS (SELECT 'src/' || t AS module, row_number() OVER (PARTITION BY t ORDER BY path) AS k FROM {CB})
SELECT module, {i(0)} AS sub, struct || ' 0 ' || field AS pos, '  ' || struct || ': ' || field AS line FROM f
UNION ALL SELECT m.module, 0, a.struct || ' 1 ' || a.field || ' ' || func, '    ' || a.field || ' = ' || func
  FROM (SELECT DISTINCT module, struct FROM f) m JOIN any_f a USING (struct) JOIN g USING (field)
UNION ALL SELECT module, 1, printf('%09d', k), '  ' || text FROM rn
UNION ALL SELECT module, 2, printf('%09d', k), '  p->handler()' FROM cn""")
def callback_info(spark, d):
    fields, regs, calls = callback_facts(spark, d)
    return R.callback_info(
        P.c_files(spark, d), C.dispatch_tables(fields, regs), fields, C.dispatch_callbacks(fields, regs), regs, calls
    )


@query("io_flow_document", f"""
WITH o AS (SELECT *, row_number() OVER (ORDER BY output_type, name, path, line) AS ord, regexp_extract(path, '_(\\d+)', 1) AS k,
             regexp_extract(path, 'py/(.)/', 1) AS s FROM ({_PY_OUTPUTS})),
h AS (SELECT output_type, count(*) AS n FROM o GROUP BY 1), low AS (SELECT CAST(-4611686018427387904 AS BIGINT) AS low),
l AS (
SELECT 1 AS section, ord AS n, 0 AS sub, '0' AS pos, '| ' || ord || ' | `' || name || '` | ' || output_type || ' | `' || path || ':' || line || '` | 🟢 high | 3 |' AS line FROM o
UNION ALL SELECT 2, ord, 0, '0', '### 2.' || ord || ' `' || name || '` 🟢' || chr(10) || chr(10) || '- **Type**: ' || output_type || chr(10) || '- **Place**: `' || path || ':' || line
  || '`' || chr(10) || '- **Found by**: regex' || chr(10) || '- **Evidence**: ' || evidence || chr(10) || chr(10) || '#### Inputs' || chr(10)
  || '| Source | Type | Place | Relation |' || chr(10) || '|---|---|---|---|' FROM o
UNION ALL SELECT 2, ord, 1, 'upstream_caller' || chr(9) || path || chr(9) || '000021' || chr(9) || '<module>', '| `<module>` | function | `' || path || ':21` | upstream_caller |' FROM o
UNION ALL SELECT 2, ord, 1, 'sql_input' || chr(9) || path || chr(9) || '000010' || chr(9) || 'raw.orders_' || s, '| `raw.orders_' || s || '` | db_table | `' || path || ':10` | sql_input |' FROM o
UNION ALL SELECT 2, ord, 1, 'data_read' || chr(9) || path || chr(9) || '000017' || chr(9) || 'source_rows', '| `source_rows` | data_read | `' || path || ':17` | data_read |' FROM o
UNION ALL SELECT 3, -n, 0, output_type, '| ' || output_type || ' | ' || n || ' |' FROM h
UNION ALL SELECT 4, 0, 0, '0', '- **Outputs**: ' || count(*) || chr(10) || '- **Inputs**: ' || 3 * count(*) || chr(10) || '- **Confidence**: 🟢' || count(*) || ' 🟡0 🔴0' FROM o
UNION ALL SELECT 0, 0, 0, unnest(['0000', '0001']), unnest(['# Orders: outputs and their inputs', ''])
UNION ALL SELECT 1, low, 0, unnest(['0000', '0001', '0002', '0003']), unnest(['## 1. Outputs', '', '| # | Output | Type | Place | Confidence | Inputs |', '|---|---|---|---|---|---|']) FROM low
UNION ALL SELECT 2, low, 0, unnest(['0000', '0001', '0002']), unnest(['', '## 2. Details', '']) FROM low
UNION ALL SELECT 3, low, 0, unnest(['0000', '0001', '0002', '0003', '0004']), unnest(['', '## 3. Summary', '', '| Type | Outputs |', '|---|---|']) FROM low)
SELECT CAST(section AS INTEGER) AS section, CAST(n AS BIGINT) AS n, CAST(sub AS INTEGER) AS sub, pos, line FROM l""")
def io_flow_document(spark, d):
    files = P.python_files(spark, d)
    found = stage_table(O.regex_outputs(files).drop("found_at").withColumn("context", F.lit("")))
    py, calls = python_graph(spark, d)
    inputs = stage_table(O.trace_inputs(found, calls, facts.embedded_sql(files), X.symbols(py)))
    return R.io_flow_document(found, inputs, "Orders")


def _html_sql(base: str, title: str) -> str:
    """DuckDB SQL for the page of a report whose lines ``base`` gives."""
    def each(x: str, *steps: tuple[str, str]) -> str:
        for pattern, by in steps:
            x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
        return x

    def escaped(x: str) -> str:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
            x = f"replace({x}, '{a}', '{b}')"
        return x

    inline = lambda x: each(x, (r"\*\*(.+?)\*\*", r"<strong>\1</strong>"), (r"\*(.+?)\*", r"<em>\1</em>"), (r"`([^`]+)`", r"<code>\1</code>"), (r"\[([^\]]+)\]\(([^)]+)\)", r'<a href="\2">\1</a>'))
    anchor = lambda x: each(f"translate(lower(replace({x}, '`', '')), ' .', '--')", ("[^a-z0-9_-]", ""), ("-{2,}", "-"), ("^-|-$", ""))
    cells = each("bare", (r"^\|+|\|+$", ""))
    row = lambda t: f"'<tr>' || array_to_string(list_transform(string_split({cells}, '|'), lambda x: '<{t}>' || {inline(escaped('trim(x)'))} || '</{t}>'), '') || '</tr>'"
    item = each("text", (r"^\s*(?:[-*+]|\d+[.)])\s+", ""))
    ends = "[NULL, '</p>', '</table>', '</ul>', '</ol>', '</code></pre>', '</div>']"
    clean = each("title", ("`([^`]*)`", r"\1"), (r"\*\*(.+?)\*\*", r"\1"), (r"\*(.+?)\*", r"\1"))
    return rf"""
WITH base AS ({base}), single AS (
  SELECT section, n, sub, pos, unnest(string_split(line, chr(10))) AS text, generate_subscripts(string_split(line, chr(10)), 1) AS k FROM base
), c AS (
  SELECT row_number() OVER (ORDER BY section, n, sub, pos, k) - 1 AS ln, text, trim(text) AS bare FROM single
), f AS (
  SELECT *, starts_with(bare, '```') AS fence, count(*) FILTER (starts_with(bare, '```')) OVER (ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) % 2 = 1 AS inside FROM c
), g AS (
  SELECT *, last_value(CASE WHEN fence AND NOT inside THEN CASE WHEN starts_with(bare, '```mermaid') THEN 6 ELSE 5 END END IGNORE NULLS)
      OVER (ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened,
    CASE WHEN starts_with(bare, '```mermaid') THEN 'd' WHEN fence THEN 'c' WHEN bare = '' THEN 'e' WHEN regexp_matches(text, '^#{{1,6}}\s+.*$') THEN 'h' WHEN regexp_matches(bare, '^[-*_]{{3,}}$') THEN 'r'
      WHEN starts_with(bare, '|') THEN CASE WHEN regexp_matches(bare, '^[|:\s-]+$') THEN 's' ELSE 't' END
      WHEN regexp_matches(text, '^\s*[-*+]\s+') THEN 'u' WHEN regexp_matches(text, '^\s*\d+[.)]\s+') THEN 'o' WHEN regexp_matches(bare, '^</?(details|summary)') THEN 'w' ELSE 'p' END AS cls FROM f
), o AS (
  SELECT *, CASE cls WHEN 'p' THEN 1 WHEN 't' THEN 2 WHEN 'u' THEN 3 WHEN 'o' THEN 4 WHEN 'c' THEN 5 WHEN 'd' THEN 6
    WHEN 's' THEN CASE WHEN lag(cls) OVER (ORDER BY ln) = 't' THEN 2 ELSE 0 END ELSE 0 END AS own FROM g
), a AS (
  SELECT *, CASE WHEN NOT inside THEN own WHEN fence THEN 0 ELSE opened END AS after FROM o
), st AS (
  SELECT *, lag(after, 1, 0) OVER (ORDER BY ln) AS s, {each("text", (r"^(#{1,6})\s+(.*)$", r"\2"))} AS title, length(regexp_extract(text, '^(#{{1,6}})\s', 1)) AS level FROM a
), html AS (
  SELECT ln, CASE WHEN inside THEN [CASE WHEN fence THEN {ends}[s + 1] ELSE {escaped("text")} END] ELSE list_filter([
    CASE WHEN own <> s THEN {ends}[s + 1] END,
    CASE WHEN own <> s THEN ['<p>', '<table>', '<ul>', '<ol>', '<pre><code' || CASE WHEN length(bare) > 3 THEN ' class="language-' || {escaped("trim(bare[4:])")} || '"' ELSE '' END || '>', '<div class="mermaid">'][own] END,
    CASE cls WHEN 'h' THEN '<h' || level || ' id="' || {anchor("title")} || '">' || {inline("title")} || '</h' || level || '>' WHEN 'r' THEN '<hr>' WHEN 't' THEN CASE WHEN s = 2 THEN {row("td")} ELSE {row("th")} END
      WHEN 'u' THEN '<li>' || {inline(item)} || '</li>' WHEN 'o' THEN '<li>' || {inline(item)} || '</li>' WHEN 'w' THEN text WHEN 'p' THEN {inline("text")} END], lambda x: x IS NOT NULL) END AS l FROM st
), page AS (
  SELECT 0 AS section, 0 AS n, 0 AS sub, unnest(['0000', '0001', '0002', '0003']) AS pos, unnest(['<!DOCTYPE html>', '<html>', '<head>', '<meta charset="utf-8">']) AS line
  UNION ALL SELECT 0, 1, 0, '0', '<title>{title}</title>' || chr(10) || '<style>{R._STYLE}</style>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || '<nav>'
  UNION ALL SELECT 1, ln, 0, '0', '<a href="#' || {anchor("title")} || '" style="padding-left:' || (level * 16 - 16) || 'px">' || {escaped(clean)} || '</a>' FROM st WHERE cls = 'h' AND NOT inside AND level > 1
  UNION ALL SELECT 2, 0, 0, unnest(['0000', '0001']), unnest(['</nav>', '<main>'])
  UNION ALL SELECT 3, ln, generate_subscripts(l, 1) - 1, '0', unnest(l) FROM html
  UNION ALL SELECT 3, 4611686018427387904, 0, '0', {ends}[after + 1] FROM (SELECT after FROM st ORDER BY ln DESC LIMIT 1) WHERE after > 0
  UNION ALL SELECT 4, 0, 0, unnest(['0000', '0001', '0002']), unnest(['</main>', '</body>', '</html>'])
)
SELECT CAST(section AS INTEGER) AS section, CAST(n AS BIGINT) AS n, CAST(sub AS INTEGER) AS sub, pos, line FROM page"""


@query("io_flow_html", _html_sql(ORACLES["io_flow_document"], "Orders"))
def io_flow_html(spark, d):
    return R.html_document(io_flow_document(spark, d), "Orders")


_CTX_HEADS = "['## Public interface per module', '## Verified calls', '## Imports', '## Registered UDFs', '## XML files loaded', '## SQL in XML']"


@query("structured_context", f"""
WITH p AS (SELECT 'java/' || g AS module, path, unnest([0, 2, 3]) AS seq, unnest(['Customer' || k, 'Customer' || k || '.rate', 'Customer' || k || '.audit']) AS qual,
             unnest(['class', 'method', 'method']) AS kind, unnest([5, 7, 11]) AS ln FROM {JB}),
pn AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY path, seq) AS r, count(*) OVER (PARTITION BY module) AS size FROM p),
e AS (SELECT path, unnest([0, 1]) AS seq, 'Customer' || k || '.rate' AS caller, unnest(['log.info', 'helper' || n]) AS callee, unnest([8, 9]) AS ln FROM {JB}),
en AS (SELECT *, row_number() OVER (ORDER BY path, seq) AS r FROM e),
m AS (SELECT path, unnest([0, 1]) AS seq, unnest(['java.util.List', 'com.acme.Util.log']) AS source FROM {JB}),
mn AS (SELECT *, row_number() OVER (ORDER BY path, seq) AS r FROM m),
u AS (SELECT 'udf_' || n AS name, min(path) AS path FROM {SB} GROUP BY 1),
l AS (
SELECT unnest([1, 2, 3, 4, 5, 6]) AS section, -1 AS n, '0000' AS pos, unnest({_CTX_HEADS}) AS line
UNION ALL SELECT DISTINCT 1, 0, module || chr(9) || '000000000', '### ' || module FROM pn
UNION ALL SELECT 1, 0, module || chr(9) || printf('%09d', r), '  - `' || qual || '` ' || kind || ' @ ' || path || ':' || ln FROM pn
UNION ALL SELECT 2, 0, path || chr(9) || printf('%015d', seq), '  `' || caller || '` → `' || callee || '` @ ' || path || ':' || ln FROM en
UNION ALL SELECT 3, 0, path || chr(9) || printf('%06d', seq), '  `' || path || '` imports `' || source || '`' FROM mn
UNION ALL SELECT 4, 0, name, '  - `' || name || '` @ ' || path || ':6 (spark.udf.register)' FROM u
UNION ALL SELECT 5, 0, 'conf/' || g || '.xml' || chr(9) || path, '  - `conf/' || g || '.xml` loaded by `' || path || '` via XMLLoader.load' FROM {SB}
UNION ALL SELECT 6, 0, path || chr(9) || '000002', '  - `pipeline/step` @ ' || path || ':3' || chr(10) || '    ```SELECT upper(s_name), rank_' || n || '(s_acctbal)' || chr(10)
  || '    FROM ext.supp_' || n || ' WHERE s_acctbal > 0```' FROM {XB})
SELECT CAST(section AS INTEGER) AS section, CAST(n AS BIGINT) AS n, {i(0)} AS sub, pos, line FROM l""")
def structured_context(spark, d):
    java, scala = P.java_files(spark, d), P.scala_files(spark, d)
    found = stage_table(X.extract(java).unionByName(X.extract(P.xml_files(spark, d))), "fact")
    calls = X.direct_calls(found)
    graph = X.call_graph(calls, calls.where("false"), C.indirect_edges(C.indirect_calls(java), C.registrations(java)).where("callee = ''"))
    return R.structured_context(
        java, X.symbols(found), graph, X.imports(found), facts.udf_registrations(scala), facts.xml_loaders(scala)
    )


# one code base per market segment, with a build file of its own
_BUILD_FILES = {"AUTOMOBILE": ("CMakeLists.txt", "cmake"), "BUILDING": ("Makefile", "make"), "FURNITURE": ("build.gradle", "gradle"), "HOUSEHOLD": ("go.mod", "go"), "MACHINERY": ("readme.c", "")}
_GUIDE_CASE = "CASE c_mktsegment " + " ".join(
    f"WHEN '{seg}' THEN '" + (R._GUIDES[guide] if guide else "Start with the data types, then the core modules, written in C.").replace("'", "''") + "'" for seg, (_, guide) in _BUILD_FILES.items()) + " END"


@query("rebuild_guide", f"SELECT DISTINCT c_mktsegment AS segment, {_GUIDE_CASE} AS guide FROM customer")
def rebuild_guide(spark, d):
    customer = P.table(spark, d, "customer")
    found = []
    for segment, (marker, _) in _BUILD_FILES.items():
        path = F.concat(F.lit("m/"), F.col("c_custkey").cast("string"), F.lit("/" + marker))
        files = customer.where(F.col("c_mktsegment") == segment).select(path.alias("path"), F.col("c_name").alias("content"), F.lit("C").alias("language"))
        guide = R.rebuild_guide(stats.totals(files).where("total_files > 0"), stats.primary_language(stats.language_stats(files)))
        found.append(guide.select(F.lit(segment).alias("segment"), "guide"))
    return reduce(DataFrame.unionByName, found)


_MODULE_DOC = P.MODULE_TEXT.replace("# Module", "@ Module").replace("## ", "##### ").replace("@ Module", "#### Module").replace(
    "```mermaid\n", '<details>\n<summary>Flowchart (1 edges)</summary>\n\n```mermaid\n\n').replace("A[go(x)]", 'A["gox"]').replace(
    "--> B\n```\n", "--> B\n\n```\n\n</details>\n")


@query("final_document", f"""
WITH m AS (SELECT p_partkey AS k, p_name, row_number() OVER (ORDER BY 'src_part_' || p_partkey) AS ord, 'src_part_' || p_partkey AS module FROM part),
h AS (SELECT *, '3.' || ord || ' `part/' || k || '`' AS head, '3-' || ord || '-part' || k AS slug FROM m),
b AS (SELECT ord, string_split({sql_text(_MODULE_DOC, k="k", name="p_name")}, chr(10)) AS l FROM m),
t AS (SELECT ord, k, unnest([0, 2, 4]) AS ln, unnest(['    - [Module ' || k || '](#module-' || k || ')', '      - [Duty](#duty)', '      - [Core flow](#core-flow)']) AS line FROM m),
r AS (
SELECT 0 AS section, 0 AS n, 0 AS sub, unnest(['0000', '0001']) AS pos, unnest(['# Parts', '']) AS line
UNION ALL SELECT 1, -4611686018427387904, 0, unnest(['0000', '0001', '0002']), unnest(['- [1. Architecture](#1-architecture)', '- [2. Flows across modules](#2-flows-across-modules)', '- [3. Modules](#3-modules)'])
UNION ALL SELECT 1, 4611686018427387904, 0, unnest(['0000', '0001']), unnest(['- [4. Rebuild guide](#4-rebuild-guide)', ''])
UNION ALL SELECT 2, 0, 0, unnest(['0000', '0001', '0002', '0003', '0004', '0005']), unnest(['---', '', '## 1. Architecture', '', 'Layers.', ''])
UNION ALL SELECT 3, 0, 0, unnest(['0000', '0001', '0002', '0003', '0004', '0005']), unnest(['---', '', '## 2. Flows across modules', '', 'Flows.', ''])
UNION ALL SELECT 4, -4611686018427387904, 0, unnest(['0000', '0001', '0002', '0003']), unnest(['---', '', '## 3. Modules', ''])
UNION ALL SELECT 5, -4611686018427387904, 0, unnest(['0000', '0001', '0002', '0003', '0004']), unnest(['', '---', '', '## 4. Rebuild guide', ''])
UNION ALL SELECT 4, ord, 0, '0', '### ' || head FROM h
UNION ALL SELECT 1, ord, 0, '0', '  - [' || head || '](#' || slug || ')' FROM h
UNION ALL SELECT 4, ord, 1, printf('%09d', x - 1), l[x] FROM b, unnest(range(1, len(l) + 1)) AS u(x)
UNION ALL SELECT 1, ord, 1, printf('%09d', ln), line FROM t)
SELECT CAST(section AS INTEGER) AS section, CAST(n AS BIGINT) AS n, CAST(sub AS INTEGER) AS sub, pos, line FROM r""")
def final_document(spark, d):
    return R.final_document(P.module_texts(spark, d), "Parts", "Layers.", "Flows.").where("section < 6")


@query("final_html", _html_sql(ORACLES["final_document"], "Parts"))
def final_html(spark, d):
    return R.html_document(final_document(spark, d), "Parts")


@query("module_prompts", f"""
WITH b AS (SELECT c_custkey AS file_seq, 'java/' || lower(c_mktsegment) AS module, 'java/' || lower(c_mktsegment) || '/Customer' || c_custkey || '.java' AS path,
  {_JAVA_SQL} AS content, CAST(c_custkey AS VARCHAR) AS k, CAST(c_nationkey AS VARCHAR) AS n FROM customer),
p AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY module ORDER BY file_seq) - 1) / 10) + 1 AS BIGINT) AS part,
  '### ' || path || ' (Java)' || chr(10) || '  class Customer' || k || ' sig: class Customer' || k || ' extends Base' || n || ' implements Audit' || n || ', Scored' || chr(10)
  || '  variable Customer' || k || '.score' || chr(10) || '  public method Customer' || k || '.rate → int (base: int, label: String, w)' || chr(10)
  || '  protected method Customer' || k || '.audit → void sig: protected abstract void audit()' AS lines,
  chr(10) || repeat('=', 60) || chr(10) || '### ' || path || ' (Java, ' || length(content) || ' chars)' || chr(10) || repeat('=', 60) || chr(10) || content AS block FROM b),
r AS (SELECT *, 16000 - coalesce(sum(length(block)) OVER (PARTITION BY module, part ORDER BY file_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM p),
t AS (SELECT *, CASE WHEN length(block) <= rest THEN block WHEN rest > 500 THEN left(block, CAST(rest AS BIGINT)) END AS shown FROM r)
SELECT module || '_part' || part AS module, '{R.SYSTEM}' AS system,
  'Module ' || module || '_part' || part || ' (' || count(*) || ' files)' || chr(10) || chr(10) || 'Symbols:' || chr(10) || string_agg(lines, chr(10) ORDER BY path)
  || chr(10) || chr(10) || 'Callbacks:' || chr(10) || '(none)' || chr(10) || chr(10) || 'Outputs:' || chr(10) || '(none)' || chr(10) || chr(10) || 'Source:' || chr(10)
  || coalesce(string_agg(shown, chr(10) ORDER BY file_seq), '') AS "user"
FROM t GROUP BY module, part""")
def module_prompts(spark, d):
    split = stage_table(modules.split_modules(P.java_files(spark, d), "file_seq"))
    files = split.drop("module").withColumnRenamed("part", "module")
    symbols = stage_table(X.symbols(X.extract(files, only=["symbol"])))
    where = files.select("path", "module")
    no_lines = where.select("module", F.lit(0).alias("sub"), F.lit("").alias("pos"), F.lit("").alias("line")).where("false")
    return R.module_prompts(
        files, "file_seq", modules.symbol_index(symbols, files), modules.source_preview(files, symbols, "file_seq"),
        no_lines, modules.module_outputs(files, O.regex_outputs(files)),
    )


@query("all_callbacks", f"""
WITH f AS (SELECT DISTINCT 'ops_' || s AS struct, unnest(['on_' || t, 'handler']) AS field FROM {CB}),
a AS (SELECT 'ops_' || s AS struct, unnest(['on_' || t, 'handler']) AS field FROM {CB}),
r AS (SELECT path, 12 AS line, 'on_' || t AS field, 'handle_' || b AS func FROM {CB} UNION ALL SELECT path, 13, 'handler', 'cb_' || b FROM {CB}),
n AS (SELECT field, count(*) AS n FROM r GROUP BY field),
h AS (SELECT struct, (SELECT count(*) FROM a WHERE a.struct = f.struct) AS n_fields, sum(n) AS n_regs FROM f JOIN n USING (field) GROUP BY struct),
l AS (
SELECT 1 AS section, struct AS pos, '  ' || struct || ' (' || n_fields || ' fields, ' || CAST(n_regs AS BIGINT) || ' registrations)' AS line FROM h
UNION ALL SELECT DISTINCT 1, struct || chr(9) || field || chr(9) || func, '    ' || field || ' = ' || func FROM f JOIN r USING (field)
UNION ALL SELECT 2, path || chr(9) || printf('%09d', r.line) || chr(9) || field || chr(9) || func, '  p.' || field || ' = ' || func || ' @ ' || path || ':' || r.line FROM r
UNION ALL SELECT 3, path || chr(9) || '000000016' || chr(9) || 'p->handler', '  p->handler() @ ' || path || ':16' FROM {CB})
SELECT CAST(section AS INTEGER) AS section, CAST(0 AS BIGINT) AS n, {i(0)} AS sub, pos, line FROM l""")
def all_callbacks(spark, d):
    fields, regs, calls = callback_facts(spark, d)
    return R.all_callbacks(C.dispatch_tables(fields, regs), C.dispatch_callbacks(fields, regs), regs, calls)


@query("flow_prompts", f"""
WITH a AS (
SELECT 0 AS s, 0 AS n, 'm_' || p_partkey AS pos, '### m_' || p_partkey || chr(10) || '## Core flow' || chr(10) || p_name || chr(10) AS line FROM part
UNION ALL SELECT 9, 0, path || chr(9) || printf('%015d', seq) || chr(9) || callee, '  `run_' || k || '` → `' || callee || '` @ ' || path || ':' || (16 + seq) || chr(10)
  FROM (SELECT path, k, unnest([0, 1]) AS seq, unnest(['p->handler', 'helper_' || s]) AS callee FROM {CB})
UNION ALL SELECT 9, 1, path || chr(9) || printf('%015d', 1099511627776 + line) || chr(9) || callee, '  `' || caller || '` → `' || callee || '` @ ' || path || ':' || line || chr(10)
  FROM ({ORACLES["indirect_edges"]})),
b AS (SELECT *, coalesce(sum(length(line)) OVER (ORDER BY s, n, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a),
p AS (SELECT CAST(floor(before / {R.PART_CHARS}) + 1 AS BIGINT) AS part, string_agg(line, '' ORDER BY s, n, pos) AS facts FROM b GROUP BY part)
SELECT CASE WHEN (SELECT max(part) FROM p) = 1 THEN 'flows' ELSE 'flows_part' || part END AS module, '{R.SYSTEM}' AS system,
  'Describe the flows that cross modules, from these facts.' || chr(10) || chr(10) || facts AS "user" FROM p""")
def flow_prompts(spark, d):
    """Every summary and every edge, indirect ones included, over as many prompts as that takes."""
    files = P.c_files(spark, d)
    direct = X.direct_calls(X.extract(files, only=["call"]))
    graph = stage_table(X.call_graph(direct, direct.where("false"), C.indirect_edges(C.indirect_calls(files), C.registrations(files))))
    part = P.table(spark, d, "part")
    texts = part.select(F.concat(F.lit("m_"), F.col("p_partkey").cast("string")).alias("module"), F.concat(F.lit("## Core flow\n"), "p_name").alias("markdown"))
    none = R._lines(texts.where("false"), 1, 0, 0, F.col("module"), F.col("markdown"))
    return R.flow_prompts(graph, none, texts)


@query("flow_prompt_parts", f"""
WITH a AS (
SELECT 0 AS s, 'm_' || p_partkey AS pos, '### m_' || p_partkey || chr(10) || '## Core flow' || chr(10) || p_name || chr(10) AS line FROM part
UNION ALL SELECT section, pos, line || chr(10) FROM ({ORACLES["all_callbacks"]})
UNION ALL SELECT 9, path || chr(9) || printf('%015d', seq) || chr(9) || callee, '  `run_' || k || '` → `' || callee || '` @ ' || path || ':' || (16 + seq) || chr(10)
  FROM (SELECT path, k, unnest([0, 1]) AS seq, unnest(['p->handler', 'helper_' || s]) AS callee FROM {CB})),
b AS (SELECT *, coalesce(sum(length(line)) OVER (ORDER BY s, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a),
p AS (SELECT CAST(floor(before / {R.PART_CHARS}) + 1 AS BIGINT) AS part, string_agg(line, '' ORDER BY s, pos) AS facts FROM b GROUP BY part)
SELECT CASE WHEN (SELECT max(part) FROM p) = 1 THEN 'flows' ELSE 'flows_part' || part END AS module, '{R.SYSTEM}' AS system,
  'Describe the flows that cross modules, from these facts.' || chr(10) || chr(10) || facts AS "user" FROM p""")
def flow_prompt_parts(spark, d):
    files = P.c_files(spark, d)
    direct = X.direct_calls(X.extract(files, only=["call"]))
    graph = stage_table(X.call_graph(direct, direct.where("false"), C.indirect_edges(C.indirect_calls(files), C.registrations(files)).where("false")))
    part = P.table(spark, d, "part")
    texts = part.select(F.concat(F.lit("m_"), F.col("p_partkey").cast("string")).alias("module"), F.concat(F.lit("## Core flow\n"), "p_name").alias("markdown"))
    fields, regs, calls = callback_facts(spark, d)
    lines = R.all_callbacks(C.dispatch_tables(fields, regs), C.dispatch_callbacks(fields, regs), regs, calls)
    return R.flow_prompts(graph, lines, texts)
