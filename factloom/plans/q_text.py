"""Queries on the given tables as they are: statistics, matching, order, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions.table_functions import register
from factloom.operators import facts, joins, match, modules, ordered, outputs, stats, truth
from factloom.plans.corpus import stream_bodies, table
from factloom.session import spread
from factloom.plans.registry import query
from factloom.sources import files as S
from factloom.sources.chat import response_content

WORD = r"[\p{L}\p{N}_]"
EDGE = r"(?:^|[^\p{L}\p{N}_])"


@query("lang_stats", """
SELECT lang AS language, count(*) AS files,
       CAST(sum(CASE WHEN length(text) = 0 THEN 0
                ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END) AS BIGINT) AS lines
FROM documents GROUP BY lang""")
def lang_stats(spark, d):
    return stats.language_stats(table(spark, d, "documents"), "lang", "text")


@query("primary_language", """
SELECT language, files FROM (SELECT lang AS language, count(*) AS files FROM documents GROUP BY lang)
ORDER BY files DESC, language LIMIT 1""")
def primary_language(spark, d):
    return stats.primary_language(stats.language_stats(table(spark, d, "documents"), "lang", "text"))


def _document_files(spark, d, nested=False):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    folder = F.concat_ws("/", "source", "lang") if nested else F.col("source")
    return docs.select(
        "doc_id", F.col("source").alias("module"),
        F.concat(folder, F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
    )


@query("module_files", "SELECT source AS module, count(*) AS files FROM documents GROUP BY source")
def module_files(spark, d):
    return modules.module_sizes(_document_files(spark, d))


@query("module_parts", """
WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn,
                  count(*) OVER (PARTITION BY source) AS size FROM documents)
SELECT doc_id, source AS module, source || '/doc_' || doc_id || '.txt' AS path,
       CASE WHEN size <= 10 THEN source ELSE source || '_part' || CAST(floor((rn - 1) / 10) + 1 AS BIGINT) END AS part
FROM n""")
def module_parts(spark, d):
    return modules.split_modules(_document_files(spark, d), "doc_id", 10)


@query("module_folders", """
WITH g AS (SELECT source, lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL),
m AS (SELECT source, sum(n) AS size, count(*) FILTER (n >= 2) AS good,
             arg_max(lang, n * 1000000000 - first) FILTER (n >= 2) AS largest FROM g GROUP BY source),
r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)
SELECT doc_id, r.source AS module, r.source || '/' || r.lang || '/doc_' || doc_id || '.txt' AS path,
  CASE WHEN size <= 10 THEN r.source WHEN good <= 1 THEN r.source || '_part' || CAST(floor((rn - 1) / 10) + 1 AS BIGINT)
       WHEN n >= 2 THEN r.source || '/' || r.lang ELSE r.source || '/' || largest END AS part
FROM r JOIN g USING (source, lang) JOIN m USING (source)""")
def module_folders(spark, d):
    return modules.split_modules(_document_files(spark, d, nested=True), "doc_id", 10)


@query("max_files_cap", """
SELECT path FROM (SELECT source || '/doc_' || doc_id || '.txt' AS path FROM documents)""")
def max_files_cap(spark, d):
    return S.first_files(_document_files(spark, d).select("path"), None)


@query("file_rank", """
SELECT path, row_number() OVER (ORDER BY path) - 1 AS file_seq
FROM (SELECT source || '/doc_' || doc_id || '.txt' AS path FROM documents)""")
def file_rank(spark, d):
    return ordered.global_rank(_document_files(spark, d).select("path"), ["path"], "file_seq")


# Made-up paths: folder and file name chosen by the part's key.
_FOLDERS = [
    "src", ".git", ".github", "node_modules", "lib/vendor", "build", "lib/Tests", "a/.cache", "spec/unit", "env", "core/include",
]
_NAMES = [
    "main.c", "Util.java", "test_io.py", "io_test.go", "FooTest.java", "a.test.js", "a.b.scala", "Makefile", ".bashrc",
    "Domain.py", "pom.xml", "x.YML", "README", "api.hpp", "app.py", "BarSuite.scala",
]
_CONTENT = ["int main(void)", "import pytest", "it works", "s.split('x')", "class Test", "describe(x)", "plain"]


def _path_sql(columns: str) -> str:
    folders, names, content = (
        "[" + ",".join("'" + x.replace("'", "''") + "'" for x in xs) + "]" for xs in (_FOLDERS, _NAMES, _CONTENT)
    )
    return f"""
WITH f AS (SELECT {folders}[p_partkey % {len(_FOLDERS)} + 1] AS dir, {names}[p_size % {len(_NAMES)} + 1] AS name,
                  {content}[p_partkey % {len(_CONTENT)} + 1] AS content, p_partkey FROM part),
p AS (SELECT dir || '/' || p_partkey || '/' || name AS path, dir, name, content, p_partkey,
             string_split(dir || '/' || p_partkey || '/' || name, '/') AS segs,
             CASE WHEN name LIKE '_%.%' AND name NOT LIKE '.%' THEN lower(regexp_extract(name, '(\\.[^.]*)$', 1)) ELSE '' END AS ext FROM f)
SELECT path, {columns} FROM p"""


def _paths(spark, d):
    part = table(spark, d, "part")
    pick = lambda xs, by: F.element_at(F.array(*[F.lit(x) for x in xs]), (by % len(xs) + 1).cast("int"))
    return part.select(
        F.concat_ws("/", pick(_FOLDERS, F.col("p_partkey")), F.col("p_partkey").cast("string"), pick(_NAMES, F.col("p_size"))).alias("path"),
        pick(_CONTENT, F.col("p_partkey")).alias("content"),
    )


_STATS_SKIP = "list_has_any(segs, ['.git', '.svn', '.hg', 'node_modules', '__pycache__', '.tox', '.venv', 'venv', 'env', '.env', 'dist', 'build', 'target', '.idea', '.vscode', '.gradle', '.m2', 'vendor', 'third_party', 'external', 'deps', '.cache', 'egg-info', '.eggs'])"


@query("skip_filter", _path_sql(f"""
  NOT ({_STATS_SKIP} OR len(list_filter(segs, lambda s: s LIKE '.%' AND s <> '.github')) > 0) AS keep_stats,
  NOT (dir IN ('.git', '.github', 'node_modules', 'lib/vendor', 'build', 'a/.cache')) AS keep_extract,
  NOT (dir IN ('.git', '.github', 'node_modules', 'build', 'a/.cache')) AS keep_outputs"""))
def skip_filter(spark, d):
    p = F.col("path")
    return _paths(spark, d).select(
        "path", S.keep_for_stats(p).alias("keep_stats"), S.keep_for_extract(p).alias("keep_extract"),
        S.keep_for_outputs(p).alias("keep_outputs"),
    )


@query("test_filter", _path_sql("""
  (dir IN ('lib/Tests', 'spec/unit') OR name IN ('test_io.py', 'io_test.go', 'FooTest.java', 'a.test.js', 'BarSuite.scala')) AS by_path,
  (dir IN ('lib/Tests', 'spec/unit') OR name IN ('test_io.py', 'io_test.go', 'FooTest.java', 'a.test.js', 'BarSuite.scala')
    OR content IN ('import pytest', 's.split(''x'')', 'class Test', 'describe(x)')) AS by_content"""))
def test_filter(spark, d):
    return _paths(spark, d).select(
        "path", S.is_test_file(F.col("path")).alias("by_path"),
        S.is_test_file(F.col("path"), F.col("content")).alias("by_content"),
    )


@query("path_facts", _path_sql("""
  ext, CASE ext WHEN '.c' THEN 'C' WHEN '.hpp' THEN 'C++' WHEN '.java' THEN 'Java' WHEN '.py' THEN 'Python' WHEN '.go' THEN 'Go'
    WHEN '.js' THEN 'JavaScript' WHEN '.scala' THEN 'Scala' WHEN '.xml' THEN 'XML' WHEN '.yml' THEN 'YAML' END AS stats_language,
  CASE ext WHEN '.c' THEN 'C' WHEN '.hpp' THEN 'C++' WHEN '.java' THEN 'Java' WHEN '.py' THEN 'Python' WHEN '.scala' THEN 'Scala'
    WHEN '.xml' THEN 'XML' END AS extract_language,
  CASE name WHEN 'Makefile' THEN 'Make' WHEN 'pom.xml' THEN 'Maven' END AS build_system,
  name IN ('main.c', 'app.py', 'Domain.py') AS is_entry, CAST(len(segs) - 1 AS INTEGER) AS depth,
  dir || '/' || p_partkey AS module"""))
def path_facts(spark, d):
    from factloom import fixed_values as V

    p = F.col("path")
    ext = T.extension(p)
    return _paths(spark, d).select(
        "path", ext.alias("ext"), T.lookup(ext, V.STATS_LANGUAGE).alias("stats_language"),
        T.lookup(ext, V.EXTRACT_LANGUAGE).alias("extract_language"), S.build_system(p).alias("build_system"),
        S.is_entry_point(p).alias("is_entry"), T.depth(p).alias("depth"), T.module_of(p).alias("module"),
    )


@query("repo_totals", _path_sql("1 AS one").replace("SELECT path, 1 AS one FROM p", """
SELECT (SELECT count(*) FROM p) AS total_files,
  (SELECT count(DISTINCT f) FROM (SELECT unnest([array_to_string(segs[1:1], '/'), array_to_string(segs[1:2], '/'),
      CASE WHEN len(segs) > 3 THEN array_to_string(segs[1:3], '/') END]) AS f FROM p)) AS total_dirs,
  ['Make', 'Maven'] AS build_systems"""))
def repo_totals(spark, d):
    return stats.totals(_paths(spark, d))


@query("entry_points", _path_sql("1 AS one").replace(
    "SELECT path, 1 AS one FROM p", "SELECT path FROM p WHERE name IN ('main.c', 'app.py', 'Domain.py')"))
def entry_points(spark, d):
    return stats.entry_points(_paths(spark, d))


@query("folder_outline", _path_sql("1 AS one").replace("SELECT path, 1 AS one FROM p", """,
two AS (SELECT DISTINCT segs[1] AS parent, segs[2] AS child FROM p),
num AS (SELECT parent, child, row_number() OVER (PARTITION BY parent ORDER BY child) AS pos, count(*) OVER (PARTITION BY parent) AS n FROM two)
SELECT parent, CAST(0 AS INTEGER) AS pos, '├── ' || parent || '/' AS line FROM (SELECT DISTINCT parent FROM two)
UNION ALL SELECT parent, CAST(pos AS INTEGER), CASE WHEN pos = n THEN '│   └── ' ELSE '│   ├── ' END || child || '/' FROM num"""))
def folder_outline(spark, d):
    return stats.outline(_paths(spark, d))


@query("link_edges", """
SELECT page_id, CAST(i - 1 AS INTEGER) AS seq, l[i] AS href FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages),
  unnest(range(1, len(l) + 1)) AS t(i)""")
def link_edges(spark, d):
    pages = table(spark, d, "pages")
    return pages.select("page_id", F.posexplode(T.find_all(F.col("html"), 'href="([^"]*)"')).alias("seq", "href"))


@query("tag_counts", """
SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag""")
def tag_counts(spark, d):
    pages = table(spark, d, "pages")
    tags = pages.select(F.explode(T.find_all(F.col("html"), "<([a-z][a-z0-9]*)")).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


@query("page_calls", """
SELECT page_id, name, count(*) AS n FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '([a-zA-Z_][a-zA-Z0-9_]*)\\s*\\(', 1)) AS name FROM pages) GROUP BY ALL""")
def page_calls(spark, d):
    pages = table(spark, d, "pages")
    calls = pages.select("page_id", F.explode(T.find_all(F.col("html"), r"([a-zA-Z_][a-zA-Z0-9_]*)\s*\(")).alias("name"))
    return calls.groupBy("page_id", "name").agg(F.count("*").alias("n"))


_LINES = """
WITH m AS (SELECT doc_id, text, regexp_extract_all(text, '(the|der|les) [a-z]+', 0) AS hits,
                  string_split_regex(text, '(?:the|der|les) [a-z]+') AS pieces FROM documents),
n AS (SELECT doc_id, i, hits, text,
        list_aggregate(list_transform(pieces[1:i], lambda p: length(p)), 'sum') +
          coalesce(list_aggregate(list_transform(hits[1:i-1], lambda p: length(p)), 'sum'), 0) AS start,
        list_aggregate(list_transform(pieces[1:i], lambda p: length(p) - length(replace(p, chr(10), ''))), 'sum') AS newlines
      FROM m, unnest(range(1, len(hits) + 1)) AS t(i))
"""


@query("match_line", _LINES + "SELECT doc_id, CAST(i - 1 AS INTEGER) AS seq, CAST(newlines + 1 AS INTEGER) AS line FROM n")
def match_line(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(T.match_lines(F.col("text"), "(the|der|les) [a-z]+")).alias("seq", "line"))


@query("match_context", _LINES + """
SELECT doc_id, CAST(i - 1 AS INTEGER) AS match_seq, CAST(start AS INTEGER) AS start, CAST(newlines + 1 AS INTEGER) AS line,
  hits[i] AS text, trim(replace(substr(text, CAST(greatest(start - 20, 0) + 1 AS BIGINT),
     CAST(start + length(hits[i]) + 30 - greatest(start - 20, 0) AS BIGINT)), chr(10), ' ')) AS context FROM n""")
def match_context(spark, d):
    hits = match.match_all(
        spread(table(spark, d, "documents").select("doc_id", "text")), "text", ["(?:the|der|les) [a-z]+"], ["doc_id"], before=20, after=30,
        prefilter="the|der|les",
    )
    return hits.select("doc_id", "match_seq", "start", "line", "text", "context")


@query("sql_match_all", _LINES + """
SELECT doc_id, CAST(0 AS INTEGER) AS pattern_seq, CAST(i - 1 AS INTEGER) AS match_seq, CAST(start AS BIGINT) AS start, CAST(newlines + 1 AS BIGINT) AS line, hits[i] AS match_text FROM n""")
def sql_match_all(spark, d):
    """Written in SQL alone, with a table function."""
    register(spark)
    return spark.sql(
        "SELECT doc_id, pattern_seq, match_seq, start, line, match_text FROM match_all(TABLE(SELECT doc_id, text FROM {docs}), 'text', array('(?:the|der|les) [a-z]+'))",
        docs=table(spark, d, "documents").select("doc_id", "text"))


@query("sql_line_counts", """
WITH l AS (SELECT lang, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL)
SELECT lang, count(*) AS lines, count(*) FILTER (WHERE trim(line) = '') AS blank, max(n)::BIGINT AS longest FROM l GROUP BY lang""")
def sql_line_counts(spark, d):
    register(spark)
    return spark.sql(
        "SELECT lang, count(*) AS lines, count_if(trim(line_text) = '') AS blank, max(line_no) AS longest FROM text_lines(TABLE(SELECT lang, text FROM {docs}), 'text') GROUP BY lang",
        docs=table(spark, d, "documents").select("lang", "text"))


_TABLE_SQL = EDGE + r"(?:FROM|JOIN|INTO|OVERWRITE\s+TABLE|TABLE)\s+[`\"'']?(" + WORD + "+)"


@query("table_refs", f"""
SELECT doc_id, table_name, CAST(min(i - 1) AS INTEGER) AS seq FROM (
  SELECT doc_id, unnest(l) AS table_name, unnest(range(1, len(l) + 1)) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '{_TABLE_SQL}', 1, 'i') AS l FROM documents))
WHERE lower(table_name) NOT IN ('select', 'where', 'and', 'or', 'null', 'set', 'as', 'on', 'from') GROUP BY ALL""")
def table_refs(spark, d):
    return facts.table_refs(spread(table(spark, d, "documents").select("doc_id", "text")), ["doc_id"], "text", qualified=False)


@query("table_check", f"""
WITH found AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_TABLE_SQL.replace("OVERWRITE" + chr(92) + "s+TABLE|", "")}', 1, 'i')) AS table_name FROM documents),
known AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_TABLE_SQL}', 1, 'i')) AS table_name FROM benchmark)
SELECT doc_id, table_name, CASE WHEN table_name IN (SELECT table_name FROM known
   WHERE lower(table_name) NOT IN ('select', 'where', 'and', 'or', 'null', 'set', 'as', 'on', 'from')) THEN 'verified' ELSE 'unverified' END AS status
FROM found WHERE lower(table_name) NOT IN ('set', 'select', 'where', 'and', 'or', 'null')""")
def table_check(spark, d):
    found = truth.table_mentions(table(spark, d, "documents"), ["doc_id"])
    known = truth.known_tables(table(spark, d, "benchmark").withColumnRenamed("text", "sql"))
    return truth.validate_tables(found, known)


@query("char_budget", """
WITH r AS (SELECT *, 1500 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM conversations)
SELECT conv_id, turn, CASE WHEN length(text) <= rest THEN text ELSE left(text, CAST(rest AS BIGINT)) END AS text
FROM r WHERE length(text) <= rest OR rest > 500""")
def char_budget(spark, d):
    talks = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return ordered.char_budget(talks, ["conv_id"], "turn", "text", 1500, 500)


@query("asof_container", """
WITH e AS (SELECT user_id, event_id, (event_id * 7919) % 1000003 AS edge_seq, event_type || '_' || event_id AS caller
           FROM events WHERE event_type <> 'purchase')
SELECT p.user_id, p.event_id, arg_max(e.caller, e.edge_seq) AS container
FROM events p LEFT JOIN e ON e.user_id = p.user_id AND e.event_id <= p.event_id
WHERE p.event_type = 'purchase' GROUP BY ALL""")
def asof_container(spark, d):
    events = table(spark, d, "events")
    edges = events.where("event_type <> 'purchase'").select(
        "user_id", "event_id", ((F.col("event_id") * 7919) % 1000003).alias("edge_seq"),
        F.concat_ws("_", "event_type", F.col("event_id").cast("string")).alias("caller"),
    )
    points = events.where("event_type = 'purchase'").select("user_id", "event_id")
    return joins.last_before(points, edges, ["user_id"], "event_id", "edge_seq", "caller", "container")


@query("dedup_first", """
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events)
WHERE rn = 1""")
def dedup_first(spark, d):
    events = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return match.first_wins(events, ["user_id", "event_type"], ["event_id"])


@query("first_reference", """
SELECT source, count(*) AS n, arg_min(doc_id, doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source""")
def first_reference(spark, d):
    return truth.first_reference(table(spark, d, "documents"), "source", ["doc_id"], ["doc_id", "lang"])


_LABELS = "CASE WHEN quality = 1 AND toxic = 0 THEN 'high' WHEN quality = 1 THEN 'medium' WHEN toxic = 0 THEN 'low' ELSE 'none' END"


def _labels(spark, d):
    confidence = F.expr(_LABELS)
    return table(spark, d, "labels").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"),
        F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("output_type"),
        F.col("doc_id").cast("string").alias("path"), confidence.alias("confidence"),
    )


@query("output_rank", f"""
SELECT 'doc_' || doc_id AS name, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS output_type, CAST(doc_id AS VARCHAR) AS path,
  {_LABELS} AS confidence, CAST(CASE {_LABELS} WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS INTEGER) AS rank,
  CASE {_LABELS} WHEN 'high' THEN '🟢' WHEN 'medium' THEN '🟡' WHEN 'low' THEN '🔴' ELSE '⚪' END AS icon FROM labels""")
def output_rank(spark, d):
    return outputs.ranked(_labels(spark, d)).withColumn("icon", T.icon(F.col("confidence")))


@query("type_histogram", f"""
SELECT CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS output_type, count(*) AS n, count(*) FILTER ({_LABELS} = 'high') AS high,
  count(*) FILTER ({_LABELS} = 'medium') AS medium, count(*) FILTER ({_LABELS} = 'low') AS low FROM labels GROUP BY 1""")
def type_histogram(spark, d):
    return outputs.type_histogram(_labels(spark, d))


_WORDS = "regexp_extract_all(lower(text), '[\\p{L}]+', 0)"


@query("names_in_text", f"""
WITH names AS (SELECT DISTINCT unnest({_WORDS}) AS name FROM benchmark)
SELECT conv_id, turn, name FROM conversations JOIN names ON contains(lower(text), name)""")
def names_in_text(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(T.find_all(F.lower("text"), r"\p{L}+", 0)).alias("name"))
    talks = spread(table(spark, d, "conversations").select("conv_id", "turn", "text"))
    return truth.udfs_in_text(talks, ["conv_id", "turn"], words)


@query("fuzzy_names", f"""
WITH names AS (SELECT DISTINCT unnest({_WORDS}) AS name FROM conversations WHERE role = 'assistant'),
cands AS (SELECT DISTINCT unnest({_WORDS}) AS cand FROM benchmark),
nt AS (SELECT name, list_distinct(regexp_extract_all(name, '[a-z]+', 0)) AS w FROM names),
ct AS (SELECT cand, list_distinct(regexp_extract_all(cand, '[a-z]+', 0)) AS w FROM cands)
SELECT name, min(cand) AS matched_to FROM nt JOIN ct ON ends_with(name, cand) OR ends_with(cand, name)
   OR (len(nt.w) > 0 AND len(ct.w) > 0 AND len(list_intersect(nt.w, ct.w)) >= 0.7 * len(list_distinct(list_concat(nt.w, ct.w))))
GROUP BY name""")
def fuzzy_names(spark, d):
    words = lambda df, out: df.select(F.explode(T.find_all(F.lower("text"), r"\p{L}+", 0)).alias(out))
    names = words(table(spark, d, "conversations").where("role = 'assistant'"), "name")
    return joins.fuzzy_match(names, words(table(spark, d, "benchmark"), "name"))


_SENTENCES = "SELECT DISTINCT trim(unnest(string_split(lower(text), '.'))) AS name"


@query("similar_word_sets", f"""
WITH s AS (SELECT name, list_distinct(regexp_extract_all(name, '[a-z]+', 0)) AS w FROM ({_SENTENCES} FROM benchmark)),
b AS (SELECT name AS cand, list_distinct(regexp_extract_all(name, '[a-z]+', 0)) AS w FROM ({_SENTENCES} FROM documents))
SELECT name, min(cand) AS candidate FROM s JOIN b ON len(s.w) > 0 AND len(b.w) > 0 AND
  len(list_intersect(s.w, b.w)) >= 0.7 * len(list_distinct(list_concat(s.w, b.w))) GROUP BY name""")
def similar_word_sets(spark, d):
    def sentences(name, out):
        df = table(spark, d, name)
        return df.select(F.explode(F.split(F.lower("text"), "[.]")).alias("s")).select(F.trim("s").alias(out)).distinct()

    return joins.similar_words(sentences("benchmark", "name"), sentences("documents", "candidate"), 0.7)


@query("json_value", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_value(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("anchor_slug", r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(replace(replace(lower(replace(h, '`', '')), ' ', '-'), '.', '-'), '[^\p{L}\p{N}_-]', '', 'g'), '-{2,}', '-', 'g'), '-') AS slug
FROM (SELECT doc_id, string_split(text, chr(10))[1] AS h FROM documents)""")
def anchor_slug(spark, d):
    return table(spark, d, "documents").select("doc_id", T.anchor(F.substring_index("text", "\n", 1)).alias("slug"))


@query("identifier_words", """
SELECT p_partkey, list_concat(list_concat(string_split(p_name, ' '), ['http']), [lower(p_type), 'id']) AS words FROM part""")
def identifier_words(spark, d):
    camel = F.concat(
        F.array_join(F.transform(F.split("p_name", " "), lambda w: F.initcap(w)), ""), F.lit("HTTP_"), F.lower("p_type"), F.lit("2Id"),
    )
    return table(spark, d, "part").select("p_partkey", T.identifier_tokens(camel).alias("words"))


@query("text_scalars", """
SELECT p_partkey, 'src_' || replace(p_name, ' ', '_') || '_' || p_size AS safe, replace(p_name, ' ', '/') || '/' || p_size AS display,
  CASE WHEN length(long) > 48 THEN left(long, 46) || '…' ELSE long END AS short,
  replace(replace('<' || p_brand || '> & "x"', '&', '&amp;'), '<', '&lt;') AS partly,
  p_size || '%' AS share, p_type || '.' || p_name AS qualified
FROM (SELECT *, repeat(p_name || ' ', 5) AS long FROM part)""")
def text_scalars(spark, d):
    part = table(spark, d, "part")
    safe = T.safe_name(F.concat(F.lit("src/"), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("\\"), F.col("p_size").cast("string")))
    long = F.repeat(F.concat("p_name", F.lit(" ")), 5)
    html = T.escape_html(F.concat(F.lit("<"), "p_brand", F.lit('> & "x"')))
    partly = F.replace(F.replace(html, F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"'))
    return part.select(
        "p_partkey", safe.alias("safe"), T.display_name(safe).alias("display"), T.ellipsis(long).alias("short"),
        partly.alias("partly"), T.percent(F.col("p_size") / 100.0).alias("share"),
        T.qualified(F.col("p_type"), F.col("p_name")).alias("qualified"),
    )


@query("html_escape", """
SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM pages""")
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", T.escape_html(F.col("html")).alias("escaped"))


@query("top_k_per_group", """
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 10""")
def top_k_per_group(spark, d):
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return ordered.top_k(lines, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 10)


@query("row_ordinals", """
SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders""")
def row_ordinals(spark, d):
    return ordered.row_numbers(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], "o_orderkey", "n")


@query("response_content", """
SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 2 = 1 THEN 'Order ' || o_orderkey || ' is ' || o_orderstatus ELSE 'Thought ' || o_orderkey END AS content FROM orders""")
def response_text(spark, d):
    return response_content(stream_bodies(spark, d), ["doc"], "body")


# files by byte ranges -------------------------------------------------------------

@query("range_matches", """
WITH f AS (SELECT page_id // 50 AS g, string_agg(html || chr(10), '' ORDER BY page_id) AS t FROM pages WHERE html IS NOT NULL GROUP BY 1),
p AS (SELECT g, unnest(string_split(t, 'track(')) AS piece, generate_subscripts(string_split(t, 'track('), 1) AS k FROM f),
c AS (SELECT g, k, sum(length(piece)) OVER w + 6 * (k - 1) AS start, sum(length(piece) - length(replace(piece, chr(10), ''))) OVER w + 1 AS line,
        count(*) OVER (PARTITION BY g) AS n FROM p WINDOW w AS (PARTITION BY g ORDER BY k))
SELECT g::BIGINT AS g, (k - 1)::BIGINT AS match_seq, start::BIGINT AS start, line::BIGINT AS line FROM c WHERE k < n""")
def range_matches(spark, d):
    """Fifty pages to a file; each file is searched in ranges of 10,000 bytes."""
    from uuid import uuid4

    from factloom.session import ensure_checkpoint_dir
    from factloom.sources.ranges import match_files

    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/factloom-files-{uuid4().hex}"
    pages = spark.read.parquet(f"{d}/pages.parquet").where("html is not null").withColumn("g", F.floor(F.col("page_id") / 50))
    pages.repartition("g").sortWithinPartitions("g", "page_id").select("g", "html").write.partitionBy("g").text(folder)
    hits = match_files(spark, folder, [r"track\("], size=10_000)
    return hits.select(F.regexp_extract("path", r"g=(\d+)", 1).cast("bigint").alias("g"), F.col("match_seq").cast("bigint").alias("match_seq"), "start", "line")
