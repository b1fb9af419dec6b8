"""Reports as relations of ordered lines.

A report over a large code base does not fit one task, so it is a table of
lines with sort keys (section, n, sub, pos, line). ``write_document`` stores it
as text parts in order; small texts per module or document stay one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factloom import fixed_values as V
from factloom.functions import text as T
from factloom.operators import markdown as M
from factloom.operators.ordered import char_budget, global_rank, line_rank, running_sum, top_k
from factloom.operators.outputs import type_histogram
from factloom.session import stage_table

KEYS = ["section", "n", "sub", "pos"]


def _lines(df: DataFrame, section: int, n, sub, pos, line: Column) -> DataFrame:
    as_col = lambda v, t: (F.lit(v) if isinstance(v, int) else v).cast(t)
    return df.select(
        F.lit(section).alias("section"), as_col(n, "bigint").alias("n"), as_col(sub, "int").alias("sub"),
        as_col(pos, "string").alias("pos"), line.alias("line"),
    )


def _fixed(spark: SparkSession, section: int, lines: list[str], n: int = 0, sub: int = 0) -> DataFrame:
    rows = [(section, n, sub, f"{i:04d}", text) for i, text in enumerate(lines)]
    return spark.createDataFrame(rows, "section int, n bigint, sub int, pos string, line string")


def _stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def write_document(lines: DataFrame, path: str, keys: list[str] = KEYS) -> None:
    """Text parts in document order: the parts read in name order are the text."""
    lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select("line").write.mode("overwrite").text(path)



# callbacks --------------------------------------------------------------

def callback_info(
    files: DataFrame, tables: DataFrame, fields: DataFrame, callbacks: DataFrame, regs: DataFrame, calls: DataFrame,
    max_regs: int | None = None, max_calls: int | None = None,
) -> DataFrame:
    """Callback facts per module as lines: module, sub, pos, line.

    Dispatch tables belong to every module that declares one of their fields;
    all registrations and indirect calls are listed unless a caller limits them.
    """
    where = files.select("path", "module")
    here = fields.join(where, "path").select("module", "struct", "field").distinct()
    here = here.join(tables.select("struct"), "struct", "left_semi")
    shown = here.select(
        "module", F.lit(0).alias("sub"), F.concat_ws(" ", "struct", F.lit("0"), "field").alias("pos"),
        F.concat(F.lit("  "), "struct", F.lit(": "), "field").alias("line"),
    )
    structs = here.select("module", "struct").distinct()
    filled = structs.join(callbacks, "struct").select(
        "module", F.lit(0).alias("sub"), F.concat_ws(" ", "struct", F.lit("1"), "field", "func").alias("pos"),
        F.concat(F.lit("    "), "field", F.lit(" = "), "func").alias("line"),
    )
    set_here = top_k(regs.join(where, "path"), ["module"], [F.col("path"), F.col("line"), F.col("field")], max_regs).select(
        "module", F.lit(1).alias("sub"), F.format_string("%09d", "rank").alias("pos"),
        F.concat(F.lit("  "), "var", F.lit("."), "field", F.lit(" = "), "func").alias("line"),
    )
    called = top_k(calls.join(where, "path"), ["module"], [F.col("path"), F.col("line"), F.col("expression")], max_calls).select(
        "module", F.lit(2).alias("sub"), F.format_string("%09d", "rank").alias("pos"),
        F.concat(F.lit("  "), "expression", F.lit("()")).alias("line"),
    )
    return _stack([shown, filled, set_here, called])


# validated facts for a text generator ---------------------------------------

def structured_context(
    files: DataFrame, symbols: DataFrame, graph: DataFrame, imports: DataFrame, udfs: DataFrame, loaders: DataFrame,
    per_module: int | None = None, max_edges: int | None = None, max_imports: int | None = None, max_sql: int | None = None,
) -> DataFrame:
    """Facts a generated text must agree with, as report lines; all of them unless a caller limits a section."""
    spark = files.sparkSession
    place = lambda: F.concat(F.lit(" @ "), "path", F.lit(":"), F.col("line").cast("string"))
    public = symbols.where(F.col("kind").isin("function", "class", "method", "interface")).join(
        files.select("path", "module"), "path"
    )
    sizes = public.groupBy("module").agg(F.count("*").alias("size"))
    shown = top_k(public, ["module"], [F.col("path"), F.col("seq")], per_module)
    mod = lambda rank: F.concat("module", F.lit("\t"), F.format_string("%09d", rank))
    first = lambda df, order, n: df if n is None else df.orderBy(*order).limit(n)
    heads = _lines(sizes, 1, 0, 0, mod(F.lit(0)), F.concat(F.lit("### "), "module"))
    body = _lines(
        shown, 1, 0, 0, mod(F.col("rank")),
        F.concat(F.lit("  - `"), T.qualified(F.col("parent"), F.col("name")), F.lit("` "), "kind", place()),
    )
    more = [] if per_module is None else [_lines(
        sizes.where(F.col("size") > per_module), 1, 0, 0, mod(F.lit(per_module + 1)),
        F.format_string("  ... (%d more)", F.col("size") - per_module),
    )]
    edges = first(graph, [F.col("edge_type") == "indirect", "path", "edge_seq"], max_edges)
    calls = _lines(
        edges, 2, F.when(F.col("edge_type") == "indirect", 1).otherwise(0), 0,
        F.concat("path", F.lit("\t"), F.format_string("%015d", "edge_seq")),
        F.concat(F.lit("  `"), "caller", F.lit("` → `"), "callee", F.lit("`"), place()),
    )
    kept = first(imports, ["path", "seq"], max_imports)
    used = _lines(
        kept, 3, 0, 0, F.concat("path", F.lit("\t"), F.format_string("%06d", "seq")),
        F.concat(F.lit("  `"), "path", F.lit("` imports `"), "source", F.lit("`")),
    )
    first_udf = udfs.groupBy("name").agg(F.min_by(F.struct("path", "line", "registration_type"), F.struct("path", "line")).alias("u"))
    named = _lines(
        first_udf, 4, 0, 0, F.col("name"),
        F.concat(F.lit("  - `"), "name", F.lit("` @ "), "u.path", F.lit(":"), F.col("u.line").cast("string"), F.lit(" ("), "u.registration_type", F.lit(")")),
    )
    loads = _lines(
        loaders, 5, 0, 0, F.concat_ws("\t", "xml_file", "path"),
        F.concat(F.lit("  - `"), "xml_file", F.lit("` loaded by `"), "path", F.lit("` via "), "method"),
    )
    in_xml = first(symbols.where("kind = 'sql_in_xml'"), ["path", "seq"], max_sql)
    sql = _lines(
        in_xml, 6, 0, 0, F.concat("path", F.lit("\t"), F.format_string("%06d", "seq")),
        F.concat(F.lit("  - `"), "parent", F.lit("`"), place(), F.lit("\n    ```"), "signature", F.lit("```")),
    )
    titles = ["Public interface per module", "Verified calls", "Imports", "Registered UDFs", "XML files loaded", "SQL in XML"]
    tops = _stack([_fixed(spark, i + 1, [f"## {title}"], n=-1) for i, title in enumerate(titles)])
    return _stack([tops, heads, body, *more, calls, used, named, loads, sql])


def validation_summary(validated: DataFrame, keys: list[str], shown: int | None = None) -> DataFrame:
    """Summary text per document: counts, the names of each status (at most ``shown``), accuracy."""
    ranked = top_k(validated, [*keys, "status"], [F.col("name")], shown)
    place = F.when(F.col("found_in") != "", F.concat(F.lit(" @ "), "found_in", F.lit(":"), F.col("line").cast("string"))).otherwise("")
    item = F.concat(F.lit("  - `"), "name", F.lit("`"), F.when(F.col("status") == "verified", place).otherwise(F.lit(" (not found)")))
    pick = lambda status: F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("status") == status, F.struct("rank", item.alias("item"))))), lambda r: r["item"]
        ), "\n"
    )
    # the names of one document, which its text bounds
    lists = ranked.groupBy(*keys).agg(pick("verified").alias("ok"), pick("unverified").alias("bad"))
    counts = validated.groupBy(*keys).agg(
        F.count_if(F.col("status") == "verified").alias("v"), F.count("*").alias("all")
    )
    text = F.concat_ws(
        "\n", F.lit("## Validation"), F.format_string("### Verified (%d)", "v"), F.when(F.col("ok") != "", F.col("ok")),
        F.format_string("### Not verified (%d)", F.col("all") - F.col("v")), F.when(F.col("bad") != "", F.col("bad")),
        F.concat(F.lit("**Accuracy**: "), T.percent(F.col("v") / F.col("all")), F.format_string(" (%d/%d)", "v", "all")),
    )
    return counts.join(lists, keys).select(*keys, text.alias("summary"))


def correction_prompts(texts: DataFrame, validated: DataFrame, keys: list[str], text: str = "text", shown: int | None = None) -> DataFrame:
    """What to correct in each text: its unverified names (at most ``shown``), then the text.

    Texts with nothing to correct come back as they are.
    """
    worst = top_k(validated.where("status = 'unverified'"), keys, [F.col("name")], shown)
    lists = worst.groupBy(*keys).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "name"))),
                lambda r: F.concat(r["rank"].cast("string"), F.lit(". `"), r["name"], F.lit("` is in no call graph or symbol table")),
            ), "\n"
        ).alias("_list")
    )
    prompt = F.concat(
        F.lit("Correct the text below. These names could not be verified:\n"), "_list",
        F.lit("\nUse the verified name, or mark the statement as a guess. Keep everything else.\n\n"), F.col(text),
    )
    return texts.join(lists, keys, "left").select(*keys, F.coalesce(prompt, F.col(text)).alias("prompt"))


# output report --------------------------------------------------------------

def io_flow_document(outputs: DataFrame, inputs: DataFrame, title: str, analyses: DataFrame | None = None) -> DataFrame:
    """Overview, detail and statistics of all output points, as report lines.

    With ``analyses`` (module, markdown) each detail ends with the key lines of
    the analysis its file belongs to (``related_analyses``).
    """
    spark = outputs.sparkSession
    key = ["name", "output_type", "path", "line"]
    from factloom.operators.outputs import confidence_rank

    ordered = global_rank(
        outputs.withColumn("rank", confidence_rank(F.col("confidence"))), ["rank", "output_type", "name", "path", "line"], "ord"
    ).withColumn("ord", F.col("ord") + 1)
    n_inputs = inputs.groupBy(*key).agg(F.count("*").alias("inputs"))
    listed = ordered.join(n_inputs, key, "left").na.fill(0, ["inputs"])
    mark = lambda: T.icon(F.col("confidence"))
    place = lambda: F.concat(F.lit("`"), "path", F.lit(":"), F.col("line").cast("string"), F.lit("`"))
    overview = _lines(
        listed, 1, F.col("ord"), 0, F.lit("0"),
        F.concat(
            F.lit("| "), F.col("ord").cast("string"), F.lit(" | `"), "name", F.lit("` | "), "output_type", F.lit(" | "), place(),
            F.lit(" | "), mark(), F.lit(" "), "confidence", F.lit(" | "), F.col("inputs").cast("string"), F.lit(" |"),
        ),
    )
    detail = _lines(
        listed, 2, F.col("ord"), 0, F.lit("0"),
        F.concat(
            F.lit("### 2."), F.col("ord").cast("string"), F.lit(" `"), "name", F.lit("` "), mark(),
            F.lit("\n\n- **Type**: "), "output_type", F.lit("\n- **Place**: "), place(), F.lit("\n- **Found by**: "), "detection_layer",
            F.lit("\n- **Evidence**: "), "evidence", F.lit("\n\n#### Inputs\n"),
            F.when(F.col("inputs") > 0, "| Source | Type | Place | Relation |\n|---|---|---|---|").otherwise("*No input found.*"),
        ),
    )
    fed = inputs.join(ordered.select(*key, "ord"), key)
    sources = _lines(
        fed, 2, F.col("ord"), 1, F.concat_ws("\t", "relationship", "source_path", F.format_string("%06d", "source_line"), "source_name"),
        F.concat(
            F.lit("| `"), "source_name", F.lit("` | "), "source_type", F.lit(" | `"), "source_path", F.lit(":"),
            F.col("source_line").cast("string"), F.lit("` | "), "relationship", F.lit(" |"),
        ),
    )
    context = _lines(
        listed.where("context <> ''"), 2, F.col("ord"), 2, F.lit("0"), F.concat(F.lit("#### Code\n```"), "context", F.lit("```"))
    )
    hist = type_histogram(outputs)
    # ten types at most: the type column is a fixed domain
    types = _lines(hist, 3, -F.col("n"), 0, F.col("output_type"), F.concat(F.lit("| "), "output_type", F.lit(" | "), F.col("n").cast("string"), F.lit(" |")))
    totals = hist.agg(*[F.sum(c).alias(c) for c in ("n", "high", "medium", "low")]).select(
        "*", inputs.agg(F.count("*")).scalar().alias("fed")
    )
    summary = _lines(
        totals, 4, 0, 0, F.lit("0"),
        F.format_string("- **Outputs**: %d\n- **Inputs**: %d\n- **Confidence**: 🟢%d 🟡%d 🔴%d", "n", "fed", "high", "medium", "low"),
    )
    low = -(1 << 62)
    heads = _stack([
        _fixed(spark, 0, [f"# {title}: outputs and their inputs", ""]),
        _fixed(spark, 1, ["## 1. Outputs", "", "| # | Output | Type | Place | Confidence | Inputs |", "|---|---|---|---|---|---|"], low),
        _fixed(spark, 2, ["", "## 2. Details", ""], low),
        _fixed(spark, 3, ["", "## 3. Summary", "", "| Type | Outputs |", "|---|---|"], low),
    ])
    parts = [heads, overview, detail, sources, context, types, summary]
    if analyses is not None:
        # key lines once a file, beside each of its outputs
        about = stage_table(related_analyses(outputs, analyses))
        named = about.where("rank = 1").select("path", F.col("module").alias("_module"))
        top = F.concat(F.lit("#### From the analysis of `"), T.display_name(F.col("_module")), F.lit("`"))
        parts.append(_lines(ordered.join(named, "path"), 2, F.col("ord"), 3, F.lit("0"), top))
        parts.append(_lines(ordered.select("path", "ord").join(about, "path"), 2, F.col("ord"), 4, F.format_string("%09d", "rank"), F.col("line")))
    return _stack(parts)


def related_analyses(outputs: DataFrame, analyses: DataFrame, max_lines: int | None = None) -> DataFrame:
    """Key lines of the first module analysis whose name contains the output's file name.

    Both names are compared with slashes and dots as underscores; the lines are
    those under headings that name a duty, interface, flow or algorithm.
    """
    from factloom.operators.joins import contains_join

    safe = lambda c: F.translate(c, "/.", "__")
    needles = outputs.select("path").distinct().withColumn("_needle", safe(F.col("path")))
    texts = analyses.select("module", safe(F.col("module")).alias("_hay"))
    pairs = contains_join(texts, "_hay", needles, "_needle", ignore_case=False, sieve=True)
    matched = needles.join(pairs, "_needle").join(texts, "_hay").groupBy("path").agg(F.min("module").alias("module"))
    rows = M.sections(analyses, ["module"], "markdown")
    wanted = F.lower("header").rlike("|".join(V.KEY_HEADING_WORDS))
    lines = rows.where(wanted).select("module", "section", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    kept = top_k(lines, ["module"], [F.col("section"), F.col("pos")], max_lines)
    return matched.join(kept, "module").select("path", "module", "rank", "line")


# final document -------------------------------------------------------------

# A short guide for each build system, in our own words.
_GUIDES = {
    "cmake": "Write CMakeLists.txt with one library and one program, then:\n\n```bash\ncmake -B build && cmake --build build\n```",
    "make": "Write a Makefile with one rule per object file, then:\n\n```bash\nmake\n```",
    "gradle": "Declare the dependencies in build.gradle, then:\n\n```bash\ngradle build\n```",
    "maven": "Declare the dependencies in pom.xml, then:\n\n```bash\nmvn package\n```",
    "cargo": "Declare the crates in Cargo.toml, then:\n\n```bash\ncargo build --release\n```",
    "npm": "Declare the packages in package.json, then:\n\n```bash\nnpm install && npm run build\n```",
    "go": "Declare the modules in go.mod, then:\n\n```bash\ngo build ./...\n```",
    "python": "Declare the dependencies in pyproject.toml, then:\n\n```bash\npip install .\n```",
}


def rebuild_guide(totals: DataFrame, primary: DataFrame) -> DataFrame:
    """One guide for the first known build system, else one for the main language."""
    names = F.transform("build_systems", F.lower)
    guide = F.concat(F.lit("Start with the data types, then the core modules, written in "), F.coalesce(primary.select("language").scalar(), F.lit("unknown")), F.lit("."))
    for piece, system in reversed(V.BUILD_GUIDES):
        guide = F.when(F.exists(names, lambda n: n.contains(piece)), F.lit(_GUIDES[system])).otherwise(guide)
    return totals.select(guide.alias("guide"))


def _chapter(spark: SparkSession, section: int, heading: str, text: str | DataFrame) -> DataFrame:
    head = ["---", "", heading, ""]
    if isinstance(text, str):
        return _fixed(spark, section, [*head, *text.split("\n"), ""])
    rows = text.select("part", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    body = _lines(rows, section, F.col("part"), 1, F.format_string("%09d", "at"), F.col("line"))
    return _stack([_fixed(spark, section, head, -1), body, _fixed(spark, section, [""], 1 << 62)])


def final_document(
    analyses: DataFrame, title: str, architecture: str | DataFrame = "", flows: str | DataFrame = "", guide: DataFrame | None = None
) -> DataFrame:
    """The whole report with a table of contents, as lines.

    Module texts are shifted below their own heading and repaired; modules come
    in name order. ``architecture`` and ``flows`` are texts, or tables (part, text).
    """
    spark = analyses.sparkSession
    shifted = M.normalize_headings(analyses.select("module", "markdown"), ["module"], "markdown", 4, "markdown")
    repaired = M.fix_diagrams(shifted, ["module"], "markdown", "markdown")
    wrapped = M.wrap_diagrams(repaired, ["module"], "markdown", "markdown")
    # only the names are ranked; the texts are repaired once and read twice
    ranks = global_rank(analyses.select("module"), ["module"], "ord").withColumn("ord", F.col("ord") + 1)
    texts = stage_table(wrapped.join(ranks, "module"))
    heading = F.concat(F.lit("### 3."), F.col("ord").cast("string"), F.lit(" `"), T.display_name(F.col("module")), F.lit("`"))
    heads = _lines(ranks, 4, F.col("ord"), 0, F.lit("0"), heading)
    rows = texts.select("ord", F.posexplode(F.split("markdown", "\n")).alias("at", "text"))
    body = _lines(rows, 4, F.col("ord"), 1, F.format_string("%09d", "at"), F.col("text"))
    listed = M.toc(texts, ["ord"], "markdown")
    toc_heads = _lines(
        ranks, 1, F.col("ord"), 0, F.lit("0"),
        F.concat(F.lit("  - ["), F.substring(heading, 5, 1 << 20), F.lit("](#"), T.anchor(F.substring(heading, 5, 1 << 20)), F.lit(")")),
    )
    toc_body = _lines(listed, 1, F.col("ord"), 1, F.format_string("%09d", "pos"), F.col("entry"))
    high, low = (1 << 62), -(1 << 62)
    parts = [
        _fixed(spark, 0, [f"# {title}", ""]),
        _fixed(spark, 1, ["- [1. Architecture](#1-architecture)", "- [2. Flows across modules](#2-flows-across-modules)", "- [3. Modules](#3-modules)"], low),
        _fixed(spark, 1, ["- [4. Rebuild guide](#4-rebuild-guide)", ""], high),
        _chapter(spark, 2, "## 1. Architecture", architecture),
        _chapter(spark, 3, "## 2. Flows across modules", flows),
        _fixed(spark, 4, ["---", "", "## 3. Modules", ""], low),
        _fixed(spark, 5, ["", "---", "", "## 4. Rebuild guide", ""], low),
        toc_heads, toc_body, heads, body,
    ]
    if guide is not None:
        parts.append(_lines(guide, 5, 0, 0, F.lit("0"), F.col("guide")))
    stamp = F.concat(F.lit("*Written "), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm"), F.lit("*"))
    parts.append(_lines(spark.range(1), 6, 0, 0, F.lit("0"), stamp))
    return _stack(parts)


_STYLE = (
    "body{margin:0 0 0 280px;padding:24px;font:16px/1.6 sans-serif}"
    "nav{position:fixed;left:0;top:0;bottom:0;width:256px;overflow:auto;padding:12px;background:#f2f2f2}"
    "nav a{display:block;text-decoration:none;color:#333}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:4px}"
)


def html_pages(texts: DataFrame, keys: list[str], text: str, title: Column, out: str = "html") -> DataFrame:
    """An HTML page per document: sidebar from its headings, diagrams as blocks."""
    blocks = F.regexp_extract_all(F.col(text), F.lit(r"(?s)```mermaid\s*\n(.*?)```"), F.lit(1))
    # diagrams leave the text while it is converted and come back by number
    around = F.split(F.col(text), r"(?s)```mermaid\s*\n.*?```", -1)
    slotted = F.array_join(
        F.transform(around, lambda piece, i: F.when(i == 0, piece).otherwise(F.concat(F.lit("@@diagram"), (i - 1).cast("string"), F.lit("@@"), piece))), ""
    )
    prepared = texts.select(*keys, title.alias("_title"), blocks.alias("_blocks"), slotted.alias("_slotted"))
    body = M.to_html(prepared, keys, "_slotted", "_body")
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("title", r"`([^`]*)`", "$1"), r"\*\*(.+?)\*\*", "$1"), r"\*(.+?)\*", "$1")
    link = F.concat(
        F.lit('<a href="#'), "anchor", F.lit('" style="padding-left:'), ((F.col("level") - 2) * 16 + 16).cast("string"), F.lit('px">'),
        T.ellipsis(T.escape_html(clean)), F.lit("</a>"),
    )
    side = M.joined(M.toc(texts, keys, text).select(*keys, "pos", link.alias("line")), keys, "_side")
    whole = prepared.join(body, keys, "left").join(side, keys, "left")
    shown = F.aggregate(
        F.transform("_blocks", lambda b, i: F.struct(i.alias("i"), b.alias("b"))), F.coalesce("_body", F.lit("")),
        lambda page, d: F.replace(
            F.replace(page, F.concat(F.lit("<p>@@diagram"), d["i"].cast("string"), F.lit("@@</p>")), F.concat(F.lit("@@diagram"), d["i"].cast("string"), F.lit("@@"))),
            F.concat(F.lit("@@diagram"), d["i"].cast("string"), F.lit("@@")),
            F.concat(F.lit('<div class="mermaid">'), T.escape_html(M.strip(d["b"])), F.lit("</div>")),
        ),
    )
    page = F.concat(
        F.lit('<!DOCTYPE html>\n<html>\n<head>\n<meta charset="utf-8">\n<title>'), T.escape_html(F.col("_title")),
        F.lit(f"</title>\n<style>{_STYLE}</style>\n</head>\n<body>\n<nav>\n"), F.coalesce("_side", F.lit("")), F.lit("\n</nav>\n<main>\n"),
        shown, F.lit("\n</main>\n</body>\n</html>"),
    )
    return whole.select(*keys, page.alias(out))


_PAGE_HEAD = ('<!DOCTYPE html>', '<html>', '<head>', '<meta charset="utf-8">')


def html_document(lines: DataFrame, title: str, keys: list[str] = KEYS) -> DataFrame:
    """A whole report as an HTML page, itself a relation of ordered lines: head, sidebar from its headings, body.

    Rows of several lines are cut into them; lines are placed by rank, converted
    where they lie (``line_html``), and never put together.
    """
    from factloom.operators.line_html import html_lines

    spark = lines.sparkSession
    placed = line_rank(lines.select(*keys, "line"), keys, "line", "at").select(F.lit("").alias("doc"), "at", "line")
    body, heads = html_lines(placed, "doc", "at", "line")
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("title", r"`([^`]*)`", "$1"), r"\*\*(.+?)\*\*", "$1"), r"\*(.+?)\*", "$1")
    link = F.concat(
        F.lit('<a href="#'), "anchor", F.lit('" style="padding-left:'), (F.col("level") * 16 - 16).cast("string"), F.lit('px">'), T.ellipsis(T.escape_html(clean)), F.lit("</a>"))
    name = T.escape_html(F.lit(title))
    head = _lines(spark.range(1), 0, 1, 0, F.lit("0"), F.concat(F.lit("<title>"), name, F.lit(f"</title>\n<style>{_STYLE}</style>\n</head>\n<body>\n<nav>")))
    return _stack([
        _fixed(spark, 0, list(_PAGE_HEAD)), head, _lines(heads, 1, F.col("at"), 0, F.lit("0"), link), _fixed(spark, 2, ["</nav>", "<main>"]),
        _lines(body, 3, F.col("at"), F.col("part"), F.lit("0"), F.col("html")), _fixed(spark, 4, ["</main>", "</body>", "</html>"]),
    ])


# prompts --------------------------------------------------------------------

SYSTEM = "You describe source code. State only what the facts below support, and mark guesses as guesses."


def module_prompts(files: DataFrame, order: str, index: DataFrame, preview: DataFrame, callbacks: DataFrame, outputs: DataFrame) -> DataFrame:
    """(module, system, user) per module of ``files``, which are split already.

    ``index``, ``preview`` and ``outputs`` rows carry the module. A module is
    bounded by the split, its source by the preview's budget.
    """
    joined = lambda df, name, *by: df.groupBy("module").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, "text"))), lambda r: r["text"]), "\n").alias(name)
    )
    index_text = joined(index, "_index", "path", "seq")
    preview_text = joined(preview, "_source", order)
    output_text = joined(outputs, "_outputs", "path", "line", "name")
    callback_text = joined(callbacks.withColumnRenamed("line", "text"), "_callbacks", "sub", "pos")
    sizes = files.groupBy("module").agg(F.count("*").alias("n"))
    whole = sizes.join(index_text, "module", "left").join(preview_text, "module", "left").join(output_text, "module", "left").join(callback_text, "module", "left")
    user = F.concat(
        F.lit("Module "), "module", F.format_string(" (%d files)", "n"),
        F.lit("\n\nSymbols:\n"), F.coalesce("_index", F.lit("(none)")), F.lit("\n\nCallbacks:\n"), F.coalesce("_callbacks", F.lit("(none)")),
        F.lit("\n\nOutputs:\n"), F.coalesce("_outputs", F.lit("(none)")), F.lit("\n\nSource:\n"), F.coalesce("_source", F.lit("")),
    )
    return whole.select("module", F.lit(SYSTEM).alias("system"), user.alias("user"))


PART_CHARS = 60_000


def _prompts(lines: DataFrame, name: str, task: str, budget: int | None, part_chars: int) -> DataFrame:
    """(module, system, user) from report lines: numbered parts that together hold every line.

    A part has the lines that begin within its ``part_chars`` characters of the
    whole text, so no line is cut; a line longer than that leaves numbers out. A
    single part keeps the plain name. With a ``budget`` the facts end there.
    """
    ranked = global_rank(lines, KEYS, "ord").select(F.lit(name).alias("module"), "ord", F.concat("line", F.lit("\n")).alias("line"))
    if budget is not None:
        ranked = char_budget(ranked, ["module"], "ord", "line", budget, 0)
    placed = running_sum(ranked, ["module"], "ord", F.length("line").cast("bigint"), "_before", before_only=True)
    parts = placed.withColumn("part", (F.floor(F.col("_before") / part_chars) + 1).cast("bigint"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda r: r["line"]), "")
    made = stage_table(parts.groupBy("module", "part").agg(text.alias("_facts")))
    whole = made.join(made.groupBy("module").agg(F.max("part").alias("_last")), "module")
    numbered = F.when(F.col("_last") == 1, F.col("module")).otherwise(F.concat("module", F.lit("_part"), F.col("part").cast("string")))
    return whole.select(numbered.alias("module"), F.lit(SYSTEM).alias("system"), F.concat(F.lit(task + "\n\n"), "_facts").alias("user"))


def part_texts(texts: DataFrame) -> DataFrame:
    """(part, text) of texts made from numbered prompts, for ``final_document``."""
    return texts.select(F.coalesce(F.regexp_extract("module", r"_part(\d+)$", 1).try_cast("bigint"), F.lit(1)).alias("part"), "text")


def summaries(analyses: DataFrame, section: int, max_chars: int = 2000) -> DataFrame:
    """The key sections of each module's text as report lines."""
    short = M.key_sections(analyses.select("module", "markdown"), ["module"], "markdown", max_chars)
    return _lines(short, section, 0, 0, F.col("module"), F.concat(F.lit("### "), "module", F.lit("\n"), "summary"))


def all_callbacks(tables: DataFrame, callbacks: DataFrame, regs: DataFrame, calls: DataFrame) -> DataFrame:
    """Callback facts over all modules as report lines: dispatch tables with their functions, registrations, indirect calls."""
    place = lambda: F.concat(F.lit(" @ "), "path", F.lit(":"), F.col("line").cast("string"))
    at = lambda: F.concat("path", F.lit("\t"), F.format_string("%09d", "line"))
    heads = _lines(tables, 1, 0, 0, F.col("struct"), F.concat(F.lit("  "), "struct", F.format_string(" (%d fields, %d registrations)", "n_fields", "n_registrations")))
    filled = _lines(callbacks, 1, 0, 0, F.concat_ws("\t", "struct", "field", "func"), F.concat(F.lit("    "), "field", F.lit(" = "), "func"))
    made = _lines(regs, 2, 0, 0, F.concat_ws("\t", at(), "field", "func"), F.concat(F.lit("  "), "var", F.lit("."), "field", F.lit(" = "), "func", place()))
    used = _lines(calls, 3, 0, 0, F.concat_ws("\t", at(), "expression"), F.concat(F.lit("  "), "expression", F.lit("()"), place()))
    return _stack([heads, filled, made, used])


def flow_prompts(calls: DataFrame, callbacks: DataFrame, analyses: DataFrame, budget: int | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """The prompts for flows across modules: summaries, then callback facts (``all_callbacks``), then call edges."""
    edges = _lines(
        calls, 9, F.when(F.col("edge_type") == "indirect", 1).otherwise(0), 0, F.concat("path", F.lit("\t"), F.format_string("%015d", "edge_seq"), F.lit("\t"), "callee"),
        F.concat(F.lit("  `"), "caller", F.lit("` → `"), "callee", F.lit("` @ "), "path", F.lit(":"), F.col("line").cast("string")),
    )
    return _prompts(_stack([summaries(analyses, 0), callbacks, edges]), "flows", "Describe the flows that cross modules, from these facts.", budget, part_chars)


def synthesis_prompts(context: DataFrame, analyses: DataFrame, budget: int | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """The prompts for the architecture: summaries, then the facts a text must agree with (``structured_context``)."""
    return _prompts(_stack([summaries(analyses, 0), context]), "architecture", "Describe the architecture, from these facts.", budget, part_chars)
