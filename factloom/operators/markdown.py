"""Markdown as a relation of lines: headings, sections, diagrams, HTML.

A document is one row, so its lines fit one task: the windows below run per
document and share one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom import fixed_values as V
from factloom.functions import text as T

HEADING = r"^(#{1,6})\s+(.*)$"
BLOCK = "(?s)```mermaid(.*?)```"


# what ``(?U)\\s`` matches
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def lines(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """pos, line, fence and in_code; an opening fence counts as code."""
    rows = df.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    so_far = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    fence = strip(F.col("line")).startswith("```")
    return rows.withColumn("fence", fence).withColumn(
        "in_code", F.count_if("fence").over(so_far) % 2 == 1
    )


def joined(df: DataFrame, keys: Sequence[str], out: str, order: Sequence[str] = ("pos",), line: str = "line") -> DataFrame:
    """Lines back to one text per document."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, line)))
    return df.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda r: r[line]), "\n").alias(out))


def headings(rows: DataFrame) -> DataFrame:
    """Adds level and title of heading lines outside code (level 0: no heading)."""
    is_head = ~F.col("in_code") & ~F.col("fence") & F.col("line").rlike(T.PY + HEADING)
    level = F.length(F.regexp_extract("line", HEADING, 1))
    return rows.withColumn("level", F.when(is_head, level).otherwise(0)).withColumn(
        "title", F.when(is_head, strip(F.regexp_extract("line", T.PY + HEADING, 2))).otherwise(F.lit(""))
    )


def normalize_headings(df: DataFrame, keys: Sequence[str], text: str, base_level: int, out: str) -> DataFrame:
    """Shifts headings so the highest starts at ``base_level``; drops empty ones.

    A heading followed by another heading is empty. Code stays untouched.
    """
    rows = headings(lines(df, keys, text))
    doc = Window.partitionBy(*keys)
    real = F.when((F.col("level") > 0) & (F.col("title") != ""), F.col("level"))
    rows = rows.withColumn("_min", F.min(real).over(doc))
    rows = rows.where(~((F.col("level") > 0) & (F.col("title") == "")) | F.col("_min").isNull())
    following = F.lead("level", 1, 0).over(doc.orderBy("pos"))
    rows = rows.withColumn("_next", following).where(
        F.col("_min").isNull() | (F.col("level") == 0) | (F.col("_next") == 0)
    )
    shifted = F.greatest(F.lit(1), F.least(F.lit(6), F.col("level") + F.lit(base_level) - F.col("_min")))
    new_line = F.when(
        (F.col("level") > 0) & F.col("_min").isNotNull(), F.concat(F.repeat(F.lit("#"), shifted), F.lit(" "), "title")
    ).otherwise(F.col("line"))
    return joined(rows.select(*keys, "pos", new_line.alias("line")), keys, out)


def toc(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Table of contents lines: pos, level, title, anchor, entry; starts at level 2."""
    rows = headings(lines(df, keys, text)).where((F.col("level") >= 2) & (F.col("title") != ""))
    link = T.anchor(F.col("title"))
    entry = F.concat(
        F.repeat(F.lit("  "), F.col("level") - 2), F.lit("- ["), "title", F.lit("](#"), link, F.lit(")")
    )
    return rows.select(*keys, "pos", "level", "title", link.alias("anchor"), entry.alias("entry"))


def sections(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Heading sections: section (1, 2 ...), header, content, is_priority."""
    rows = df.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    so_far = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.count_if(strip(F.col("line")).startswith("#")).over(so_far))
    parts = rows.where(F.col("section") > 0).groupBy(*keys, "section").agg(
        F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("_l")
    )
    header = strip(F.col("_l")[0]["line"])
    wanted = F.exists(F.array(*[F.lit(p) for p in V.PRIORITY_HEADINGS]), lambda p: F.lower(header).contains(p))
    return parts.select(
        *keys, "section", header.alias("header"),
        F.array_join(F.transform("_l", lambda r: r["line"]), "\n").alias("content"), wanted.alias("is_priority"),
    )


def key_sections(df: DataFrame, keys: Sequence[str], text: str, max_chars: int = 2000) -> DataFrame:
    """Summary of a text: its sections within the budget, priority ones first."""
    order = Window.partitionBy(*keys).orderBy(F.desc("is_priority"), "section")
    parts = sections(df, keys, text).withColumn("_rank", F.row_number().over(order)).withColumn(
        "_used", F.coalesce(F.sum(F.length("content")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    rest = F.lit(max_chars) - F.col("_used")
    fits = F.length("content") <= rest
    cut = F.concat(F.left("content", rest.cast("int")), F.lit("..."))
    # only the first section that does not fit may be cut
    before = F.coalesce(F.min(fits.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1))
    kept = parts.withColumn("_ok", before).where((F.col("_ok") == 1) & (fits | (rest > 200)))
    summary = joined(
        kept.select(*keys, "_rank", F.when(fits, F.col("content")).otherwise(cut).alias("line")), keys, "_s", ["_rank"]
    )
    return df.join(summary, list(keys), "left").select(
        *keys, F.coalesce("_s", F.left(F.col(text), F.lit(max_chars))).alias("summary")
    )


def diagram_blocks(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Diagram blocks: block (0, 1 ...) and body."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"(?s)```mermaid\s*\n(.*?)```"), F.lit(1))
    return df.select(*keys, F.posexplode(found).alias("block", "body")).withColumn("body", strip(F.col("body")))


def _flowchart(line: Column, subgraph: Column) -> Column:
    for pattern, replacement in V.FLOWCHART_REPAIRS:
        line = F.regexp_replace(line, T.PY + pattern, replacement)
    named = F.concat(F.lit("$1subgraph sg"), subgraph.cast("string"), F.lit(' ["$2"]'))
    return F.when(
        line.rlike(r'^\s*subgraph\s+"'), F.regexp_replace(line, F.lit(r'(\s*)subgraph\s+"([^"]+)"'), named)
    ).otherwise(line)


def _sequence(line: Column) -> Column:
    stripped = strip(line)
    line = F.regexp_replace(line, T.PY + V.SEQUENCE_QUOTES[0], V.SEQUENCE_QUOTES[1])
    split = r"^(.*?)((?:->>|-->>)[^:]+:.*;.*)$"
    fixed = F.concat(
        F.regexp_extract(line, T.PY + split, 1),
        F.replace(F.regexp_extract(line, T.PY + split, 2), F.lit(";"), F.lit("#59;")),
    )
    wanted = stripped.contains(":") & ~stripped.startswith("%%") & line.rlike(T.PY + split)
    return F.when(wanted, fixed).otherwise(line)


def fix_diagrams(df: DataFrame, keys: Sequence[str], text: str, out: str) -> DataFrame:
    """Repairs every closed diagram block and adds missing block ends."""
    blocks = df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(BLOCK), F.lit(1))).alias("block", "body"))
    key = [*keys, "block"]
    rows = blocks.select(*key, F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    # one partitioning serves all windows of the blocks
    so_far = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    bare = strip(F.col("line"))
    seen = F.when(bare.contains("flowchart") | bare.contains("graph "), F.lit("flowchart")).when(
        bare.contains("sequenceDiagram"), F.lit("sequence")
    )
    opens = bare.rlike(r"^(" + "|".join(V.SEQUENCE_BLOCKS) + r")\b")
    rows = rows.withColumn("type", F.first(seen, ignorenulls=True).over(so_far))
    is_sequence = F.col("type") == "sequence"
    rows = rows.withColumn(
        "step", F.when(is_sequence & opens, 1).when(is_sequence & (bare == "end"), -1).otherwise(0)
    ).withColumn("depth", F.sum("step").over(so_far)).withColumn(
        "subgraphs", F.count_if((F.col("type") == "flowchart") & F.col("line").rlike(r'^\s*subgraph\s+"')).over(so_far)
    )
    fixed = (
        F.when(F.col("type") == "flowchart", _flowchart(F.col("line"), F.col("subgraphs") - 1))
        .when(is_sequence, _sequence(F.col("line"))).otherwise(F.col("line"))
    )
    done = rows.select(*key, "pos", "depth", "step", fixed.alias("line")).groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda r: r["line"]), "\n").alias("body"),
        # ends without an open block do not count: open = total - lowest depth below zero
        (F.sum("step") - F.least(F.lit(0), F.min("depth"))).alias("open"),
    )
    closed = F.concat("body", F.repeat(F.lit("\n    end"), F.col("open").cast("int")))
    per_doc = done.select(*key, closed.alias("body")).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("block", "body"))), lambda r: r["body"]).alias("_fixed")
    )
    whole = df.join(per_doc, list(keys), "left").withColumn("_around", F.split(F.col(text), BLOCK, -1))
    woven = F.array_join(
        F.zip_with(
            "_around", F.concat(F.array(F.lit("")), F.transform("_fixed", lambda b: F.concat(F.lit("```mermaid\n"), b, F.lit("\n```")))),
            lambda outer, block: F.concat(block, outer),
        ),
        "",
    )
    return whole.withColumn(out, F.coalesce(woven, F.col(text))).drop("_fixed", "_around")


def wrap_diagrams(df: DataFrame, keys: Sequence[str], text: str, out: str) -> DataFrame:
    """Puts diagrams that are not inside <details> into one, titled by their size."""
    rows = df.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    order = Window.partitionBy(*keys).orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    bare = strip(F.col("line"))
    mark = F.when(bare.startswith("```mermaid"), F.lit("open")).when(bare == "```", F.lit("close"))
    rows = rows.withColumn("bare", bare).withColumn("mark", mark)
    rows = rows.withColumn("last", F.last("mark", ignorenulls=True).over(earlier)).withColumn(
        "inside", F.coalesce(F.col("last") == "open", F.lit(False))
    ).withColumn("starts", ~F.col("inside") & F.coalesce(F.col("mark") == "open", F.lit(False)))
    rows = rows.withColumn("in_block", F.col("inside") | F.col("starts"))
    step = F.when(F.col("in_block"), 0).otherwise(
        F.col("bare").contains("<details").cast("int") - F.col("bare").contains("</details>").cast("int")
    )
    rows = rows.withColumn("step", step).withColumn("sum", F.sum("step").over(so_far))
    rows = rows.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(so_far)))
    rows = rows.withColumn("block", F.when(F.col("in_block"), F.count_if("starts").over(so_far)))
    whole = Window.partitionBy(*keys, "block")
    edge = F.col("bare").contains("-->") | F.col("bare").contains("-.->") | F.col("bare").contains("==>")
    message = F.col("bare").contains("->>")
    flow = F.max(F.col("bare").contains("flowchart") | F.col("bare").contains("graph ")).over(whole)
    sequence = F.max(F.col("bare").contains("sequenceDiagram")).over(whole)
    rows = rows.withColumn("edges", F.when(flow, F.count_if(edge).over(whole)).otherwise(0)).withColumn(
        "messages", F.when(~flow & sequence, F.count_if(message).over(whole)).otherwise(0)
    ).withColumn("last_pos", F.max("pos").over(whole)).withColumn(
        "wrap", F.col("in_block") & (F.max(F.when(F.col("starts"), F.col("depth"))).over(whole) == 0)
    )
    title = (
        F.when(F.col("messages") > 0, F.format_string("Sequence Diagram (%d messages)", F.col("messages")))
        .when(F.col("edges") > 0, F.format_string("Flowchart (%d edges)", F.col("edges")))
        .otherwise(F.lit("Mermaid Diagram"))
    )
    head = F.concat(F.lit("<details>\n<summary>"), title, F.lit("</summary>\n\n"))
    new_line = F.concat(
        F.when(F.col("wrap") & F.col("starts"), head).otherwise(F.lit("")), "line",
        F.when(F.col("wrap") & (F.col("pos") == F.col("last_pos")), F.lit("\n\n</details>")).otherwise(F.lit("")),
    )
    return joined(rows.select(*keys, "pos", new_line.alias("line")), keys, out)


# bold and italic, code, links: a piece that every such text holds, and the replacements
INLINE = (
    ("*", ((r"\*\*(.+?)\*\*", "<strong>$1</strong>"), (r"\*(.+?)\*", "<em>$1</em>"))),
    ("`", ((r"`([^`]+)`", "<code>$1</code>"),)),
    ("](", ((r"\[([^\]]+)\]\(([^)]+)\)", '<a href="$2">$1</a>'),)),
)


def replaced(text: Column, steps: Sequence[tuple[str, str]]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def inline_html(text: Column) -> Column:
    """Bold, italic, code and links."""
    for _, steps in INLINE:
        text = replaced(text, steps)
    return text


def to_html(df: DataFrame, keys: Sequence[str], text: str, out: str) -> DataFrame:
    """Basic Markdown to HTML: headings, lists, tables, code, rules, paragraphs."""
    rows = headings(lines(df, keys, text))
    bare = strip(F.col("line"))
    kind = (
        F.when(F.col("in_code") | F.col("fence"), "code").when(bare == "", "blank").when(F.col("level") > 0, "heading")
        .when(bare.rlike(r"^[-*_]{3,}$"), "rule").when(bare.startswith("|"), "table")
        .when(F.col("line").rlike(r"^\s*[-*+]\s+"), "ul").when(F.col("line").rlike(r"^\s*\d+[.)]\s+"), "ol")
        .otherwise("p")
    )
    order = Window.partitionBy(*keys).orderBy("pos")
    rows = rows.withColumn("kind", kind)
    opens_code = F.col("fence") & F.col("in_code")
    starts = opens_code | F.col("kind").isin("heading", "rule") | (F.col("kind") != F.coalesce(F.lag("kind").over(order), F.lit("")))
    rows = rows.withColumn("starts", starts).withColumn(
        "island", F.count_if("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).where(F.col("kind") != "blank")
    cells = F.transform(
        F.split(F.regexp_replace(bare, r"^\|+|\|+$", ""), r"\|"), lambda c: strip(c)
    )
    separator = F.forall(F.filter(cells, lambda c: c != ""), lambda c: c.rlike(r"^[-:]+$"))
    rows = rows.where(~((F.col("kind") == "table") & separator))
    first = F.row_number().over(Window.partitionBy(*keys, "island").orderBy("pos")) == 1
    tag = F.when(first, F.lit("th")).otherwise(F.lit("td"))
    row = F.concat(
        F.lit("<tr>"),
        F.array_join(F.transform(cells, lambda c: F.concat(
            F.lit("<"), F.col("tag"), F.lit(">"), inline_html(T.escape_html(c)), F.lit("</"), F.col("tag"), F.lit(">"))), ""),
        F.lit("</tr>"),
    )
    item = F.regexp_replace("line", r"^\s*(?:[-*+]|\d+[.)])\s+", "")
    code_open = F.concat(
        F.lit("<pre><code"),
        F.when(F.length(bare) > 3, F.concat(F.lit(' class="language-'), T.escape_html(strip(F.substring(bare, 4, 200))), F.lit('"'))).otherwise(F.lit("")),
        F.lit(">"),
    )
    heading = F.concat(
        F.lit("<h"), F.col("level").cast("string"), F.lit(' id="'), T.anchor(F.col("title")), F.lit('">'),
        inline_html(F.col("title")), F.lit("</h"), F.col("level").cast("string"), F.lit(">"),
    )
    html = (
        F.when(opens_code, code_open).when(F.col("fence"), F.lit("</code></pre>"))
        .when(F.col("kind") == "code", T.escape_html(F.col("line"))).when(F.col("kind") == "heading", heading)
        .when(F.col("kind") == "rule", F.lit("<hr>")).when(F.col("kind") == "table", row)
        .when(F.col("kind").isin("ul", "ol"), F.concat(F.lit("<li>"), inline_html(item), F.lit("</li>")))
        .otherwise(F.col("line"))
    )
    rows = rows.withColumn("tag", tag).withColumn("html", html)
    islands = rows.groupBy(*keys, "island").agg(
        F.first("kind").alias("kind"), F.max("fence").alias("fenced"),
        F.count_if(F.col("fence") & ~F.col("in_code")).alias("closers"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "html"))), lambda r: r["html"]).alias("parts"),
    )
    body = F.array_join("parts", "\n")
    block = (
        F.when(F.col("kind") == "p", F.concat(F.lit("<p>"), inline_html(F.array_join("parts", " ")), F.lit("</p>")))
        .when(F.col("kind") == "table", F.concat(F.lit("<table>\n"), body, F.lit("\n</table>")))
        .when(F.col("kind").isin("ul", "ol"), F.concat(F.lit("<"), "kind", F.lit(">\n"), body, F.lit("\n</"), "kind", F.lit(">")))
        .when((F.col("kind") == "code") & (F.col("closers") == 0), F.concat(body, F.lit("\n</code></pre>")))
        .otherwise(body)
    )
    return joined(islands.select(*keys, "island", block.alias("line")), keys, out, ["island"])
