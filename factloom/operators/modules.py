"""Modules: grouping of files, splitting, symbol index, source preview, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.functions import text as T
from factloom.operators.ordered import chunk, running_sum


def module_sizes(files: DataFrame) -> DataFrame:
    return files.groupBy("module").agg(F.count("*").alias("files"))


def split_modules(files: DataFrame, order: str, max_files: int = 10) -> DataFrame:
    """Adds ``part``: the module, or a sub-module if it has too many files.

    Large modules are cut by parent folder where that gives several groups of
    two or more files (single files join the largest group), otherwise into
    runs of ``max_files`` files. ``order`` is the integer file order.
    """
    parts = T.segments(F.col("path"))
    grouped = files.withColumn(
        "_group", F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(F.lit("_root"))
    )
    groups = grouped.groupBy("module", "_group").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    # largest group; of equal ones the first in file order, as it was met first
    shape = groups.groupBy("module").agg(
        F.sum("n").alias("_size"), F.count_if(F.col("n") >= 2).alias("_good"),
        F.max_by("_group", F.when(F.col("n") >= 2, F.struct("n", (-F.col("first")).alias("f")))).alias("_largest"),
    )
    # one small row per folder, joined once after the files are numbered
    folders = groups.select("module", "_group", "n").join(shape, "module")
    numbered = chunk(grouped, ["module"], order, max_files, "_part").join(folders, ["module", "_group"])
    folder = F.when(F.col("n") >= 2, F.col("_group")).otherwise(F.col("_largest"))
    part = (
        F.when(F.col("_size") <= max_files, F.col("module"))
        .when(F.col("_good") <= 1, F.concat("module", F.lit("_part"), F.col("_part").cast("string")))
        .otherwise(F.concat("module", F.lit("/"), folder))
    )
    return numbered.select(*files.columns, part.alias("part"))


def symbol_line(df: DataFrame) -> DataFrame:
    """Adds ``text``: one index line per symbol."""
    params = F.transform(
        "params",
        lambda p: F.concat(
            p["name"],
            F.when(F.coalesce(p["type"], F.lit("")) != "", F.concat(F.lit(": "), p["type"])).otherwise(F.lit("")),
            F.when(F.coalesce(p["default"], F.lit("")) != "", F.concat(F.lit("="), p["default"])).otherwise(F.lit("")),
        ),
    )
    first = F.left(F.trim(F.substring_index("signature", "\n", 1)), F.lit(200))
    blank = F.lit(None).cast("string")
    tail = (
        F.when(F.size("params") > 0, F.concat(F.lit("("), F.array_join(params, ", "), F.lit(")")))
        .when(F.col("signature") != "", F.concat(F.lit("sig: "), first)).otherwise(blank)
    )
    ret = F.when(F.col("return_type") != "", F.concat(F.lit("→ "), "return_type")).otherwise(blank)
    return df.withColumn(
        "text",
        F.concat(
            F.lit("  "),
            F.concat_ws(
                " ", F.when(F.col("visibility") != "", F.col("visibility")).otherwise(blank), "kind",
                T.qualified(F.col("parent"), F.col("name")), ret, tail,
            ),
        ),
    )


def symbol_index(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Index of a module as lines in order: module, path, seq, text.

    A document is a set of ordered lines, so no module is ever held by one task.
    """
    heads = symbols.select("path").distinct().join(files.select("path", "module", "language"), "path").select(
        "module", "path", F.lit(-1).alias("seq"), F.concat(F.lit("### "), "path", F.lit(" ("), "language", F.lit(")")).alias("text")
    )
    body = symbol_line(symbols).join(files.select("path", "module"), "path").select("module", "path", "seq", "text")
    return heads.unionByName(body)


def source_preview(
    files: DataFrame, symbols: DataFrame, order: str, max_tokens: int = 4000, long_file: int = 8000, head_lines: int = 30
) -> DataFrame:
    """Source shown per module within a budget of four characters per token.

    Long files are reduced to their first lines and six lines from each later
    symbol; the blocks are then taken in file order while the budget lasts.
    """
    lines = F.split("content", "\n")
    is_long = F.length("content") > long_file
    # symbols of one file, which the size guard bounds
    marks = symbols.where(F.col("line") > head_lines).groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("seq", "line", "kind", "name"))).alias("_marks")
    )
    # only long files meet their symbols; the others stay where they were read
    marked = files.where(is_long).join(marks, "path", "left").unionByName(files.where(~is_long).withColumn("_marks", F.lit(None).cast(marks.schema["_marks"].dataType)))
    joined = marked.withColumn("_lines", lines)
    inside = F.filter(F.coalesce("_marks", F.array()), lambda m: m["line"] <= F.size("_lines"))
    shown = F.flatten(
        F.transform(
            inside,
            lambda m: F.concat(
                F.array(F.format_string("--- %s %s (line %d) ---", m["kind"], m["name"], m["line"])),
                F.slice("_lines", m["line"], F.lit(6)),
            ),
        )
    )
    short = F.array_join(
        F.concat(
            F.slice("_lines", 1, head_lines),
            F.array(F.format_string("\n... (%d more lines, showing key definitions only) ...\n", F.size("_lines") - head_lines)),
            shown,
        ),
        "\n",
    )
    bar = "=" * 60
    header = F.format_string(f"\n{bar}\n### %s (%s, %d chars)\n{bar}\n", "path", "language", F.length("content"))
    blocks = joined.select("module", "path", order, F.concat(header, F.when(is_long, short).otherwise(F.col("content"))).alias("text"))
    # the budget is settled on sizes; then only the blocks that are shown move
    sizes = blocks.select("module", "path", order, F.length("text").cast("bigint").alias("_size"))
    used = running_sum(sizes, ["module"], order, F.col("_size"), "_before", before_only=True)
    rest = (F.lit(max_tokens * 4) - F.col("_before")).alias("_rest")
    shown_blocks = used.where((F.col("_size") <= rest) | (rest > 500)).select("module", "path", rest)
    cut = F.when(F.length("text") <= F.col("_rest"), F.col("text")).otherwise(F.left("text", F.col("_rest").cast("int")))
    return blocks.join(shown_blocks, ["module", "path"]).select("module", "path", order, cut.alias("text"))


def to_analyse(modules: DataFrame, files: DataFrame, symbols: DataFrame, cached: DataFrame, force: bool = False) -> DataFrame:
    """Modules with symbols that have no stored analysis of more than 200 characters."""
    with_symbols = files.join(symbols.select("path").distinct(), "path", "left_semi").select("module").distinct()
    pending = modules.join(with_symbols, "module", "left_semi")
    if force:
        return pending
    done = cached.where(F.length("markdown") > 200).select("module")
    return pending.join(done, "module", "left_anti")


def module_outputs(files: DataFrame, outputs: DataFrame) -> DataFrame:
    """Output points of each module as text lines."""
    text = F.concat(
        F.lit("  - "), T.icon(F.col("confidence")), F.lit(" `"), "name", F.lit("` ("), "output_type", F.lit(") @ "),
        "path", F.lit(":"), F.col("line").cast("string"), F.lit(" — "), "evidence",
    )
    return outputs.join(files.select("path", "module"), "path").select("module", "path", "line", "name", text.alias("text"))
