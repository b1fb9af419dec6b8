"""Output points of a code base and the inputs that feed them."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from factloom import fixed_values as V
from factloom.functions import text as T
from factloom.operators.joins import last_before, salted_join
from factloom.operators.match import first_wins, match_all
from factloom.session import stage_table

COLUMNS = [
    "name", "output_type", "path", "line", "confidence", "detection_layer", "evidence", "context",
]


def _of_pattern(values: list) -> Column:
    """The entry of a list that belongs to the matching pattern."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("pattern_seq") + 1)


def _output_name(rules: list[str | int]) -> Column:
    """Group the naming rule picks: a fixed one, or the first of a certain shape."""
    numbers = [r if isinstance(r, int) else 0 for r in rules]
    name = F.get("groups", _of_pattern(numbers) - 1)
    kinds = _of_pattern([r if isinstance(r, str) else "" for r in rules])
    for kind, (shape, missing) in V.NAME_SHAPES.items():
        fitting = F.filter("groups", lambda g: g.rlike(T.PY + shape))
        name = F.when(kinds == kind, F.coalesce(F.get(fitting, F.lit(0)), F.lit(missing))).otherwise(name)
    return name


def _first_output(patterns: list[tuple]) -> Callable[[int, re.Match], tuple]:
    """Key of a match in the worker: its output type and name, as ``_output_name`` gives it."""
    shapes = {rule: re.compile(shape) for rule, (shape, _) in V.NAME_SHAPES.items()}
    rules = [(p[1], p[2]) for p in patterns]

    def key(pattern: int, match: re.Match) -> tuple:
        kind, rule = rules[pattern]
        if isinstance(rule, int):
            return kind, match.group(rule)
        return kind, next((g for g in match.groups() if g and shapes[rule].search(g)), None)

    return key


def regex_outputs(
    files: DataFrame, patterns: list[tuple] | None = None, path: str = "path", content: str = "content",
    confidence: str = "high", layer: str = "regex",
) -> DataFrame:
    """Layer 1: output points found by the pattern table, one per (name, type, file).

    ``patterns`` rows are (pattern, output type, naming rule, label); callers
    add their own by passing a longer list.
    """
    patterns = patterns or V.OUTPUT_PATTERNS
    hits = match_all(
        files, content, [p[0] for p in patterns], [path], before=40, after=60, flags=re.I,
        first_by=_first_output(patterns), needs=V.OUTPUT_NEEDS if patterns is V.OUTPUT_PATTERNS else None,
    )
    first = hits.select(
        F.col(path).alias("path"), "pattern_seq", "match_seq", "line", "context",
        _output_name([p[2] for p in patterns]).alias("name"),
        _of_pattern([p[1] for p in patterns]).alias("output_type"),
        F.concat(_of_pattern([p[3] for p in patterns]), F.lit(": "), F.left("text", F.lit(100))).alias("evidence"),
    )
    return first.select(
        "name", "output_type", "path", "line", F.lit(confidence).alias("confidence"),
        F.lit(layer).alias("detection_layer"), "evidence", "context",
        F.struct("pattern_seq", "match_seq", F.lit(0).alias("extra")).alias("found_at"),
    )


def sql_outputs(stmts: DataFrame, lenient_insert: bool = False) -> DataFrame:
    """Layer 3: tables written by SQL statements (path, sql, line).

    ``lenient_insert`` also takes INSERT INTO without the word TABLE.
    """
    insert = V.INSERT_TARGET
    if lenient_insert:
        insert = insert.replace(r"TABLE?\s+", r"(?:TABLE\s+)?")
    hits = match_all(
        stmts.withColumnRenamed("line", "stmt_line"), "sql", [insert, V.CREATE_TARGET], ["path", "stmt_line"],
        prefilter=r"(?iU)insert|create",
    )
    is_insert = F.col("pattern_seq") == 0
    name = F.when(is_insert, F.get("groups", F.lit(1))).otherwise(F.col("groups")[0])
    verb = (
        F.when(is_insert & (F.col("groups")[0] != ""), F.lit("SQL INSERT OVERWRITE "))
        .when(is_insert, F.lit("SQL INSERT INTO ")).otherwise(F.lit("SQL CREATE TABLE "))
    )
    named = hits.select(
        name.alias("name"), "path", F.col("stmt_line").alias("line"), "pattern_seq", "match_seq", verb.alias("_verb")
    )
    first = first_wins(named, ["path", "line", "name"], ["pattern_seq", "match_seq"])
    return first.select(
        "name", F.lit("db_table").alias("output_type"), "path", "line", F.lit("high").alias("confidence"),
        F.lit("sql").alias("detection_layer"), F.concat("_verb", "name").alias("evidence"),
        F.lit("").alias("context"),
        F.struct(F.col("line").alias("pattern_seq"), F.col("pattern_seq").alias("match_seq"),
                 F.col("match_seq").alias("extra")).alias("found_at"),
    )


def merge_layers(layers: list[DataFrame]) -> DataFrame:
    """One row per (lower name, type, file); an earlier layer wins."""
    tagged = [
        df.select(*COLUMNS, "found_at", F.lit(i).alias("layer_seq"), F.lower("name").alias("_key"))
        for i, df in enumerate(layers)
    ]
    every = reduce(DataFrame.unionByName, tagged)
    return first_wins(every, ["_key", "output_type", "path"], ["layer_seq", "found_at"]).select(*COLUMNS)


def confidence_rank(confidence: Column) -> Column:
    position = F.array_position(F.array(*[F.lit(c) for c in V.CONFIDENCE_ORDER]), confidence)
    return F.when(position == 0, F.lit(len(V.CONFIDENCE_ORDER))).otherwise(position - 1).cast("int")


def ranked(outputs: DataFrame) -> DataFrame:
    """Best confidence first, then type and name: a range-partitioned sort."""
    return outputs.withColumn("rank", confidence_rank(F.col("confidence"))).orderBy(
        "rank", "output_type", "name", "path"
    )


def containing_function(outputs: DataFrame, calls: DataFrame) -> DataFrame:
    """Adds the caller of the last edge, in edge order, at or before the output line.

    The edges of a file come from one value in one task, so a window per file holds no more.
    """
    edges = calls.select("path", "line", "edge_seq", "caller")
    return last_before(outputs, edges, ["path"], "line", "edge_seq", "caller", "container", bounded=True).where(
        F.coalesce("container", F.lit("")) != ""
    )


def trace_inputs(outputs: DataFrame, calls: DataFrame, stmts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Inputs of each output that has a containing function.

    Upstream callers of that function, the first table each SQL text of the
    file reads from, and symbols of the file that look like reads.
    """
    key = ["name", "output_type", "path", "line"]
    # used by three joins, one of which also counts its hot keys
    placed = stage_table(containing_function(outputs.select(*key), calls))
    edges = calls.select(
        F.col("callee").alias("container"), F.col("caller").alias("source_name"),
        F.col("path").alias("source_path"), F.col("line").alias("source_line"),
    ).distinct()
    # callees of library functions are hot among the edges, though no output lies in them
    upstream = salted_join(placed, edges, "container", right_keys=calls.select(F.col("callee").alias("container"))).select(
        *key, F.lit("upstream_caller").alias("relationship"), F.lit("function").alias("source_type"),
        "source_name", "source_path", "source_line",
    )
    reads = stmts.select(
        "path", F.col("line").alias("source_line"), T.find_first(F.col("sql"), V.INPUT_TABLE).alias("source_name")
    ).where((F.col("source_name") != "") & ~F.lower("source_name").isin(*V.TABLE_STOP_INPUT))
    sql_inputs = placed.join(reads, "path").select(
        *key, F.lit("sql_input").alias("relationship"), F.lit("db_table").alias("source_type"),
        "source_name", F.col("path").alias("source_path"), "source_line",
    )
    readers = symbols.where(F.col("signature").rlike("|".join(V.READ_WORDS))).select(
        "path", F.col("name").alias("source_name"), F.col("line").alias("source_line")
    )
    data_reads = placed.join(readers, "path").select(
        *key, F.lit("data_read").alias("relationship"), F.lit("data_read").alias("source_type"),
        "source_name", F.col("path").alias("source_path"), "source_line",
    )
    return upstream.unionByName(sql_inputs).unionByName(data_reads)


def type_histogram(outputs: DataFrame) -> DataFrame:
    """Outputs per type with the split by confidence, most first."""
    return (
        outputs.groupBy("output_type")
        .agg(
            F.count("*").alias("n"),
            *[F.count_if(F.col("confidence") == c).alias(c) for c in V.CONFIDENCE_ORDER],
        )
        .orderBy(F.desc("n"), "output_type")
    )


def library_outputs(files: DataFrame) -> DataFrame:
    """Public headers, and root build files that define a library (path, content)."""
    folder = F.lower(F.element_at(T.segments(F.concat(F.lit("/"), T.dir_name(F.col("path")))), -1))
    headers = files.where(
        folder.isin(*V.PUBLIC_HEADER_DIRS) & F.col("path").rlike("(" + "|".join(re.escape(e) for e in V.PUBLIC_HEADER_EXTENSIONS) + ")$")
    ).select(
        F.regexp_replace(T.base_name(F.col("path")), r"\.[^.]*$", "").alias("name"),
        F.lit("public_header").alias("output_type"), "path", F.lit(1).alias("line"),
        F.lit("high").alias("confidence"), F.lit("library_api").alias("detection_layer"),
        F.concat(F.lit("Public header in "), folder, F.lit("/")).alias("evidence"),
        F.concat(F.lit("Library API surface: "), "path").alias("context"),
    )
    head = F.left("content", F.lit(V.LIBRARY_MARKER_WINDOW))
    marked = reduce(lambda a, b: a | b, [head.contains(m) for m in V.LIBRARY_MARKERS])
    builds = files.where(F.col("path").isin(*V.LIBRARY_BUILD_FILES) & marked).select(
        F.col("path").alias("name"), F.lit("library_build").alias("output_type"), "path", F.lit(1).alias("line"),
        F.lit("medium").alias("confidence"), F.lit("build_file").alias("detection_layer"),
        F.concat(F.lit("Library target in "), "path").alias("evidence"), F.left("content", F.lit(200)).alias("context"),
    )
    return headers.unionByName(builds)


def with_library_fallback(outputs: DataFrame, library: DataFrame) -> DataFrame:
    """The outputs, or the library outputs if there are none."""
    found = outputs.limit(1).agg(F.count("*")).scalar()
    return outputs.select(*COLUMNS).unionByName(library.select(*COLUMNS).where(found == 0))
