"""Calls through function pointers in C, and inheritance in Java."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom import fixed_values as V
from factloom.functions import text as T
from factloom.operators.joins import salted_join
from factloom.operators.match import match_all


def pointer_fields(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Function pointer fields of C structs; a typedef with a tag counts under both names."""
    structs = match_all(
        files, content, [V.C_TYPEDEF_STRUCT, V.C_STRUCT], [path], prefilter=r"struct"
    ).select(
        path, F.col("line").alias("struct_line"), F.col("pattern_seq").alias("form"), F.col("match_seq").alias("struct_seq"),
        F.when(F.col("pattern_seq") == 0, F.col("groups")[1]).otherwise(F.col("groups")[0]).alias("struct"),
        F.when(F.col("pattern_seq") == 0, F.col("groups")[0]).otherwise(F.col("groups")[1]).alias("body"),
    )
    fields = match_all(structs, "body", [V.C_POINTER_FIELD], [path, "struct", "struct_line", "form", "struct_seq"])
    return fields.select(
        path, "struct", F.col("groups")[1].alias("field"),
        F.btrim(F.col("groups")[0], F.lit(" \t\r\n")).alias("return_type"),
        (F.col("struct_line") + F.col("line") - 1).cast("int").alias("line"),
    )


def registrations(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Assignments of a function name to a struct field."""
    hits = match_all(files, content, [V.C_ASSIGNMENT], [path], prefilter=r"=")
    target = F.col("groups")[0]
    func = F.regexp_replace(F.col("groups")[1], r"^[&\s]+|\s+$", "")
    return hits.select(
        path,
        F.regexp_extract(target, r"^(\w+)(->|\.)", 1).alias("var"),
        F.regexp_extract(target, r"^\w+(?:->|\.)(.*)$", 1).alias("field"),
        func.alias("func"), "line",
    ).where((F.col("func") != "") & (F.col("func") != "NULL") & ~F.col("func").rlike(r"^\d+$"))


def indirect_calls(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Calls whose last field name is known to hold function pointers."""
    hits = match_all(files, content, [V.C_POINTER_CALL], [path], prefilter=r"->|\.")
    expression = F.col("groups")[0]
    field = F.element_at(F.split(F.replace(expression, F.lit("->"), F.lit(".")), r"\."), -1)
    rows = hits.select(path, expression.alias("expression"), field.alias("field"), "line")
    by_suffix = F.col("field").rlike("(" + "|".join(V.POINTER_FIELD_SUFFIXES) + ")$")
    return rows.where(F.col("field").isin(*V.POINTER_FIELD_NAMES) | by_suffix)


def indirect_edges(calls: DataFrame, regs: DataFrame) -> DataFrame:
    """Edges from each indirect call to each function registered for its field.

    Registrations are reduced to one row per field and function, with their
    number in ``copies``; repeating a row that often gives the full multiset.
    """
    targets = regs.groupBy("field", F.col("func").alias("callee")).agg(F.count("*").alias("copies"))
    edges = salted_join(calls, targets, "field")
    return edges.select(
        "path", F.col("expression").alias("caller"), "callee", "line",
        F.lit("indirect").alias("edge_type"), "field", "copies",
    )


def dispatch_tables(fields: DataFrame, regs: DataFrame, min_fields: int = 2) -> DataFrame:
    """Structs with two or more pointer fields: number of fields and registrations."""
    tables = fields.groupBy("struct").agg(F.count("*").alias("n_fields")).where(F.col("n_fields") >= min_fields)
    per_field = regs.groupBy("field").agg(F.count("*").alias("n"))
    found = fields.select("struct", "field").distinct().join(per_field, "field").groupBy("struct").agg(
        F.sum("n").alias("n_registrations")
    )
    return tables.join(found, "struct", "left").select(
        "struct", "n_fields", F.coalesce("n_registrations", F.lit(0)).alias("n_registrations")
    )


def dispatch_callbacks(fields: DataFrame, regs: DataFrame, min_fields: int = 2) -> DataFrame:
    """Registered functions per dispatch table: struct, field, func, copies."""
    tables = fields.groupBy("struct").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_fields).select("struct")
    kept = fields.select("struct", "field").distinct().join(tables, "struct", "left_semi")
    targets = regs.groupBy("field", "func").agg(F.count("*").alias("copies"))
    return salted_join(kept, targets, "field").select("struct", "field", "func", "copies")


def stored_view(facts: DataFrame, limit: int | None = None) -> DataFrame:
    """A callback table in order of place, whole or its first ``limit`` rows."""
    rest = [c for c in facts.columns if c not in ("path", "line")]
    ordered = facts.orderBy("path", "line", *rest)
    return ordered if limit is None else ordered.limit(limit)


def java_dispatch(symbols: DataFrame) -> DataFrame:
    """(class, relation, target) pairs from class signatures."""
    head = F.col("signature")
    kinds = F.array(
        F.struct(F.lit("extends").alias("relation"), T.find_first(head, r"\bextends\s+(.*?)(?:\bimplements\b|$)").alias("names")),
        F.struct(F.lit("implements").alias("relation"), T.find_first(head, r"\bimplements\s+(.*)$").alias("names")),
    )
    rows = symbols.where(F.col("kind") == "class").select(
        "path", F.col("name").alias("class"), "line", F.explode(kinds).alias("r")
    )
    # commas inside <...> do not part two names
    names = F.transform(F.split(F.col("r.names"), r",(?![^<]*>)"), lambda n: F.trim(n))
    return rows.select("path", "class", "line", F.col("r.relation").alias("relation"), F.explode(names).alias("target")).where(
        F.col("target") != ""
    )


def callback_summary(fields: DataFrame, regs: DataFrame, calls: DataFrame, tables: DataFrame, edges: DataFrame) -> DataFrame:
    """Row counts of the callback facts as (fact, n)."""
    def counted(df: DataFrame, fact: str, n=F.count("*")) -> DataFrame:
        return df.agg(F.coalesce(n, F.lit(0)).cast("bigint").alias("n")).select(F.lit(fact).alias("fact"), "n")

    return (
        counted(fields, "func_pointer_fields").unionByName(counted(regs, "callback_registrations"))
        .unionByName(counted(calls, "indirect_calls")).unionByName(counted(tables, "dispatch_tables"))
        .unionByName(counted(edges, "enhanced_edges", F.sum("copies")))
    )
