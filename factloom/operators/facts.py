"""Facts found by patterns in source text: SQL, functions, tables, UDFs, loaders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom import fixed_values as V
from factloom.functions import text as T
from factloom.operators.match import match_all
from factloom.operators.taxonomy import categorize


def embedded_sql(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """SQL text in string literals: path, sql, line of the opening quote."""
    hits = match_all(files, content, [V.EMBEDDED_SQL], [path], prefilter=r"(?iU)select|insert|update|delete|create|alter|drop")
    sql = F.btrim(F.col("groups")[0], F.lit(" \t\r\n\f\x0b"))
    return hits.select(path, F.col("match_seq").alias("seq"), sql.alias("sql"), "line").where(F.length("sql") > 20)


def sql_functions(
    stmts: DataFrame, table: DataFrame, keys: list[str], sql: str = "sql", line: Column | None = None
) -> DataFrame:
    """Function calls per statement, first occurrence of each name.

    ``line`` is the line the statement starts on (1 if not given).
    """
    base = line if line is not None else F.lit(1)
    source = stmts.select(*keys, F.col(sql), base.cast("int").alias("_base"))
    hits = match_all(
        source, sql, [V.SQL_CALL], [*keys, "_base"], before=30, after=70, prefilter=r"\(",
        first_by=lambda p, m: m.group(1).lower(),
    )
    named = hits.withColumn("name", F.col("groups")[0]).where(~F.lower("name").isin(*V.SQL_KEYWORDS))
    first = named.select(*keys, "match_seq", "name", (F.col("_base") + F.col("line") - 1).alias("line"), "context")
    return categorize(first, table)


def table_refs(
    stmts: DataFrame, keys: list[str], sql: str = "sql", qualified: bool = True,
    stop: list[str] | None = None,
) -> DataFrame:
    """Distinct tables per statement with the order of first use.

    ``qualified`` keeps ``db.t`` whole; otherwise only its first word counts.
    """
    pattern = V.TABLE_QUALIFIED if qualified else V.TABLE_FIRST_WORD
    stop = stop or (V.TABLE_STOP_STATEMENT if qualified else V.TABLE_STOP_TRUTH)
    found = stmts.select(*keys, F.posexplode(T.find_all(F.col(sql), pattern)).alias("seq", "_raw"))
    named = found.select(*keys, "seq", F.btrim("_raw", F.lit("`\"'")).alias("table_name"))
    named = named.where(~F.lower("table_name").isin(*stop))
    return named.groupBy(*keys, "table_name").agg(F.min("seq").alias("seq"))


def cte_names(stmts: DataFrame, keys: list[str], sql: str = "sql") -> DataFrame:
    """The name right after each WITH."""
    return stmts.select(*keys, F.posexplode(T.find_all(F.col(sql), V.CTE_NAME)).alias("seq", "cte"))


def sql_statements(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Statements of SQL files that start with one of the seven verbs.

    Cut at semicolons outside quotes; name, lines and text of each.
    """
    body = r"(?:'[^']*'|\"[^\"]*\"|--[^\n]*|/\*[\s\S]*?\*/|[^;'\"/-]+|[/-])+"
    hits = match_all(files, content, [body], [path])
    # comments before a statement do not belong to it
    lead = F.regexp_extract("text", r"^(?:\s+|--[^\n]*(?:\n|$)|/\*[\s\S]*?\*/)*", 0)
    body_text = F.btrim(F.substring(F.col("text"), F.length(lead) + 1, F.length("text")), F.lit(" \t\r\n\f\x0b"))
    rows = hits.select(
        path, F.col("match_seq").alias("seq"), body_text.alias("sql"),
        (F.col("line") + T.count_of(lead, "\n")).cast("int").alias("line"),
    )
    verb = F.upper(F.regexp_extract("sql", r"^\S+", 0))
    rows = rows.withColumn("verb", verb).where(F.col("verb").isin(*V.SQL_VERBS))
    return rows.select(
        path, "seq", F.concat(F.lit("SQL_"), "verb", F.lit("_"), "line").alias("name"), "verb", "line",
        (F.col("line") + T.count_of(F.col("sql"), "\n")).cast("int").alias("end_line"),
        F.col("sql").alias("signature"),
    )


def udf_registrations(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """UDF names registered in Scala/Java text with their enclosing class.

    The class is the first one named in the window of text before the hit.
    """
    hits = match_all(
        files, content, V.UDF_PATTERNS, [path], before=V.ENCLOSING_CLASS_WINDOW, prefilter=r"register|UDF|@udf",
        first_by=lambda p, m: m.group(1),
    )
    window = F.left("context", F.length("context") - F.length(T.one_line(F.col("text"))))
    label = T.first_label(F.col("text"), V.UDF_LABELS, V.UDF_LABEL_OTHER, ignore_case=("@udf",))
    return hits.select(
        path, F.col("groups")[0].alias("name"), T.find_first(window, V.ENCLOSING_CLASS).alias("class_name"),
        "line", label.alias("registration_type"),
    )


def xml_loaders(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """XML files loaded from Scala/Java text."""
    hits = match_all(
        files, content, V.XML_LOAD_PATTERNS, [path], before=50, after=50, prefilter=r"\.xml|[\"']xml[\"']",
        first_by=lambda p, m: m.group(1),
    )
    label = T.first_label(F.col("text"), V.XML_LOAD_LABELS, V.XML_LOAD_LABEL_OTHER)
    return hits.select(path, F.col("groups")[0].alias("xml_file"), "line", label.alias("method"), "context")
