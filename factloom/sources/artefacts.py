"""Fact tables and texts on storage: Parquet tables, JSON per module, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.functions import text as T
from factloom.sources import versions


def write_table(df: DataFrame, out: str, name: str, partition_by: str | None = None) -> DataFrame:
    """A new version of a table, read back, so later steps use the stored rows."""
    return versions.publish(df, out, name, partition_by)


def read_table(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The current version of a table."""
    return versions.read(spark, out, name)


def nested_files(files: DataFrame, symbols: DataFrame, imports: DataFrame, calls: DataFrame, stmts: DataFrame) -> DataFrame:
    """One record per file with its facts as lists; a file bounds its lists."""
    def listed(df: DataFrame, name: str) -> DataFrame:
        columns = [c for c in df.columns if c != "path"]
        return df.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    nested = files.select("path", "module", "language", "error")
    for df, name in ((symbols, "symbols"), (imports, "imports"), (calls, "calls"), (stmts, "sql_stmts")):
        nested = nested.join(listed(df, name), "path", "left")
    return nested


def write_modules(nested: DataFrame, out: str) -> None:
    """JSON lines per module, one folder each, many modules at once."""
    nested.write.mode("overwrite").partitionBy("module").json(f"{out}/modules")


def read_modules(spark: SparkSession, out: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(f"{out}/modules")


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Stored texts: module (file name without .md) and markdown."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    name = F.regexp_replace(T.base_name(F.col("_metadata.file_path")), r"\.md$", "")
    # the metadata path is percent-encoded, but a plus sign stands for itself
    decoded = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    return rows.select(decoded.alias("module"), F.col("value").alias("markdown"))
