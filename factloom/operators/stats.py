"""Repository statistics: histograms, totals, build systems, folder outline."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.functions import text as T
from factloom.operators.ordered import top_k
from factloom.sources.files import build_system, is_entry_point


def language_stats(files: DataFrame, language: str = "language", content: str = "content") -> DataFrame:
    """Files and lines per language, most files first."""
    return (
        files.groupBy(F.col(language).alias("language"))
        .agg(F.count("*").alias("files"), F.sum(T.line_count(F.col(content))).alias("lines"))
        .orderBy(F.desc("files"), "language")
    )


def primary_language(stats: DataFrame) -> DataFrame:
    """Language with most files; ties go to the first name."""
    return stats.agg(
        F.min_by("language", F.struct((-F.col("files")).alias("n"), "language")).alias("language"),
        F.max("files").alias("files"),
    )


def totals(files: DataFrame) -> DataFrame:
    """Files, folders, build systems and top-level folders as one row."""
    parts = T.segments(F.col("path"))
    folders = files.select(
        F.explode(
            F.when(
                F.size(parts) > 1,
                F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")),
            ).otherwise(F.array().cast("array<string>"))
        ).alias("folder")
    ).distinct()
    # both sets are bounded: marker names are a fixed table
    marks = files.agg(
        F.count("*").alias("total_files"),
        F.array_sort(F.collect_set(build_system(F.col("path")))).alias("build_systems"),
    )
    return marks.withColumn("total_dirs", folders.agg(F.count("*")).scalar()).select(
        "total_files", "total_dirs", "build_systems"
    )


def top_level_dirs(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").contains("/")).select(
        F.substring_index("path", "/", 1).alias("dir")
    ).distinct()


def entry_points(files: DataFrame, limit: int | None = None) -> DataFrame:
    found = files.where(is_entry_point(F.col("path"))).select("path").orderBy("path")
    return found if limit is None else found.limit(limit)


def outline(files: DataFrame, per_folder: int | None = None) -> DataFrame:
    """Two-level folder outline as lines in order: parent, pos, line.

    With ``per_folder``, at most so many entries below each top-level folder,
    then a line with the number left out.
    """
    parts = T.segments(F.col("path"))
    level1 = files.select(
        parts[0].alias("parent"), (F.size(parts) > 1).alias("folder")
    ).groupBy("parent").agg(F.max("folder").alias("folder"))
    level2 = (
        files.select(parts[0].alias("parent"), F.get(parts, F.lit(1)).alias("child"), (F.size(parts) > 2).alias("folder"))
        .where("child is not null").groupBy("parent", "child").agg(F.max("folder").alias("folder"))
    )
    sizes = level2.groupBy("parent").agg(F.count("*").alias("children"))
    slash = F.when(F.col("folder"), F.lit("/")).otherwise(F.lit(""))
    heads = level1.select("parent", F.lit(0).alias("pos"), F.concat(F.lit("├── "), "parent", slash).alias("line"))
    kids = top_k(level2, ["parent"], [F.col("child")], per_folder, "pos").join(sizes, "parent")
    branch = F.when(F.col("pos") == F.col("children"), F.lit("│   └── ")).otherwise(F.lit("│   ├── "))
    body = kids.select("parent", "pos", F.concat(branch, "child", slash).alias("line"))
    lines = heads.unionByName(body)
    if per_folder is not None:
        lines = lines.unionByName(sizes.where(F.col("children") > per_folder).select(
            "parent", F.lit(per_folder + 1).alias("pos"),
            F.format_string("│   └── ... (%d more)", F.col("children") - per_folder).alias("line"),
        ))
    return lines.orderBy("parent", "pos")
