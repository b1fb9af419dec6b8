"""Source files as rows: scan, filters, language."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factloom import fixed_values as V
from factloom.functions import text as T


def _case_glob(ext: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)


def scan(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """Files under ``root``: rel_path, size, content bytes.

    The extension list prunes the file listing, so other files are never
    opened. Directory rules are filters on the path (see ``keep_*``).
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if extensions:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(_case_glob(e) for e in extensions) + "}")
    return reader.load(root).select(
        relative(F.col("path"), root).alias("path"), F.col("length").alias("size"), F.col("content").alias("bytes")
    )


def relative(path: Column, root: str) -> Column:
    """Path below ``root``; the file source writes local roots as file:/x or file:///x."""
    scheme, _, rest = (root if ":" in root else "file:" + root).partition(":")
    return F.regexp_replace(path, f"^{scheme}:/*\\Q{rest.strip('/')}\\E/", "")


def with_text(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Files as text. With ``max_bytes``, a larger file is kept as a row with an error and never opened."""
    read = lambda df: df.select("path", "size", T.decode_utf8(F.col("bytes")).alias("content"), F.lit("").alias("error"))
    if max_bytes is None:
        return read(files)
    # two filters on the size, which the file source takes before it reads any content
    large = files.where(F.col("size") > max_bytes).select("path", "size", F.lit("").alias("content"), F.lit("file too large").alias("error"))
    return read(files.where(F.col("size") <= max_bytes)).unionByName(large)


def with_language(files: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """Adds module, ext and language; keeps files whose extension is in the table."""
    table = table or V.EXTRACT_LANGUAGE
    return (
        files.withColumn("module", T.module_of(F.col("path")))
        .withColumn("ext", T.extension(F.col("path")))
        .where(F.col("ext").isin(*table))
        .withColumn("language", T.lookup(F.col("ext"), table))
    )


def _folders(path: Column) -> Column:
    parts = T.segments(path)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def keep_for_stats(path: Column) -> Column:
    """No skipped or dot name anywhere in the path, file name included."""
    def skipped(s: Column) -> Column:
        return (s.startswith(".") & ~s.isin(*V.DOT_NAMES_KEPT)) | s.isin(*V.SKIP_STATS)

    return ~F.exists(T.segments(path), skipped)


def keep_for_extract(path: Column) -> Column:
    return ~F.exists(_folders(path), lambda s: s.startswith(".") | s.isin(*V.SKIP_EXTRACT))


def keep_for_outputs(path: Column) -> Column:
    return ~F.exists(_folders(path), lambda s: s.startswith(".") | s.isin(*V.SKIP_OUTPUT))


def is_test_file(path: Column, content: Column | None = None, strict_markers: bool = False) -> Column:
    """Test by folder name, file name or a framework marker near the top.

    A marker of any language counts; with ``strict_markers`` only those of the
    file's own language do, and are read as the patterns they are written as.
    """
    in_folder = F.exists(_folders(path), lambda s: F.lower(s).isin(*V.TEST_DIRS))
    name = T.base_name(path)
    by_name = reduce(lambda a, b: a | b, [name.rlike(T.PY + p) for p in V.TEST_FILE_PATTERNS])
    result = in_folder | by_name
    if content is not None:
        head = F.left(F.lower(content), F.lit(V.TEST_MARKER_WINDOW))
        if strict_markers:
            ext = T.extension(path)
            own = [ext.isin(*V.TEST_MARKER_EXTENSIONS[lang]) & reduce(lambda a, b: a | b, [_marked(head, m.lower()) for m in marks]) for lang, marks in V.TEST_MARKERS.items()]
        else:
            own = [head.contains(m.lower()) for marks in V.TEST_MARKERS.values() for m in marks]
        result = result | reduce(lambda a, b: a | b, own)
    return result


def _marked(head: Column, marker: str) -> Column:
    return head.rlike(".*".join("\\Q" + piece + "\\E" for piece in marker.split(".*"))) if ".*" in marker else head.contains(marker)


def source_files(
    spark: SparkSession, root: str, max_files: int | None = None, skip_tests: bool = False,
    max_bytes: int | None = None, strict_markers: bool = False,
) -> DataFrame:
    """The files fact extraction reads; with ``max_files`` the first ones in path order."""
    files = scan(spark, root, list(V.EXTRACT_LANGUAGE)).where(keep_for_extract(F.col("path")))
    if skip_tests:
        head = T.decode_utf8(F.substring(F.col("bytes"), 1, 4 * V.TEST_MARKER_WINDOW))
        files = files.where(~is_test_file(F.col("path"), head, strict_markers))
    return with_language(with_text(first_files(files, max_files), max_bytes))


def first_files(files: DataFrame, max_files: int | None) -> DataFrame:
    """First files in path order, or all; the paths are cut before any content moves."""
    if max_files is None:
        return files
    chosen = files.select("path").orderBy("path").limit(max_files)
    return files.join(chosen, "path", "left_semi")


def build_system(path: Column) -> Column:
    return T.lookup(T.base_name(path), V.BUILD_SYSTEMS)


def is_entry_point(path: Column) -> Column:
    name = T.base_name(path)
    return name.isin(*V.ENTRY_NAMES) | (
        F.lower(name).contains("main") & T.extension(path).isin(*V.ENTRY_EXTENSIONS)
    )
