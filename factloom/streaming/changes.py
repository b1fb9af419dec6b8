"""Facts that follow a changing set of files: added, changed and deleted ones.

The facts of a file are appended to a log under the number of the update that
read it, and the table of files says for each path which number counts. So a new
version withdraws the rows of the old one, a deleted file those it had, and nothing is
rewritten. An update reads the contents of new and changed files only.

What is derived follows by deltas, rows with a weight of 1 or -1:

- ``totals`` (fact, n) and ``edges`` (caller, callee, copies) add them up;
- ``names`` (name, n, and the first place it is declared or called) is looked up again
  for the names that occur in the delta, since a least value can't be taken back.

All tables of an update are written aside and named in one published catalogue, so
readers see the state before it or after it, and a run that dies in between
changes nothing. After ``MAX_UPDATES`` numbers the log is written anew from what counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom import fixed_values as V, schema
from factloom.operators import extract as X
from factloom.session import stage_table
from factloom.sources import files as S, versions

FILES = "path string, digest string, size bigint, modified timestamp, number bigint"
TOTALS = "fact string, n bigint"
EDGES = "caller string, callee string, copies bigint"
NAMES = "name string, n bigint, path string, line int, kind string"
MAX_UPDATES = 32
_EMPTY = {"files": FILES, "totals": TOTALS, "edges": EDGES, "names": NAMES}


def tables(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """files, facts, totals, edges and names as the last update left them; empty before the first."""
    paths = {r.name: r.path for r in versions.read(spark, out, "catalog").collect()} if versions.current(spark, out, "catalog") else {}
    found = {name: spark.read.schema(kind).parquet(paths[name]) if name in paths else spark.createDataFrame([], kind) for name, kind in _EMPTY.items()}
    log = spark.read.schema(f"{schema.FACT}, number bigint").parquet(*paths["log"].split("\n")) if paths.get("log") else spark.createDataFrame([], f"{schema.FACT}, number bigint")
    found["log"] = log
    found["facts"] = log.join(found["files"].select("path", "number"), ["path", "number"]).select(*_fact_columns(log))
    return found


def _fact_columns(log: DataFrame) -> list[str]:
    return [c for c in log.columns if c != "number"]


def _mentions(facts: DataFrame) -> DataFrame:
    """Names with their places: symbols, and what is called."""
    named = facts.where(F.col("fact").isin("symbol", "call") & (F.col("name") != ""))
    return named.select("name", "path", "line", F.when(F.col("fact") == "call", "call").otherwise(F.col("kind")).alias("kind"), "seq")


def _first_places(mentions: DataFrame) -> DataFrame:
    rank = F.struct(F.when(F.col("kind") == "call", 1).otherwise(0).alias("r"), "path", "line", "seq")
    return mentions.groupBy("name").agg(F.count("*").alias("n"), F.min_by(F.struct("path", "line", "kind"), rank).alias("at")).select("name", "n", "at.path", "at.line", "at.kind")


def apply(spark: SparkSession, out: str, changed: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """One update: ``changed`` (path, language, content, digest, size, modified) are new or differ, ``gone`` (path) are deleted."""
    before = tables(spark, out)
    last = before["files"].agg(F.max("number")).first()[0]
    numbers = {r.number for r in before["files"].select("number").distinct().collect()}
    number = (last or 0) + 1
    made = {name: f"{out}/{name}/{number:09d}-{uuid.uuid4().hex[:8]}" for name in ("log", "files", "totals", "edges", "names")}

    changed = stage_table(changed.dropDuplicates(["path"]))
    X.extract(changed).withColumn("number", F.lit(number).cast("bigint")).write.parquet(made["log"])
    new = spark.read.schema(before["log"].schema).parquet(made["log"])
    touched = stage_table(changed.select("path").union(gone.select("path")).distinct())
    columns = _fact_columns(before["log"])
    delta = stage_table(
        before["facts"].join(touched, "path", "left_semi").select(*columns).withColumn("weight", F.lit(-1)).unionByName(new.select(*columns).withColumn("weight", F.lit(1))))
    files = before["files"].join(touched, "path", "left_anti").unionByName(
        changed.select("path", "digest", "size", "modified", F.lit(number).cast("bigint").alias("number")))
    files.write.parquet(made["files"])
    files = spark.read.schema(FILES).parquet(made["files"])

    def added(old: DataFrame, rows: DataFrame, keys: list[str], count: str) -> DataFrame:
        return old.unionByName(rows).groupBy(*keys).agg(F.sum(count).alias(count)).where(F.col(count) != 0)

    known = before["files"].select("path")
    file_rows = changed.select("path").join(known, "path", "left_anti").select(F.lit("file").alias("fact"), F.lit(1).alias("n")).unionAll(
        gone.select("path").distinct().join(known, "path", "left_semi").select(F.lit("file"), F.lit(-1)))
    kinds = delta.select("fact", F.col("weight").alias("n")).unionAll(file_rows).groupBy("fact").agg(F.sum("n").alias("n"))
    added(before["totals"], kinds, ["fact"], "n").write.parquet(made["totals"])
    calls = delta.where("fact = 'call' AND caller <> '' AND name <> ''")
    edges = calls.groupBy("caller", F.col("name").alias("callee")).agg(F.sum("weight").alias("copies"))
    added(before["edges"], edges, ["caller", "callee"], "copies").write.parquet(made["edges"])

    again = stage_table(_mentions(delta).select("name").distinct())
    # rows of the log that count now and hold one of these names
    log = before["log"].unionByName(new)
    current = _mentions(log.join(files.select("path", "number"), ["path", "number"]))
    names = before["names"].join(again, "name", "left_anti").unionByName(_first_places(current.join(again, "name", "left_semi")))
    names.write.parquet(made["names"])

    parts = [made["log"]]
    if len(numbers) < MAX_UPDATES:
        if versions.current(spark, out, "catalog"):
            parts = [*versions.read(spark, out, "catalog").where("name = 'log'").first().path.split("\n"), made["log"]]
    else:
        whole = f"{out}/log/{number:09d}-{uuid.uuid4().hex[:8]}"
        log.join(files.select("path", "number"), ["path", "number"]).select(*columns, F.lit(number).cast("bigint").alias("number")).write.parquet(whole)
        made["files"] += "-whole"
        files.withColumn("number", F.lit(number).cast("bigint")).write.parquet(made["files"])
        parts = [whole]
    rows = [(name, "\n".join(parts) if name == "log" else path) for name, path in made.items()]
    versions.publish(spark.createDataFrame(rows, "name string, path string"), out, "catalog")
    return tables(spark, out)


def update_from(snapshot: DataFrame, out: str) -> dict[str, DataFrame]:
    """An update to the files of a table (path, language, content): told apart by their digests."""
    spark = snapshot.sparkSession
    known = tables(spark, out)["files"]
    now = snapshot.select("path", "language", "content", F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"),
                          F.length("content").cast("bigint").alias("size"), F.lit(None).cast("timestamp").alias("modified"))
    changed = now.join(known.select("path", "digest"), ["path", "digest"], "left_anti")
    return apply(spark, out, changed.select("path", "language", "content", "digest", "size", "modified"), known.select("path").join(now.select("path"), "path", "left_anti"))


def update(spark: SparkSession, root: str, out: str) -> dict[str, DataFrame]:
    """An update to a folder: files of another size or time are read, those whose digest differs are extracted."""
    known = tables(spark, out)["files"]
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(S._case_glob(e) for e in V.EXTRACT_LANGUAGE) + "}")
    rows = reader.load(root).select(S.relative(F.col("path"), root).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.col("content").alias("bytes"))
    rows = rows.where(S.keep_for_extract(F.col("path")))
    listed = stage_table(rows.select("path", "size", "modified"))
    moved = stage_table(listed.join(known.select("path", "size", "modified"), ["path", "size", "modified"], "left_anti"))
    read = rows.join(moved.select("path"), "path", "left_semi")
    text = S.with_language(S.with_text(read)).where("error = ''").withColumn("digest", F.sha2("content", 256))
    text = text.select("path", "language", "content", "digest").join(moved, "path")
    changed = text.join(known.select("path", "digest"), ["path", "digest"], "left_anti")
    gone = known.select("path").join(listed.select("path"), "path", "left_anti")
    return apply(spark, out, changed.select("path", "language", "content", "digest", "size", "modified"), gone)
