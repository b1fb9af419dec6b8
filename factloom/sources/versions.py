"""Stored tables in versions: written aside, then published by one small row.

``<out>/<name>/<version>`` holds the rows of one version and ``<out>/published/<name>``
a row for each complete one. Readers take the greatest published version and keep
its files, so a run that is killed in the middle of a write, or a new run, takes
nothing from them. Superseded and abandoned versions go by age (``clean``).
"""

from __future__ import annotations

import time
import uuid

from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

_POINTERS = "published"


def store_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and a path in it; Spark also writes ``file:/x`` for ``file:///x``."""
    return pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def _folders(uri: str) -> list[str]:
    store, path = store_of(uri)
    found = store.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return [f.base_name for f in found if f.type == pafs.FileType.Directory]


def publish(df: DataFrame, out: str, name: str, partition_by: str | None = None) -> DataFrame:
    """Writes a new version, makes it the current one, and reads it back."""
    spark = df.sparkSession
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(f"{out}/{name}/{version}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(f"{out}/{_POINTERS}/{name}")
    return spark.read.schema(df.schema).parquet(f"{out}/{name}/{version}")


def current(spark: SparkSession, out: str, name: str) -> str | None:
    """The path of the current version; None if there is none yet."""
    try:
        version = spark.read.schema("version string").parquet(f"{out}/{_POINTERS}/{name}").agg(F.max("version")).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return version and f"{out}/{name}/{version}"


def read(spark: SparkSession, out: str, name: str) -> DataFrame:
    path = current(spark, out, name)
    if path is None:
        raise FileNotFoundError(f"{out}/{name}: nothing published")
    return spark.read.parquet(path)


def clean(spark: SparkSession, out: str, older_than: float) -> list[str]:
    """Deletes versions, published or not, that are no longer current and older than so many seconds; gives their paths."""
    gone, limit = [], time.time_ns() - int(older_than * 1e9)
    for name in _folders(f"{out}/{_POINTERS}"):
        kept = current(spark, out, name)
        for version in _folders(f"{out}/{name}"):
            stamp = version.split("-")[0]
            if f"{out}/{name}/{version}" != kept and stamp.isdigit() and len(stamp) == 20 and int(stamp) < limit:
                store, path = store_of(f"{out}/{name}/{version}")
                store.delete_dir(path)
                gone.append(f"{out}/{name}/{version}")
    return gone
