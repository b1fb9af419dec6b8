"""Session settings shared by tests, bench and applications."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the plans in this package are written for. All of them
# can be set on a session that somebody else created.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where the split costs one more shuffle later
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # a plan's estimate for rows made from a scan (texts, pieces, facts) is far
    # below their size, so tables are broadcast once they are measured
    "spark.sql.autoBroadcastJoinThreshold": str(64 << 10),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(10 << 20),
    # a method of more bytecode is never compiled by HotSpot: such a stage runs operator by operator, whose code is split into methods
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # source files reach Python workers in batches bounded by bytes, not only
    # by rows: a batch of 10,000 two-megabyte files would be 20 GB
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
}


def build_session(app: str = "factloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return tune(builder.getOrCreate())


# settings that a session may keep as its own
OWN = ("autoBroadcastJoinThreshold", "hugeMethodLimit")


def tune(spark: SparkSession, own_broadcasts: bool = False) -> SparkSession:
    """Apply the runtime settings to an existing session and ship the package.

    ``own_broadcasts`` leaves it to the session which tables are broadcast, and how large compiled stages are.
    """
    for key, value in RUNTIME_CONF.items():
        if own_broadcasts and key.endswith(OWN):
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the Python workers this package, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="factloom-package-")) / "factloom.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for source in sorted(package.rglob("*.py")):
            target.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for ``checkpoint()``: the cluster's own if it names one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="factloom-checkpoint-")
    sc.setCheckpointDir(shared)
    return shared


_staged: list[str] = []


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables staged inside it; whatever is read later has to be stored elsewhere by then."""
    before = len(_staged)
    try:
        yield
    finally:
        from factloom.sources.versions import store_of

        for path in _staged[before:]:
            store, place = store_of(path)
            store.delete_dir(place)
        del _staged[before:]


def stage_table(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Writes the rows once to the shared checkpoint folder and reads them back.

    For results that several later steps use: they read Parquet with pruned
    columns and partitions in place of parsing the sources again, and a lost
    executor costs a re-read, not a re-run of the plan behind it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/factloom-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


# files a task of a CPU-heavy step takes at most: a few seconds of work, the same for a small table and a large one
FILES_PER_TASK = 10_000


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Partitions for a CPU-heavy step: at least one per core.

    Without ``rows`` only a scan of a few unsplittable files is shuffled; larger
    inputs pass through unchanged. With ``rows``, for narrow rows from which
    texts are made later, they are dealt out evenly, so many to a task at most:
    the scan's own partitions follow row groups, and one of them may hold all.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if rows:
        # the count comes from the footers of the files
        return df.repartition(max(cores, -(-df.count() // rows)))
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
