"""Facts of new files as they arrive in a folder.

The same extraction as the batch stage, fed by a file stream: files already
processed are not read again, which is what a cached re-run amounts to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom import fixed_values as V
from factloom.operators import extract as X
from factloom.sources import files as S

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def new_files(spark: SparkSession, root: str, extensions: list[str] | None = None, per_batch: int = 10_000) -> DataFrame:
    globs = ",".join(S._case_glob(e) for e in extensions or list(V.EXTRACT_LANGUAGE))
    rows = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*{" + globs + "}").option("maxFilesPerTrigger", per_batch).load(root)
    )
    raw = rows.select(S.relative(F.col("path"), root).alias("path"), F.col("length").alias("size"), F.col("content").alias("bytes"))
    return S.with_language(S.with_text(raw.where(S.keep_for_extract(F.col("path")))))


def follow(spark: SparkSession, root: str, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the facts of all files present, then of each run's new ones.

    A micro-batch writes its own folder, so a repeated batch replaces its rows
    instead of adding them twice.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        X.extract(batch.where("error = ''")).write.mode("overwrite").partitionBy("fact").parquet(f"{out}/batch={batch_id}")

    return (
        new_files(spark, root).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
