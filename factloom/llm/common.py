"""What the operators of this folder share: reading tables, staging, Arrow batches."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import ensure_checkpoint_dir, ship_package, stage_table

# bounds on one Arrow batch in a Python worker: rows and bytes
BATCH_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}
FLUSH_BYTES = 8 << 20
FLUSH_ROWS = 50_000


def prepare(spark: SparkSession) -> SparkSession:
    """Ships the package to the workers and bounds the Arrow batches."""
    ship_package(spark)
    for key, value in BATCH_CONF.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Writes the rows once to the cluster's shared folder and reads them back."""
    return stage_table(df, partition_by)


def shared_folder(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark).rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """The name of a new folder in the cluster's shared one, as a URI that workers can open."""
    root = shared_folder(prepare(spark))
    return f"{root if '://' in root or root.startswith('/') else root.replace('file:', '', 1)}/factloom-{kind}-{uuid.uuid4().hex}"


def drop_caches() -> None:
    """Frees the word cache that earlier tasks left in a reused worker; for tasks that need no tokenizer."""
    tokens = sys.modules.get("factloom.llm.tokens")
    if tokens is not None:
        tokens.encoder.cache_clear()


def fresh(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` in a worker without the caches of others."""
    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        return run(batches)

    return alone


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where a lambda uses it."""
    return F.transform(F.array(value), body)[0]


def own_shuffle(df: DataFrame, key: str) -> DataFrame:
    """Re-keys an aggregate by a bigint ``key`` it is grouped by.

    A join on that key would use the aggregate's own shuffle, which adaptive
    execution can't split; so both sides are shuffled for the join, and a hot key
    of the other side is dealt over several tasks.
    """
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("bigint")))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def values(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows of a batch, one at a time, so that only one text is a Python object."""
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in columns)


class Rows:
    """Collects output rows and gives a batch whenever enough bytes or rows are there."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: tuple, size: int = 0) -> None:
        self.rows.append(row)
        self.bytes += size

    def full(self) -> bool:
        return self.bytes >= FLUSH_BYTES or len(self.rows) >= FLUSH_ROWS

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[] for _ in self.schema]
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, self.schema, strict=True)], schema=self.schema)
