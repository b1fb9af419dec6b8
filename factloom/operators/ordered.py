"""Order-dependent operators without one task per key.

A window over a key puts all rows of that key into one task, and one key may
hold a third of all rows. The running operators below cut every key into
blocks of consecutive order values, run the window inside the blocks, and carry
the totals of earlier blocks over a second, small window with one row per
block. ``order`` must be an integer column that is close to unique per key; keys
are never null (missing values are empty texts in all fact tables).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 8192


def _blocked(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    aggregate: Callable[[Column], Column],
    out: str,
    block: int,
    before_only: bool,
) -> DataFrame:
    tagged = df.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_value", value)
    totals = tagged.groupBy(*keys, "_block").agg(aggregate(F.col("_value")).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_block", aggregate(F.col("_total")).over(earlier).alias("_carry"))
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1 if before_only else Window.currentRow)
    )
    local = tagged.withColumn("_local", aggregate(F.col("_value")).over(inside))
    # the join keeps the partitioning of the window: only the totals move again
    joined = local.join(carried, [*keys, "_block"], "left")
    return joined.select(*df.columns, "_carry", "_local").withColumn(out, F.lit(None))


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str,
    before_only: bool = False, block: int = BLOCK,
) -> DataFrame:
    """Sum of ``value`` up to and including the row, or of earlier rows only."""
    parts = _blocked(df, keys, order, value, F.sum, out, block, before_only)
    total = F.coalesce(F.col("_carry"), F.lit(0)) + F.coalesce(F.col("_local"), F.lit(0))
    return parts.withColumn(out, total).drop("_carry", "_local")


def running_max(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, block: int = BLOCK
) -> DataFrame:
    """Largest ``value`` up to and including the row; null where there is none yet."""
    parts = _blocked(df, keys, order, value, F.max, out, block, False)
    return parts.withColumn(out, F.greatest("_carry", "_local")).drop("_carry", "_local")


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: str, out: str, block: int = BLOCK
) -> DataFrame:
    """1, 2, 3 ... per key."""
    return running_sum(df, keys, order, F.lit(1), out, block=block)


def chunk(df: DataFrame, keys: Sequence[str], order: str, size: int, out: str, block: int = BLOCK) -> DataFrame:
    """Number the parts of ``size`` rows per key: 1, 2, 3 ..."""
    return row_numbers(df, keys, order, "_rn", block).withColumn(
        out, (F.floor((F.col("_rn") - 1) / size) + 1).cast("bigint")
    ).drop("_rn")


def char_budget(
    df: DataFrame, keys: Sequence[str], order: str, text: str, budget: int, min_rest: int,
    suffix: str = "", block: int = BLOCK,
) -> DataFrame:
    """Texts that fit a budget of characters per key, in order.

    The first text that does not fit is cut to the rest of the budget if more
    than ``min_rest`` characters are left; later ones are dropped, which is
    what the budget means.
    """
    size = F.length(text).cast("bigint")
    used = running_sum(df, keys, order, size, "_before", before_only=True, block=block)
    rest = F.lit(budget) - F.col("_before")
    fits = size <= rest
    cut = F.concat(F.left(F.col(text), rest.cast("int")), F.lit(suffix))
    return (
        used.where(fits | (rest > min_rest))
        .withColumn(text, F.when(fits, F.col(text)).otherwise(cut))
        .drop("_before")
    )


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None, out: str = "rank") -> DataFrame:
    """First ``k`` rows per key, or all of them with their rank.

    Spark limits the groups on the map side (rank filter before the shuffle),
    so a hot key sends at most ``k`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(out, F.row_number().over(window))
    return ranked if k is None else ranked.where(F.col(out) <= k)


def global_rank(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """0, 1, 2 ... over the whole table, sorted by ``order``, in parallel.

    The rows are range-partitioned and written to the checkpoint folder, which
    fixes the partition of every row for good; each partition then only needs
    the row counts of the ones before it.
    """
    ranged = _ranged(df, order)
    counts = ranged.groupBy(F.spark_partition_id().alias("_part")).agg(F.count("*").alias("_rows"))
    return _numbered(ranged, counts, out)


def line_rank(df: DataFrame, order: Sequence[str], text: str, out: str) -> DataFrame:
    """0, 1, 2 ... over the lines of all texts, a row each, in the order of ``order`` and inside the text.

    The texts are sorted whole, so a text of many lines moves as one row.
    """
    ranged = _ranged(df.where(F.col(text).isNotNull()), order)
    rows = F.regexp_count(text, F.lit("\n")) + 1
    counts = ranged.groupBy(F.spark_partition_id().alias("_part")).agg(F.sum(rows).alias("_rows"))
    others = [c for c in df.columns if c != text]
    return _numbered(ranged.select(*others, F.explode(F.split(text, "\n")).alias(text)).select(*df.columns), counts, out)


def _ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    from factloom.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()


def _numbered(df: DataFrame, counts: DataFrame, out: str) -> DataFrame:
    """Numbers rows made from stored ones, which keep their partition and place; ``counts`` are those of the partitions."""
    placed = df.withColumn("_at", F.monotonically_increasing_id())
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per partition of the table: as many rows as there are tasks
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    numbered = placed.join(F.broadcast(offsets), part == F.col("_part"))
    return numbered.select(*df.columns, (F.col("_offset") + place).cast("bigint").alias(out))
