"""Places in a sorted order without sorting a pool in one task.

Rows are dealt to tasks by ranges of the whole sort key, ties included, sorted
there, and kept in the shared folder with their place in the task; a
row's place is that plus the rows of its pool in the ranges before. The ranges
are sampled from the whole key, so that neither a large pool nor many rows of one score
meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.sources.staging import staged

RANGED = "ranged"
_ROWS = 33  # bits of a running id that count the rows of a task


def ranged(df: DataFrame, pools: list[str], order: list[Column]) -> DataFrame:
    """The rows in ranges of (pool, order), staged, with ``__at``: the task, and the place in it."""
    keys = [*map(F.col, pools), *order]
    return staged(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), RANGED)


def placed(df: DataFrame, pools: list[str], order: list[Column]) -> DataFrame:
    """Adds ``place``, from 1, and ``of``, the rows, within each pool; null is a pool of its own. ``df`` is read once."""
    rows = ranged(df, pools, order).withColumn("__task", F.shiftright("__at", _ROWS))
    counts = rows.groupBy(*pools, "__task").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    pool = Window.partitionBy(*pools)
    before = F.sum("__n").over(pool.orderBy("__task")) - F.col("__n")
    counts = counts.select(*[F.col(p).alias(f"__{p}") for p in pools], F.col("__task").alias("__of_task"), "__first", before.alias("__before"), F.sum("__n").over(pool).alias("of"))
    same = F.col("__task") == F.col("__of_task")
    for p in pools:
        same = same & F.col(p).eqNullSafe(F.col(f"__{p}"))
    place = F.col("__before") + F.col("__at") - F.col("__first") + 1
    return rows.join(counts, same).select(*[rows[c] for c in df.columns], place.alias("place"), "of")


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` up to each row of its key, in the order; null counts as zero, and rows that tie in the order each have their own place.

    Prefix sums of two levels: ranges of (key, order) have their sums, and each
    row adds what stands before it in its range, so that a key with most of
    the rows spreads over as many tasks as it has ranges.
    """
    rows = ranged(df, keys, order).withColumns({"__task": F.shiftright("__at", _ROWS), "__value": F.coalesce(F.col(value), F.lit(0))})
    block = Window.partitionBy(*keys, "__task")
    sums = rows.groupBy(*keys, "__task").agg(F.sum("__value").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__task")) - F.col("__sum")
    sums = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__task").alias("__of_task"), before.alias("__before"))
    inside = rows.withColumn("__inside", F.sum("__value").over(block.orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)))
    same = F.col("__task") == F.col("__of_task")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return inside.join(sums, same).select(*[inside[c] for c in df.columns], (F.col("__before") + F.col("__inside")).alias(name))
