"""Places in an order over all rows, whatever share of them a group holds.

Rows are dealt into sorted ranges and written; a small table counts the rows of each group in each
range, and its running sums shift the places inside a range. A group that holds a third of all rows
lies in a third of the ranges; no window and no task ever holds a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """Add ``out``, the 0-based place of every row among those of equal ``keys``, by ``order``.

    NULL is a key like any other. Rows that ``order`` does not tell apart get places in the order in
    which they were read, so they need not share a range. Names that begin with ``_rank_`` are taken.
    """
    marks = [F.asc_nulls_first(k) for k in keys]
    salted = df.withColumn("_rank_salt", F.monotonically_increasing_id())
    ranges = salted.repartitionByRange(*marks, *order, "_rank_salt").sortWithinPartitions(*marks, *order, "_rank_salt").drop("_rank_salt")
    rows = written(ranges.withColumns({"_rank_range": F.spark_partition_id(), "_rank_at": F.monotonically_increasing_id()}), "ranges")
    runs = rows.groupBy("_rank_range", *keys).agg(F.count(F.lit(1)).alias("_rank_n"), F.min("_rank_at").alias("_rank_first"))
    before = Window.partitionBy(*keys).orderBy("_rank_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_rank_n").over(before), F.lit(0)) - F.col("_rank_first")
    shifts = runs.select(
        F.col("_rank_range").alias("_rank_r"), *[F.col(k).alias(f"_rank_k{i}") for i, k in enumerate(keys)], shift.alias("_rank_shift")
    )
    same = F.col("_rank_range") == F.col("_rank_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_rank_k{i}"))
    return rows.join(shifts, same).select(*df.columns, (F.col("_rank_at") + F.col("_rank_shift")).alias(out))
