"""Spreadsheet cells as a long table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def resolve_shared(cells: DataFrame, strings: DataFrame) -> DataFrame:
    """Cells ``(doc_id, kind, raw)`` with their text; shared indexes looked up by ``(doc_id, idx)``.

    Cells of other kinds need no lookup and go around the join, so they never pile up on one key;
    an index outside the table shows as a broken reference.
    """
    shared = F.col("kind").eqNullSafe("s")
    own = cells.where(~shared).withColumn("value", F.coalesce("raw", F.lit("")))
    keyed = cells.where(shared).withColumn("idx", F.col("raw").try_cast("bigint"))
    found = keyed.join(strings.select("doc_id", "idx", F.col("value").alias("_shared")), ["doc_id", "idx"], "left")
    broken = F.concat(F.lit("#REF!"), F.coalesce(F.col("idx").cast("string"), F.lit("")))
    return own.unionByName(found.withColumn("value", F.coalesce("_shared", broken)).drop("_shared", "idx"))


def sheet_stats(cells: DataFrame) -> DataFrame:
    """Rows, width, error cells and numbers per sheet, from mergeable aggregates."""
    return cells.groupBy("doc_id").agg(
        F.count_distinct("row_idx").alias("n_rows"),
        (F.max("col_idx") + 1).alias("n_cols"),
        F.count_if(F.col("kind") == "e").alias("errors_found"),
        F.count_if(F.col("kind") == "n").alias("numeric_like"),
    )
