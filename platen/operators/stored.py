"""Stored tables that take batches: the newest rows per key, kept by rewriting only what a batch touches.

A table lies in buckets by a hash of its key, one folder each. A batch is first cut down to the newest
rows per key where it is read; then the buckets it touches are read, merged with it, written aside and
put in place by a dynamic partition overwrite. A bucket that no key of the batch falls into is
neither read nor written. Giving a batch again changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import written

BUCKET = "_bucket"


class NewestRows:
    """The ``keep`` newest rows per ``key``, by ``order`` descending, in Parquet files below ``path``.

    With ``keep=1`` a batch upserts; with more, the table is a history with retention. ``order`` should
    end with a column that tells the rows of a key apart. A row with a NULL in its key has the key NULL.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: Sequence[str], order: Sequence[str], keep: int = 1, buckets: int = 64):
        self.spark, self.path, self.key, self.order, self.keep, self.buckets = spark, path, list(key), list(order), keep, buckets
        empty = spark.createDataFrame([], schema)
        self.columns = empty.columns
        self.schema = empty.withColumn(BUCKET, F.lit(0)).schema

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _newest(self, rows: DataFrame) -> DataFrame:
        """A limit per group, which tasks apply before they shuffle; equal rows are one."""
        newest = Window.partitionBy(BUCKET, *self.key).orderBy(*[F.desc_nulls_last(c) for c in self.order], F.xxhash64(*self.columns))
        return rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= self.keep).drop("_n")

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def rows(self) -> DataFrame:
        return self._stored().select(*self.columns)

    def create(self) -> "NewestRows":
        """An empty table, in place of what the folder held."""
        self.spark.createDataFrame([], self.schema).write.mode("overwrite").partitionBy(BUCKET).parquet(self.path)
        return self

    def merge(self, batch: DataFrame) -> int:
        """Take a batch; returns how many buckets were rewritten."""
        new = written(self._distinct(batch.select(*self.columns, self._bucket())), "batch")
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # at most as many as there are buckets
        if not touched:
            return 0
        old = self._stored().where(F.col(BUCKET).isin(touched))
        merged = written(self._distinct(old.unionByName(new)), "merged")
        merged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        return len(touched)

    def _distinct(self, rows: DataFrame) -> DataFrame:
        """Newest rows; a row that batch and table both hold must not count twice."""
        if self.keep == 1:
            return self._newest(rows)
        return self._newest(rows.dropDuplicates([BUCKET, *self.key, *self.order]))
