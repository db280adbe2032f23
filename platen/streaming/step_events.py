"""The step-event feed: start, end and error events appended to the step log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import shared_folder


def read_events(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Event files as a stream; a folder or a glob."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def drain(events: DataFrame, out: str, checkpoint: str) -> None:
    """Append everything available to ``out`` and stop.

    Each micro-batch replaces its own partition, so a batch repeated after a
    lost executor or a restart does not write its rows twice. The feed is
    append-only and stateless: order comes from ``(run_id, step)``, no watermark
    is needed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def step_log_feed(spark: SparkSession, path: str, schema: T.StructType, transform, home: str | None = None) -> DataFrame:
    """Drain the event files through ``transform`` into a step log below ``home``, and read it back.

    Without ``home`` a new folder below the shared one is used; like other checkpoints it stays
    until that folder is cleared, since the result reads from it.
    """
    home = home or f"{shared_folder(spark)}/step-log-{uuid.uuid4().hex}"
    drain(transform(read_events(spark, path, schema)), f"{home}/log", f"{home}/checkpoint")
    return spark.read.parquet(f"{home}/log").drop("batch")


def phase_events(events: DataFrame) -> DataFrame:
    """Raw events to step events: an error type ends the step as failed, views start it, the rest end it."""
    phase = (
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "start").otherwise("end")
    )
    return events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("step"),
        phase.alias("phase"),
        F.when(phase != "start", F.floor(F.col("value") * 100)).cast("bigint").alias("bytes"),
        F.when(phase == "error", F.get_json_object("props", "$.k")).alias("note"),
    )
