"""Evidence from bytes: independent re-measurement and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lang import lookup
from ..functions.sniff import (
    ARTIFACT_EXPECTS, INTAKE_EXPECTS, STRIDE_BUDGET, png_dims, sniff, stride_bytes,
)


def notes(*entries: tuple[str, Column, Column]) -> Column:
    """``MAP`` of the ``(key, condition, value)`` entries whose condition holds."""
    items = F.array(
        *[F.when(cond, F.struct(F.lit(key).alias("key"), value.alias("value"))) for key, cond, value in entries]
    )
    return F.map_from_entries(F.filter(items, lambda e: e.isNotNull()))


def measure(content: Column, declared_type: Column) -> Column:
    """Notes the bytes prove by themselves: nothing there, or not what is declared."""
    declared = F.lower(declared_type)
    want = lookup(ARTIFACT_EXPECTS, declared)
    seen = sniff(content)
    return notes(
        ("emptyOutput", F.octet_length(content) == 0, F.lit("measured: no bytes")),
        (
            "magicMismatch",
            (F.octet_length(content) > 0) & (want != seen["type"]),
            F.concat(
                F.lit("declared "), declared, F.lit(', signature "'), seen["magic"],
                F.lit('" (measured)'),
            ),
        ),
    )


def with_measurement(artifacts: DataFrame) -> DataFrame:
    """Add ``measured`` and ``seen``: length and first bytes decide, so every artifact is measured whatever its size."""
    return artifacts.withColumns(
        {"measured": measure(F.col("content"), F.col("declared_type")), "seen": sniff(F.col("content"))}
    )


def success_audit(outcomes: DataFrame) -> DataFrame:
    """What outcomes that claim success ``(success, content, declared_type, errors_found)`` really left behind.

    Adds ``notes``: an empty artifact, bytes that are not what the label says, cells that carry
    an error value. Outcomes that do not claim success, or say nothing about it, get no notes.
    """
    claims = F.coalesce(F.col("success"), F.lit(False))
    cells = F.coalesce(F.col("errors_found"), F.lit(0))
    found = notes(("cellErrors", cells > 0, F.concat(cells.cast("string"), F.lit(" cell(s) with an error value under a success flag"))))
    proved = F.coalesce(measure(F.col("content"), F.col("declared_type")), F.expr("cast(map() as map<string,string>)"))
    return outcomes.withColumn(
        "notes", F.when(claims, F.map_concat(proved, found)).otherwise(F.expr("cast(map() as map<string,string>)"))
    )


def gate(content: Column, want: str) -> Column:
    """NULL if the bytes carry the wanted signature, else ``struct(note, error)``."""
    seen = sniff(F.coalesce(content, F.lit(b"")))
    return F.when(
        seen["type"] != want,
        F.struct(
            F.concat(F.lit('signature "'), seen["magic"], F.lit('"')).alias("note"),
            F.concat(F.lit(f"{want.upper()} wanted, found "), seen["magic"]).alias("error"),
        ),
    )


def output_mismatch(content: Column, out_type: Column) -> Column:
    """Note text when produced bytes do not carry the signature of the produced type."""
    want = lookup(INTAKE_EXPECTS, out_type)
    seen = sniff(content)
    text = F.concat(F.lit("expected "), F.upper(want), F.lit(' magic, got "'), seen["magic"], F.lit('"'))
    return F.when(content.isNotNull() & (want != seen["type"]), text)


def header_audit(images: DataFrame) -> DataFrame:
    """Decode budget from image headers alone: sides, buffer size, inflation, warning."""
    stride = stride_bytes(F.col("dims"))
    size = F.octet_length("content")
    return (
        images.withColumn("dims", png_dims(F.col("content")))
        .withColumn("stride_bytes", stride)
        .withColumn("inflation", F.coalesce(F.try_divide(F.col("stride_bytes"), size), F.lit(0.0)))
        .withColumn("stride_warn", F.coalesce(F.col("stride_bytes") > STRIDE_BUDGET, F.lit(False)))
    )


def knob_effect(outputs: DataFrame) -> DataFrame:
    """Outputs of one artifact at different settings: equal lengths mean the setting did nothing.

    Equal hashes are the stronger finding and are reported beside it. Both sides
    are min/max aggregates, so nothing of a group is held together.
    """
    digest = F.sha2("content", 256)
    size = F.octet_length("content")
    return outputs.groupBy("artifact_id").agg(
        F.count(F.lit(1)).alias("n_settings"),
        (F.min(size) == F.max(size)).alias("same_length"),
        (F.min(digest) == F.max(digest)).alias("same_bytes"),
    )


def archive_totals(entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """Entry and method counts, compressed and inflated totals, their ratio (1 when nothing is stored)."""
    totals = entries.groupBy(key).agg(
        F.count("name").alias("entries"),
        F.count_if(F.col("method") == 0).alias("method0"),
        F.count_if(F.col("method") == 8).alias("method8"),
        F.sum("comp_size").alias("compressed_total"),
        F.sum("size").alias("inflated_total"),
    )
    ratio = F.try_divide(F.col("inflated_total").cast("double"), F.col("compressed_total").cast("double"))
    return totals.withColumn("declared_ratio", F.coalesce(ratio, F.lit(1.0)))


def integrity(entries: DataFrame) -> DataFrame:
    """Does each member match the check sum and size its directory record claims?"""
    return entries.withColumn("crc_ok", F.crc32("data") == F.col("crc")).withColumn(
        "size_ok", F.octet_length("data") == F.col("size")
    )
