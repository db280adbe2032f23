"""Placed text runs: visual order, stream order and off-page text.

Places on a page come from ranges of the whole table (``ranges.rank_within``), so neither a page nor
a line position is ever one task, however many runs it holds. A run without a coordinate stands after
those that have one, and all orders end with a hash of the text, so a position never depends on how
rows arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranges import rank_within

PAGE = ("doc_id", "page")
# The visible area of a page with a two-point margin.
VISIBLE_X = (-2.0, 614.0)
VISIBLE_Y = (-2.0, 794.0)


def line_of(y: Column) -> Column:
    """Rounded height, half up, negated so that the top of the page comes first."""
    return -F.floor(y + 0.5)


def _last(*columns: str) -> list[Column]:
    return [F.asc_nulls_last(c) for c in columns]


def _visual() -> list[Column]:
    return [F.asc_nulls_last(line_of(F.col("y"))), *_last("x", "seq"), F.xxhash64("text").asc()]


def reading_positions(runs: DataFrame) -> DataFrame:
    """Add ``visual_pos``: top to bottom by rounded height, then left to right, then stream order."""
    return rank_within(runs, PAGE, _visual(), "visual_pos")


def stream_positions(runs: DataFrame) -> DataFrame:
    """Add ``stream_pos``: position by stream sequence."""
    return rank_within(runs, PAGE, [*_last("seq"), F.xxhash64("text").asc()], "stream_pos")


def order_differs(runs: DataFrame) -> DataFrame:
    """Per page: does the visual sequence of texts differ from the stream sequence?

    Texts are replaced by a hash before anything is shuffled; each order is a rank over ranges, and
    what is left is one aggregate per page.
    """
    slim = runs.select(*PAGE, "x", "y", "seq", F.xxhash64("text").alias("text"))
    placed = stream_positions(reading_positions(slim))
    # Equal sequences have equal sums of hash and place, whatever the order of summing.
    mark = lambda place: F.sum(F.xxhash64("text", place).cast("decimal(38,0)"))
    return placed.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n_runs"), (mark("visual_pos") != mark("stream_pos")).alias("order_differs"))


def page_text(positions: DataFrame) -> DataFrame:
    """Text of each page in visual order.

    One value per page is the result asked for, so a page must fit a row;
    ``reading_positions`` is the form for anything larger.
    """
    ordered = F.array_sort(F.collect_list(F.struct("visual_pos", "text")))
    return positions.groupBy(*PAGE).agg(ordered.alias("_runs")).select(
        *PAGE, F.array_join(F.transform("_runs", lambda r: r["text"]), "\n").alias("text")
    )


def is_visible(x: Column, y: Column) -> Column:
    return x.between(*VISIBLE_X) & y.between(*VISIBLE_Y)


def off_page_audit(runs: DataFrame) -> DataFrame:
    """Per document: runs, visible non-blank runs, and the paradox of text no pixel shows."""
    inked = (F.trim(F.col("text")) != "") & is_visible(F.col("x"), F.col("y"))
    return (
        runs.groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("n_runs"), F.count_if(inked).alias("n_visible"))
        .withColumn("ink_paradox", (F.col("n_runs") > 0) & (F.col("n_visible") == 0))
    )
