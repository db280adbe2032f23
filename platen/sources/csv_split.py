"""CSV files of any size, read in parallel although quoted fields may hold line ends.

Whether a byte range begins inside quotes is known only once all ranges before it are read. So every
range is scanned under both assumptions: a line keeps the parity of the quotes before it in its range
and the place where its record would begin if the range began outside, and if it began inside. Ranges
are summed up in one row each; a running sum of their quote parities tells how each of them really
began, and the place of the last open record is handed on. Then a line knows its record:

* a record of one line is parsed where it was read,
* only the lines of records that span lines are brought together, by the place of the first one.

The ranges are those of Spark's text reader (``spark.sql.files.maxPartitionBytes``), so any file
system works and a single file uses all cores.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.tabular import parse_csv
from ..session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGES_TO_BROADCAST = 100_000  # rows of a file name and four numbers; more are joined by a shuffle
_RANGE = "file string, block long, "
_LINE = _RANGE + "pos long, odd boolean, inside boolean, start_out long, start_in long, line string"
_SUMMARY = _RANGE + "odd boolean, start_out long, start_in long"


class _Scan:
    """The state of one range: parity of quotes and places of record starts, under both assumptions."""

    def __init__(self):
        self.pos, self.parity, self.starts = 0, 0, [-1, -1]

    def lines(self, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Place, parity before, and start of the record of each line, assuming the range began outside or inside."""
        pos = np.arange(self.pos, self.pos + len(odd))
        after = (self.parity + np.cumsum(odd)) % 2
        before = np.concatenate([[self.parity], after[:-1]])
        starts = []
        for assumed in (0, 1):
            at = np.where(before == assumed, pos, -1)
            at[0] = max(at[0], self.starts[assumed])
            starts.append(np.maximum.accumulate(at))
        self.pos, self.parity, self.starts = self.pos + len(odd), int(after[-1]), [int(s[-1]) for s in starts]
        return pos, before, starts


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The parts of a batch that belong to one range; lines arrive in file order."""
    files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
    at = 0
    for i in range(1, batch.num_rows + 1):
        if i == batch.num_rows or files[i] != files[at] or blocks[i] != blocks[at]:
            yield (files[at], blocks[at]), batch.slice(at, i - at)
            at = i


def _odd(lines: pa.Array) -> np.ndarray:
    return pc.count_substring(lines, '"').to_numpy(zero_copy_only=False) % 2


def _scan_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, scan = None, _Scan()
    for batch in batches:
        for found, part in _stretches(batch) if batch.num_rows else ():
            if found != key:
                key, scan = found, _Scan()
            odd = _odd(part.column("line"))
            pos, before, starts = scan.lines(odd)
            columns = [part.column("file"), part.column("block"), pa.array(pos), pa.array(odd == 1), pa.array(before == 1), *map(pa.array, starts), part.column("line")]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "pos", "odd", "inside", "start_out", "start_in", "line"])


def _scan_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, scan = None, _Scan()

    def row():
        values = [[key[0]], [key[1]], [scan.parity == 1], [scan.starts[0]], [scan.starts[1]]]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["file", "block", "odd", "start_out", "start_in"])

    for batch in batches:
        for found, part in _stretches(batch) if batch.num_rows else ():
            if found != key:
                if key is not None:
                    yield row()
                key, scan = found, _Scan()
            scan.lines(_odd(part.column("line")))
    if key is not None:
        yield row()


def _begun(ranges: DataFrame) -> DataFrame:
    """(file, block, inside, open_block, open_pos): how each range began, and the record still open before it."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    began = ranges.withColumn("began_inside", F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1)
    own = F.when(F.col("began_inside"), F.col("start_in")).otherwise(F.col("start_out"))
    last = F.last(F.when(own >= 0, F.struct(F.col("block").alias("b"), own.alias("p"))), ignorenulls=True).over(before)
    return began.withColumn("_last", last).select(
        F.col("file").alias("_file"), F.col("block").alias("_block"), "began_inside",
        F.col("_last.b").alias("open_block"), F.col("_last.p").alias("open_pos"),
    )


def _kept(ranges: DataFrame) -> DataFrame:
    """Written to the shared folder, so that the files are not summed up again, and broadcast if the rows are few."""
    kept = written(ranges, "csv-ranges")
    return F.broadcast(kept) if kept.count() <= RANGES_TO_BROADCAST else kept


def csv_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, block, pos, record): the records of CSV files as text, in order of file, block and pos.

    ``block`` is the offset of the byte range in which a record begins and ``pos`` the line in it. Lines
    end at LF or CRLF; CR alone ends rows inside a record, see ``csv_rows``. A quote that is never
    closed makes the rest of its file one record, as with any reader of the format.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.make_valid_utf8("value").alias("line")
    )
    ranges = _kept(_begun(lines.mapInArrow(_scan_ranges, _SUMMARY)))
    scanned = lines.mapInArrow(_scan_lines, _LINE).join(ranges, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")), "left")
    # Both scans must be cut alike; should a cluster that grows meanwhile cut them otherwise, that is an error.
    cut = F.when(F.col("_file").isNull(), F.raise_error(F.lit("byte ranges changed between two scans, read again")).cast("boolean"))
    scanned = scanned.withColumn("began_inside", F.coalesce("began_inside", cut))
    inside = F.col("inside") != F.col("began_inside")
    own = F.when(F.col("began_inside"), F.col("start_in")).otherwise(F.col("start_out"))
    placed = scanned.select(
        "file", "block", "pos", "line", (~inside & ~F.col("odd")).alias("whole"),
        F.when(own >= 0, F.col("block")).otherwise(F.col("open_block")).alias("at_block"),
        F.when(own >= 0, own).otherwise(F.col("open_pos")).alias("at_pos"),
    )
    single = placed.where("whole").select("file", "block", "pos", F.col("line").alias("record"))
    several = placed.where("not whole").groupBy("file", "at_block", "at_pos").agg(
        F.array_sort(F.collect_list(F.struct("block", "pos", "line"))).alias("parts")
    ).select(
        "file", F.col("at_block").alias("block"), F.col("at_pos").alias("pos"),
        F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("record"),
    )
    rows = single.union(several)
    first = (F.col("block") == 0) & (F.col("pos") == 0)
    return rows.withColumn("record", F.when(first, F.regexp_replace("record", "^\ufeff", "")).otherwise(F.col("record")))


def csv_rows(records: DataFrame) -> DataFrame:
    """(file, block, pos, part, cells): the rows of records; ``part`` counts rows that end at a CR alone.

    Cells follow ``functions.tabular.parse_csv``: quotes may open anywhere in a field, a row that is one
    blank field is dropped.
    """
    ended = F.regexp_replace("record", "\r\\z", "")
    return records.select("file", "block", "pos", F.posexplode(parse_csv(ended)).alias("part", "cells"))


def _header(text: DataFrame) -> list[str]:
    """Cells of the record on the first line of a file, read from its head."""
    n = 1
    while True:
        lines = [r[0] for r in text.take(n)]
        done = next((i + 1 for i in range(len(lines)) if sum(x.count('"') for x in lines[: i + 1]) % 2 == 0), None)
        if done or len(lines) < n:
            break
        n *= 10
    record = "\n".join(lines[:done]).removeprefix("\ufeff").removesuffix("\r")
    rows = text.sparkSession.createDataFrame([(record,)], "record string").select(parse_csv(F.col("record")).alias("r")).first()[0]
    if not rows:
        raise ValueError("the first line holds no header")
    return rows[0]


def scan_csv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """CSV files as a table of strings, one row per row of the files.

    With ``columns`` the files hold rows only. Without, the first line of each file begins a header, and
    that of the first file names the columns. Missing cells are NULL and further ones are left out; empty
    cells are NULL, quoted or not. An empty file without ``columns`` is an error.
    """
    rows = csv_rows(csv_records(spark, path))
    if columns is None:
        text = spark.read.option("lineSep", "\n")
        columns = _header(text.text(min(text.text(path).inputFiles())))
        rows = rows.where(~((F.col("block") == 0) & (F.col("pos") == 0) & (F.col("part") == 0)))

    def cell(i: int) -> Column:
        return F.nullif(F.get("cells", F.lit(i)), F.lit(""))

    return rows.select(*[cell(i).alias(name) for i, name in enumerate(columns)])
