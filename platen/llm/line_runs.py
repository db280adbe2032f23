"""Line dedup with levelled sorted runs of line hashes.

A run is a table of (h1, h2, n): the 128-bit hash of a line's key and the number of documents that
were found to hold it, bucketed and sorted by the hash. A new batch of documents is counted, its
counts are anti-joined with every run (a merge of sorted buckets; the run is not shuffled) to leave
out the lines that are known to be frequent already, and what is left becomes a run of level 0.
``FANOUT`` runs of a level are compacted into one of the next by adding up their counts, so a
batch meets a logarithmic number of runs and a line is rewritten once per level.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .rows import content_key, keep, lower_ascii, pick, shared

BLANKS = " \t\n\x0b\f\r"
HASH = ("h1", "h2")
FANOUT = 4


def lines_of(text: Column) -> Column:
    """The lines of a text, split at line feeds; NULL and the empty text are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """The key of every line: blanks stripped at both ends, A-Z as a-z."""
    return F.transform(lines_of(lower_ascii(text)), lambda line: F.btrim(line, F.lit(BLANKS)))


def _hash(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def document_counts(docs: DataFrame, text_col: str = "text", min_chars: int = 1, by: Column | None = None) -> DataFrame:
    """(h1, h2, n[, batch]): in how many documents each line of at least ``min_chars`` code points is found.

    A line that a document repeats counts once for it. ``by`` is evaluated on ``docs`` and splits the counts.
    """
    part = docs.select(F.col(f"`{text_col}`").alias("text"), *([by.alias("batch")] if by is not None else []))
    names = [c for c in part.columns if c != "text"]
    keys = F.array_distinct(F.filter(line_keys(F.col("text")), lambda k: F.length(k) >= min_chars))
    return part.select(*names, F.explode(keys).alias("key")).select(*names, *_hash(F.col("key"))).groupBy(*names, *HASH).agg(
        F.count(F.lit(1)).alias("n")
    )


class LineRuns:
    """Runs of line counts that grow by batches and tell which lines ``min_docs`` documents share.

    ``add`` takes the counts of one batch. Runs lie in the shared folder and survive lost executors;
    ``close`` removes them.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = "line_runs_" + uuid.uuid4().hex
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, counts: DataFrame, level: int) -> None:
        name = f"{self.name}_{self.made}"
        self.made += 1
        counts.select(*HASH, "n").repartition(self.buckets, *HASH).write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{shared(self.spark)}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _remove(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared(self.spark)}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    @property
    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, counts: DataFrame) -> None:
        """Anti-join the counts of a batch with all runs, add the rest as a run, compact full levels."""
        for name in self.runs:
            full = self.spark.table(name).where(F.col("n") >= self.min_docs).select(*HASH)
            counts = counts.join(full.hint("merge"), list(HASH), "left_anti")
        self._write(counts, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._write(self._merged(old), level + 1)
            for name in old:
                self._remove(name)
            level += 1

    def _merged(self, names: list[str]) -> DataFrame:
        # Read as files: Spark 4.1 takes a union of bucketed scans for bucketed, though it reads them one after the other.
        rows = self.spark.read.schema("h1 long, h2 long, n long").parquet(*[f"{shared(self.spark)}/{name}" for name in names])
        return rows.groupBy(*HASH).agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame:
        """(h1, h2) of the lines that at least ``min_docs`` documents hold, over all batches added so far."""
        return self._merged(self.runs).where(F.col("n") >= self.min_docs).select(*HASH)

    def close(self) -> None:
        for name in self.runs:
            self._remove(name)
        self.levels = []


def drop_lines(docs: DataFrame, frequent: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): every document without the lines in ``frequent``, the rest joined by line feeds.

    Only hashes and places meet the frequent lines, where the runtime splits a line that very many
    documents share; the places come back to the texts in one join.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("key", content_key(F.col("doc_id"), F.col("text")))
    places = rows.select("key", F.posexplode(line_keys(F.col("text"))).alias("place", "line")).select("key", "place", *_hash(F.col("line")))
    gone = places.join(frequent, list(HASH), "left_semi").groupBy("key").agg(F.collect_set("place").alias("gone"))
    lines = lines_of(F.col("text"))
    none = F.array().cast("array<int>")
    found = rows.join(gone, "key", "left").select("doc_id", lines.alias("lines"), F.coalesce("gone", none).alias("gone"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return found.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"),
        F.when(F.size("gone") == 0, F.array_join("lines", "\n")).otherwise(
            F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
        ).alias("kept"),
    )


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 6,
    fanout: int = FANOUT,
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept), one row per row of ``docs``: lines of ``min_docs`` documents or more lose all their places.

    The documents are counted in one scan and added in ``batches`` by a hash of their ids, as a corpus
    would that arrives in parts; the result does not depend on how. Every row is a document of its
    own, repeated rows too. A NULL text is one empty line, a NULL id keeps its row, an empty table
    gives no rows; other columns are ignored. Keys are compared by 128 bits of hash.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_col, text=text_col)
    counts = keep(document_counts(rows, min_chars=min_chars, by=F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")))
    runs = LineRuns(spark, min_docs, fanout)
    for b in range(batches):
        runs.add(counts.where(F.col("batch") == b).select(*HASH, "n"))
    frequent = keep(runs.frequent())
    runs.close()
    return drop_lines(rows, frequent)
