"""What the operators of this package share: picking columns, row numbers, kept results, components."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SETTING = "spark.checkpoint.dir"
_OWN: dict[str, str] = {}  # folders of local sessions that name none
SPACE = "\\x20\\x09-\\x0D"


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """``new_name="old name"`` columns only, found by exact name whatever else the table holds."""
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"c{names.index(old)}").alias(new) for new, old in wanted.items()])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, or where the table holds one, it with underscores before it: columns that may be added."""
    out = []
    for name in names:
        while name in df.columns or name in out:
            name = f"_{name}"
        out.append(name)
    return out


def numbered(df: DataFrame) -> DataFrame:
    """Add ``row``: tells repeated rows and rows without an id apart within one job."""
    return df.withColumn("row", F.monotonically_increasing_id())


def shared(spark: SparkSession) -> str:
    """The folder that the session names for shared files; only a local session without one gets its own."""
    folder = spark.conf.get(SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        folder = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        _OWN[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Compute once into the shared checkpoint folder and go on from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is; NULL is empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of runs that hold no ASCII white space, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) edges: one row (node, root), root the smallest node.

    Large-star and small-star rounds; every round keeps its pairs in the shared folder and the
    number of rounds grows with the logarithm of the longest chain. Only nodes that have an edge
    appear. Minima are pre-aggregated per task and hubs are split by the runtime's skew handling.
    """
    pairs = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        wide = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        best = wide.groupBy("a").agg(F.min("b").alias("m"))
        near = wide.join(best, "a").select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
        )).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        pairs = keep(near)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = state


def content_key(*parts: Column) -> Column:
    """A key for rows that must be found again in another scan: equal rows have equal keys, NULL is a value."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("v"), F.md5(p.cast("string"))), F.lit("n")) for p in parts]))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to Parquet below the shared folder and read it again."""
    path = f"{shared(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
