"""Merkle manifest of a dataset: a tree per source, a tree over the sources, and a climb per leaf.

Leaves are hashed where they are read; from then on only digests move. Rows are numbered by
sorted ranges, so no source is ever sorted in one task. The tree is built in blocks of ``HEIGHT``
levels: a stored node row stands for the top of a block, carries the digests of its levels and is
linked to the block above it, down to the single root. A recursive query then ascends per leaf: it
joins the leaf's block, folds the (tampered) digest with its siblings, appends the siblings to the
proof and goes on at the parent. The leaves of a lowest block are a lane, and upper blocks are stored
in as many copies as they may have lanes below them, up to ``COPIES``; a lane goes to one copy by its
hash. So the leaves of a hot source, and all leaves at the root, do not meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .rows import keep, pick

ARITY = 3  # the template below cuts runs of this many nodes
HEIGHT = 6  # levels of a block
FAN = ARITY**HEIGHT
COPIES = 4096
TOP = -1  # the tree over the sources
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the joined strings."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for NULL, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _text(column: str) -> Column:
    return F.lower(F.hex(column))


def leaves(docs: DataFrame, columns: Sequence[str] = FIELDS) -> DataFrame:
    """(doc_id, source, leaf, tampered): digests of every row as bytes; ``tampered`` only where the row was changed.

    Rows whose decimal id has an even CRC-32 lose the line ends of their text; a NULL id or a NULL
    text is never changed.
    """
    rows = pick(docs, **dict(zip(FIELDS, columns)))
    plain = [field(F.col(c)) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = digest(*plain[:-1], field(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    return rows.select(
        "doc_id", "source", F.unhex(digest(*plain)).alias("leaf"), F.when(hit & F.col("text").isNotNull(), F.unhex(changed)).alias("tampered")
    )


def ranked(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Kept rows with ``pid`` and ``pos``: sorted ranges and the place inside, which together follow ``order``.

    Equal rows are told apart by where they were read, so they need not share a range.
    """
    salt = F.monotonically_increasing_id()
    ranges = df.withColumn("_salt", salt).repartitionByRange(*order, "_salt").sortWithinPartitions(*order, "_salt").drop("_salt")
    return keep(ranges.select("*", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("pos")))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def numbered_leaves(hashed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with (tree, at, n): number of their source, place in it by id, rows of the source; and the sources.

    Both come from one small table of runs, a row per range and source in it.
    """
    rows = ranked(hashed, ("source", "doc_id", "leaf"))
    runs = keep(rows.groupBy("pid", "source").agg(F.count(F.lit(1)).alias("n_run"), F.min("pos").alias("first")))
    sources = ranked(runs.groupBy("source").agg(F.sum("n_run").alias("n")), ("source",))
    before = sources.groupBy("pid").agg(F.count(F.lit(1)).alias("n_in"), F.min("pos").alias("first")).withColumn(
        "offset", F.coalesce(F.sum("n_in").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )  # a row per range
    trees = keep(
        sources.join(before.select("pid", "first", "offset"), "pid")
        .select("source", "n", (F.col("offset") + F.col("pos") - F.col("first")).alias("tree"))
    )
    earlier = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("offset", F.coalesce(F.sum("n_run").over(earlier), F.lit(0)) - F.col("first"))
    known = placed.join(trees.withColumnRenamed("source", "_s"), _same("source", "_s")).select(
        F.col("pid").alias("_pid"), F.col("source").alias("_source"), "offset", "tree", "n"
    )
    out = rows.join(known, (F.col("pid") == F.col("_pid")) & _same("source", "_source")).select(
        "doc_id", "leaf", "tampered", "tree", (F.col("offset") + F.col("pos")).alias("at"), "n"
    )
    return out, trees


def _parents(level: Column) -> Column:
    """Digests of the runs of a level."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: F.unhex(digest(*[
        F.coalesce(F.lower(F.hex(F.get(level, i * ARITY + k))), F.lit("")) for k in range(ARITY)
    ])))


def _rise(n: Column) -> Column:
    """How many nodes stand ``HEIGHT`` levels above n."""
    return F.ceil(n / FAN)


def _block(nodes: DataFrame) -> DataFrame:
    """Blocks over (tree, at, hash, n): a row (tree, block, n, levels, top), at most ``FAN`` nodes each.

    ``levels`` are those below ``top``. A level is left out once the whole tree is down to one node.
    """
    group = nodes.groupBy("tree", F.floor(F.col("at") / FAN).alias("block"), "n").agg(
        F.array_sort(F.collect_list(F.struct("at", "hash"))).alias("_members")
    )
    df = group.withColumn("_0", F.transform("_members", lambda m: m["hash"])).drop("_members")
    left = F.col("n")
    for k in range(1, HEIGHT + 1):
        last = F.col(f"_{k - 1}")
        df = df.withColumn(f"_{k}", F.when(left > 1, _parents(last)).otherwise(F.array().cast("array<binary>")))
        left = F.ceil(left / ARITY)
    levels = F.filter(F.array(*[F.col(f"_{k}") for k in range(HEIGHT + 1)]), lambda x: F.size(x) > 0)
    out = df.select("tree", "block", "n", levels.alias("_all"))
    return out.select(
        "tree", "block", "n", F.slice("_all", F.lit(1), F.size("_all") - 1).alias("levels"), F.element_at(F.element_at("_all", -1), 1).alias("top")
    )


def _lanes(story: int) -> int:
    """Copies of a block of this story: as many as it may have lanes below while these are few."""
    return min(FAN**story, COPIES)


def _stories(nodes: DataFrame, largest: int, tree_over: bool) -> list[DataFrame]:
    """Blocks of all stories of the given trees, linked upwards within their tree; a tree of one node has none."""
    out, story = [], 0
    level = nodes.where("n > 1")
    while largest > 1:
        blocks = keep(_block(level))
        ends = _rise(F.col("n")) == 1
        out.append(blocks.select(
            "tree", F.lit(story).alias("story"), "block", "levels", "top", ends.alias("ends"),
            F.when(~ends, F.floor(F.col("block") / FAN)).alias("up_block"),
            F.when(~ends, (F.col("block") % FAN).cast("int")).alias("up_place"),
            F.lit(COPIES if tree_over else _lanes(story)).alias("lanes"),
            F.lit(COPIES if tree_over else _lanes(story + 1)).alias("up_lanes"),
        ))
        level = blocks.select("tree", F.col("block").alias("at"), F.col("top").alias("hash"), _rise(F.col("n")).alias("n")).where("n > 1")
        largest, story = -(-largest // FAN), story + 1
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def build(numbered: DataFrame, trees: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Stored node rows (None where one leaf is all), and the sources with their subroot.

    A node row: (tree, story, block), ``levels`` of digests, ``top``, and the link upwards
    (up_tree, up_story, up_block, up_place), NULL at the root. The end of a source's tree is
    linked to the tree over the sources, where its place is the number of the source.
    """
    found = trees.agg(F.max("n"), F.count(F.lit(1))).first()
    largest, n_trees = found[0] or 0, found[1]
    own = _stories(numbered.select("tree", "at", F.col("leaf").alias("hash"), "n"), largest, False)
    lone = numbered.where("n = 1").select("tree", F.col("leaf").alias("top"))
    roots = keep(_union([lone, *[s.where("ends").select("tree", "top") for s in own]]))
    subroots = trees.join(roots.withColumnRenamed("tree", "_t"), F.col("tree") == F.col("_t")).select("tree", "n", "top")
    above = roots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("at"), F.col("top").alias("hash"), F.lit(n_trees).cast("long").alias("n"))
    over = _stories(above, n_trees, True)
    several = n_trees > 1
    rows = []
    for s in own:
        cross = F.col("ends") & F.lit(several)
        rows.append(s.select(
            "tree", "story", "block", "levels", "top", "ends", "lanes",
            F.when(~F.col("ends"), F.col("tree")).when(cross, F.lit(TOP).cast("long")).alias("up_tree"),
            F.when(~F.col("ends"), F.col("story") + 1).when(cross, F.lit(0)).alias("up_story"),
            F.when(~F.col("ends"), F.col("up_block")).when(cross, F.floor(F.col("tree") / FAN)).alias("up_block"),
            F.when(~F.col("ends"), F.col("up_place")).when(cross, (F.col("tree") % FAN).cast("int")).alias("up_place"),
            F.when(~F.col("ends"), F.col("up_lanes")).when(cross, F.lit(COPIES)).alias("up_lanes"),
        ))
    for s in over:
        rows.append(s.select(
            "tree", "story", "block", "levels", "top", F.lit(False).alias("ends"), "lanes",
            F.when(~F.col("ends"), F.col("tree")).alias("up_tree"), F.when(~F.col("ends"), F.col("story") + 1).alias("up_story"),
            "up_block", "up_place", F.when(~F.col("ends"), F.col("up_lanes")).alias("up_lanes"),
        ))
    return (_union(rows) if rows else None), subroots


# One level: the digest of the run, and the siblings beside the place; ``s`` is (place, folded, proof).
_FOLD = f"""aggregate(levels, named_struct('place', place, 'folded', folded, 'proof', proof),
  (s, level) -> named_struct(
    'place', CAST(floor(s.place / {ARITY}) AS INT),
    'folded', unhex(sha2(CAST(array_join(transform(slice(level, CAST(floor(s.place / {ARITY}) AS INT) * {ARITY} + 1, {ARITY}),
        (x, i) -> lower(hex(CASE WHEN i = s.place % {ARITY} THEN s.folded ELSE x END))), '') AS BINARY), 256)),
    'proof', aggregate(transform(slice(level, CAST(floor(s.place / {ARITY}) AS INT) * {ARITY} + 1, {ARITY}),
        (x, i) -> CASE WHEN i = s.place % {ARITY} THEN X'' ELSE x END), s.proof, (p, x) -> concat(p, x))))"""

_CLIMB = f"""
WITH RECURSIVE climb AS (
  SELECT doc_id, leaf, lane, tree, story, block, place, lanes, folded, proof, subroot, root FROM {{leaves}}
  UNION ALL
  SELECT doc_id, leaf, lane, up_tree, up_story, up_block, up_place, up_lanes, s.folded, s.proof, subroot, root
  FROM (
    SELECT c.doc_id, c.leaf, c.lane, n.up_tree, n.up_story, n.up_block, n.up_place, n.up_lanes, {_FOLD} AS s,
           CASE WHEN n.ends THEN n.top ELSE c.subroot END AS subroot, CASE WHEN n.up_tree IS NULL THEN n.top END AS root
    FROM climb c JOIN {{nodes}} n
      ON c.tree = n.at_tree AND c.story = n.at_story AND c.block = n.at_block AND c.lane % c.lanes = n.copy
  )
)
SELECT doc_id, leaf, subroot, root, unhex(sha2(CAST(lower(hex(proof)) AS BINARY), 256)) AS proof_digest, folded
FROM climb WHERE tree IS NULL
"""


@contextmanager
def _settings(spark: SparkSession):
    """For the time of the jobs: recursive queries of any number of rows, and no splitting of uneven joins at run time.

    Joins are even as they stand: by range, or by lanes of leaves. Splitting them once more only multiplies tasks.
    """
    wanted = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.adaptive.skewJoin.enabled": "false"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def climb(numbered: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_digest, folded) per leaf, digests as bytes; a proof is the joined siblings, leaf to root.

    A leaf that is the whole tree of its source begins at its place in the tree over the sources.
    """
    nothing = F.lit(b"")
    begun = F.coalesce("tampered", "leaf").alias("folded")
    if nodes is None:
        return numbered.select(
            "doc_id", "leaf", F.col("leaf").alias("subroot"), F.col("leaf").alias("root"), F.unhex(F.sha2(nothing, 256)).alias("proof_digest"), begun
        )
    spark = numbered.sparkSession
    lone = F.col("n") == 1
    start = numbered.select(
        "doc_id", "leaf", F.pmod(F.xxhash64("tree", F.floor(F.col("at") / FAN)), F.lit(1 << 30)).alias("lane"),
        F.when(lone, F.lit(TOP).cast("long")).otherwise(F.col("tree")).alias("tree"), F.lit(0).alias("story"),
        F.floor(F.when(lone, F.col("tree")).otherwise(F.col("at")) / FAN).alias("block"),
        (F.when(lone, F.col("tree")).otherwise(F.col("at")) % FAN).cast("int").alias("place"),
        F.when(lone, F.lit(COPIES)).otherwise(F.lit(1)).alias("lanes"),
        begun, nothing.alias("proof"), F.when(lone, F.col("leaf")).alias("subroot"), F.lit(None).cast("binary").alias("root"),
    )
    copies = keep(nodes.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lanes").cast("long") - 1))).select(
        F.col("tree").alias("at_tree"), F.col("story").alias("at_story"), F.col("block").alias("at_block"), "copy",
        "levels", "top", "ends", "up_tree", "up_story", "up_block", "up_place", "up_lanes",
    ))
    return keep(spark.sql(_CLIMB, leaves=start, nodes=copies))


def manifest(docs: DataFrame, columns: Sequence[str] = FIELDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``columns`` names the id, source, language, size and text columns; others are ignored. NULL
    fields hash as ``-``; a NULL source is a source, the first one; NULL ids come first in their
    source and equal ids are ordered by their leaf. Repeated rows are leaves of their own. The
    tree of a source of one leaf is that leaf, a run of one node still becomes its digest, and an
    empty proof is the digest of nothing. An empty table gives no rows.
    """
    with _settings(docs.sparkSession):
        numbered, trees = numbered_leaves(leaves(docs, columns))
        numbered = keep(numbered)
        nodes, _ = build(numbered, trees)
        climbed = climb(numbered, nodes)
    return climbed.select(
        "doc_id", *[_text(c).alias(c) for c in ("leaf", "subroot", "root")], _text("proof_digest").alias("proof_sha256"),
        _text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
