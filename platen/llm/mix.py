"""Mixing sources to target weights by Pareto order sampling.

Every source has a target number of words: its weight's share of all words, but at most ``limit``
times its own, the excess going to the others by weight. A source takes every document the same
whole number of times for certain (target / size, rounded down); the rest of its target is a
sample in which documents are included with the remaining fraction as probability, which differs
from source to source. Documents are ranked by random odds over inclusion odds, and the sample is
the head of that order, its size fixed in words: whole documents up to the first that does not fit,
then whichever of all later documents in order still fit, and one more where that comes nearer.

The head is found without sorting a source: ranks fall into ``buckets`` equal ranges, sums per
range are pre-aggregated, and only the range that holds the limit, with the next ``fill_from``
documents, is looked at row by row. What fits of the rest is found in rounds of the same kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .rows import content_key, fresh, keep, numbered, pick, word_count


def water_fill(sources: DataFrame, weights: tuple[int, ...], limit: float) -> DataFrame:
    """Targets for (source, source_size): one row per source, so one small task orders them all."""
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    w = F.get(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights))
    everything = Window.partitionBy(F.lit(1))
    # Sources fill up in the order of cap / weight; from some point on none of the rest is above.
    fill = everything.orderBy("ratio", F.asc_nulls_last("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    return (
        sources.withColumn("w", w.cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(float(limit)))
        .withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("level", left / weight)
        .withColumn("place", F.row_number().over(fill))
        .withColumn(
            "level",
            F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("place"))).over(everything),
        )
        .select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))
    )


def uniform(*parts: Column) -> Column:
    """A number strictly between 0 and 1 that depends on the parts alone."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def _fill(left: Column, rest: Column) -> Column:
    """Places of those documents of ``rest`` (in order) that still fit into ``left`` words (``taken``), and what is ``left`` then."""
    start = F.struct(left.alias("left"), F.array().cast("array<int>").alias("taken"))
    step = lambda s, d: F.when(
        (d["size"] > 0) & (d["size"] <= s["left"]),
        F.struct((s["left"] - d["size"]).alias("left"), F.array_append(s["taken"], d["rn"]).alias("taken")),
    ).otherwise(s)
    return F.aggregate(rest, start, step)


SALTS = 64
PART = 1000  # rows


def _by_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Left join of rows with the one row of their source (``s``): each source is cut by row, so no task gets a whole one."""
    salted = per_source.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.pmod(F.xxhash64("row"), F.lit(SALTS)) == F.col("_salt"))
    return rows.join(salted, same, "left").drop("s", "_salt")


def _order() -> Window:
    return Window.partitionBy("source").orderBy("v", F.asc_nulls_last("doc_id"), "size", "row")


def _head(rows: DataFrame, room: Column) -> DataFrame:
    """The rows of every source, in order, that fit into its ``room`` (a column of ``rows``) before the first that does not."""
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first(room).alias("room"))
    along = Window.partitionBy("source").orderBy("bucket")
    over = F.col("after") > F.col("room")
    edges = keep(
        sums.withColumn("after", F.sum("words").over(along)).groupBy(F.col("source").alias("s"))
        .agg(F.min(F.when(over, F.col("bucket"))).alias("edge"), F.coalesce(F.max(F.when(~over, F.col("after"))), F.lit(0)).alias("sure"))
    )
    placed = _by_source(rows, edges)
    order = _order().rowsBetween(Window.unboundedPreceding, 0)
    last = placed.where("bucket = edge").withColumn("upto", F.sum("size").over(order)).where(F.col("sure") + F.col("upto") <= room)
    return placed.where("edge is null or bucket < edge").select("source", "row", "size").union(last.select("source", "row", "size"))


def _fill_on(rows: DataFrame, state: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """The rows (``row``) of ``rows`` that go on filling the rooms of ``state`` (s, left) in order, and the rooms then.

    Of the documents that fit at all, those before the first overflow are taken at once. It and all
    that were too large before stay too large, since a room only shrinks; so the next round looks at
    what still fits, and the rounds give what one walk along the order would.
    """
    taken, rows = None, _by_source(rows, state).where("size > 0 and size <= left")
    while True:
        rows = keep(rows)
        if rows.isEmpty():
            return taken, state
        drawn = keep(_head(rows, F.col("left")))
        taken = drawn.select("row") if taken is None else taken.union(drawn.select("row"))
        used = drawn.groupBy(F.col("source").alias("u")).agg(F.sum("size").alias("used"))
        state = keep(
            state.join(used, F.col("s").eqNullSafe(F.col("u")), "left").select("s", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"))
        )
        rows = _by_source(rows.drop("left").join(drawn.select("row"), "row", "left_anti"), state).where("size <= left")


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: tuple[int, ...] = (1, 2, 3), limit: int = 3, buckets: int = 65_536, fill_from: int = 64, seed: str = "mix",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source, source_size, target, copies, taken.

    ``weights`` go to the sources in order of name (NULL last), repeating. ``copies`` is how often
    the mix takes the document, ``taken`` the words of it. A NULL text has no words; documents
    without words are taken for their certain copies only, which hold nothing. Repeated rows share
    their random number and are told apart by place. Random numbers come from id, source and size,
    so reruns agree. An empty table gives no rows. ``carry`` names further columns to keep.
    Memory: one row per source in one task, ``buckets`` sums per source, ``fill_from`` documents
    per source in one array.
    """
    wanted = {"doc_id": id_col, "source": source_col, "text": text_col, **{f"_{c}": c for c in carry}}
    base = keep(
        numbered(pick(docs, **wanted)).select(
            "row", "doc_id", "source", word_count(F.col("text")).alias("size"), *[f"_{c}" for c in carry]
        )
    )
    totals = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n_words"))
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    whole = F.floor(ratio).cast("int")
    plan = keep(
        water_fill(totals.select("source", "source_size"), weights, limit).withColumn("whole", whole)
        .withColumn("need", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
        .withColumn("part", F.coalesce(F.try_divide("need", "source_size"), F.lit(0.0)))
        .withColumnRenamed("source", "s")
    )
    u, p = F.col("u"), F.col("part")
    ranked = (
        _by_source(base, plan)
        .withColumn("u", uniform(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("size")))
        # Odds of u over odds of the inclusion probability, brought from (0, inf) to (0, 1).
        .withColumn("v", u * (1 - p) / (u * (1 - p) + p * (1 - u)))
        .withColumn("bucket", F.least(F.floor(F.col("v") * buckets), F.lit(buckets - 1)).cast("int"))
    )
    # Sources that need no more than whole copies draw nothing, so none of their rows is looked at again.
    sums = ranked.where("need > 0").groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.first("need").alias("need"))
    along = Window.partitionBy("source").orderBy("bucket")
    edges = (
        sums.withColumn("after", F.sum("words").over(along)).withColumn("n_after", F.sum("n").over(along))
        .withColumn("over", F.col("after") > F.col("need"))
        .groupBy("source")
        .agg(
            F.min(F.when(F.col("over"), F.col("bucket"))).alias("first"),
            F.max(F.when(~F.col("over"), F.col("after"))).alias("sure"),
            F.min(F.when(F.col("over"), F.col("n_after"))).alias("n_first"),
            F.max("need").alias("need"),
        )
        .select("source", "first", (F.col("need") - F.coalesce("sure", F.lit(0))).alias("open"), "n_first")
        .withColumnRenamed("source", "s")
    )
    # The last range to look at: where enough documents for the fill have been passed after the first.
    last = (
        sums.withColumn("n_after", F.sum("n").over(along)).join(edges, F.col("source").eqNullSafe(F.col("s")))
        .where((F.col("bucket") >= F.col("first")))
        .groupBy("source")
        .agg(
            F.first("first").alias("first"), F.first("open").alias("open"),
            F.coalesce(F.min(F.when(F.col("n_after") - F.col("n_first") >= fill_from, F.col("bucket"))), F.max("bucket")).alias("last"),
        )
        .withColumnRenamed("source", "s")
    )
    placed = _by_source(ranked, keep(last))
    clear = placed.where("first is null or bucket < first or bucket > last").withColumn(
        "drawn", (F.col("first").isNull() & (F.col("need") > 0)) | F.coalesce(F.col("bucket") < F.col("first"), F.lit(False))
    )
    order = _order()
    close = keep(
        placed.where("bucket between first and last").withColumn("rn", F.row_number().over(order))
        .withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    heads = close.groupBy("source").agg(
        F.coalesce(F.max(F.when(F.col("upto") <= F.col("open"), F.col("rn"))), F.lit(0)).alias("head"),
        F.first("open").alias("room"),
        F.coalesce(F.max(F.when(F.col("upto") <= F.col("open"), F.col("upto"))), F.lit(0)).alias("used"),
    ).withColumnRenamed("source", "s")
    rest = close.join(heads, F.col("source").eqNullSafe(F.col("s")))
    after = rest.where((F.col("rn") > F.col("head")) & (F.col("rn") <= F.col("head") + fill_from))
    filled = keep(
        heads.join(
            after.groupBy(F.col("s").alias("f")).agg(
                (F.first("room") - F.first("used")).alias("left"), F.sort_array(F.collect_list(F.struct("rn", "size"))).alias("next")
            ).select("f", _fill(F.col("left"), F.col("next")).alias("d")), F.col("s").eqNullSafe(F.col("f")), "left",
        ).select(
            "s", F.coalesce("d.left", F.col("room") - F.col("used")).alias("left"),
            F.coalesce("d.taken", F.array().cast("array<int>")).alias("picked"),
        )
    )
    rest = keep(
        rest.drop("s").join(filled.select(F.col("s").alias("f"), "picked"), F.col("source").eqNullSafe(F.col("f")))
        .withColumn("drawn", (F.col("rn") <= F.col("head")) | F.array_contains("picked", F.col("rn"))).drop("f", "picked")
    )
    wanted = ["row", "doc_id", "source", "size", "v", "bucket"]
    passed = rest.where("not drawn").select(wanted).union(placed.where("bucket > last").select(wanted)).where("size > 0")
    behind = rest.where(~F.col("drawn") & (F.col("rn") > F.col("head") + fill_from)).select(wanted).union(placed.where("bucket > last").select(wanted))
    more, state = _fill_on(behind, filled.select("s", "left"))
    # One more document where that comes nearer: the least of those passed over, the first of equal ones.
    left_over = passed if more is None else passed.join(more, "row", "left_anti")
    least = left_over.groupBy("source").agg(F.min(F.struct("size", "v", F.col("doc_id").isNull(), "doc_id", "row")).alias("m"))
    closing = state.join(least, F.col("s").eqNullSafe(F.col("source"))).where(F.col("m.size") < 2 * F.col("left")).select("m.row")
    extra = keep((closing if more is None else closing.union(more)).select(F.col("row").alias("m_row")))
    also = lambda df: df.join(extra, F.col("row") == F.col("m_row"), "left").withColumn("drawn", F.col("drawn") | F.col("m_row").isNotNull())
    clear, close = also(clear), also(rest)
    columns = ["doc_id", "size", "source", "source_size", "target", "whole", "drawn", *[f"_{c}" for c in carry]]
    copies = F.col("whole") + F.col("drawn").cast("int")
    return clear.select(columns).union(close.select(columns)).select(
        "doc_id", "size", "source", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"), *[F.col(f"_{c}").alias(c) for c in carry],
    )


def mixed(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **settings
) -> DataFrame:
    """``docs`` as the mix takes them: every row as many times as ``mix`` says, whole texts.

    Only ids, sizes and keys go through the sampling; texts meet the result once. Equal rows are one
    row taken as often as all of them together, so none of them is numbered. A NULL id, source or text
    is a value like any other, see ``mix``; an empty table gives no rows.
    """
    key, copies, some, each = fresh(docs, "_key", "_copies", "_some", "_each")
    keyed = docs.withColumn(key, content_key(*[F.col(f"`{c}`") for c in docs.columns]))
    taken = mix(keyed, id_col, source_col, text_col, carry=(key,), **settings)
    total = taken.groupBy(key).agg(F.sum("copies").alias(copies)).where(F.col(copies) > 0)
    # A text that very many rows hold is dealt out in parts of PART rows.
    dealt = keyed.dropDuplicates([key]).join(total, key).withColumn(
        some, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / PART)), lambda i: F.least(F.col(copies) - i * PART, F.lit(PART))))
    )
    return dealt.withColumn(each, F.explode(F.sequence(F.lit(1).cast("long"), F.col(some)))).select(docs.columns)
