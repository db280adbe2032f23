"""License scans by diagonal voting over rolling word k-grams.

Every word k-gram of every text is joined by its hash to the positions it has in a small table
of phrases and notices (``TEMPLATES``, a constant, so the broadcast is bounded). A match of text
position p with template position t votes for the diagonal p - t, the place where the template
would start. A base phrase stands where one diagonal has all its votes. For the longer notices,
diagonals a few words apart are merged, since an inserted or missing word moves the rest, and the
merged span counts when enough of the notice is covered by a span of about its length. The join
compares the words as well as the hash, so no vote rests on a hash collision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .rows import lower_ascii, numbered, pick

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and the opening or reference lines of public license notices.
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "licensed under the bsd 3 clause license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "dedicated to the public domain under cc0 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
BASE_GRAM, NOTICE_GRAM = 2, 3


def templates(spark: SparkSession) -> DataFrame:
    """One row per template k-gram: tid, label, base, n_grams, tpos, k, words."""
    rows = []
    for base, k, table in ((True, BASE_GRAM, BASE), (False, NOTICE_GRAM, NOTICES)):
        for label, phrase in table:
            words = phrase.split()
            tid = len({r[0] for r in rows})
            n = len(words) - k + 1
            rows += [(tid, label, base, n, t, k, words[t : t + k]) for t in range(n)]
    return spark.createDataFrame(
        rows, "tid int, label string, base boolean, n_grams int, tpos int, k int, words array<string>"
    )


def _grams(words: Column, k: int) -> Column:
    """Rolling k-grams of one text: (pos, k, hash)."""
    n = F.greatest(F.size(words) - (k - 1), F.lit(0))
    return F.transform(
        F.slice(words, F.lit(1), n),
        lambda w, i: F.struct(
            i.alias("pos"), F.lit(k).alias("k"), F.xxhash64(F.lit(k), w, *[F.get(words, i + j) for j in range(1, k)]).alias("h")
        ),
    )


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drift: int = 3, coverage: float = 0.75
) -> DataFrame:
    """One row per row of ``docs``: n_words, base places, labels of base phrases and notices, score.

    ``drift``: diagonals this many words apart belong to one copy of a notice. ``coverage``: share
    of a notice's k-grams its span must hold. A NULL text is empty: no words, no labels, score 0.
    Repeated rows give repeated results, a NULL id is kept, an empty table gives no rows; other
    columns are ignored whatever their names. ``score`` is the best coverage of any template.

    One scan of the texts; only the votes and one marker row per document are shuffled. Votes of
    one document share a task, which the size of the document bounds.
    """
    spark = docs.sparkSession
    words = F.filter(F.split(lower_ascii(F.col("text")), GAP), lambda w: w != "")
    marker = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("k"), F.lit(None).cast("long").alias("h")))
    grams = (
        numbered(pick(docs, doc_id=id_col, text=text_col))
        .select("row", "doc_id", words.alias("words"))
        .select(
            "row", "doc_id", "words",
            F.explode(F.concat(marker, _grams(F.col("words"), BASE_GRAM), _grams(F.col("words"), NOTICE_GRAM))).alias("g"),
        )
    )
    table = templates(spark)
    table = table.select(
        "tid", "label", "base", "n_grams", "tpos", F.col("words").alias("twords"),
        _table_hash(F.col("words")).alias("th"),
    )
    same = (F.col("g.h") == F.col("th")) & (F.slice("words", F.col("g.pos") + 1, F.size("twords")) == F.col("twords"))
    votes = (
        grams.join(F.broadcast(table), same, "left")
        .where("tid is not null or g.pos = -1")
        .select(
            "row", "doc_id", "tid", "label", "base", "n_grams", "tpos", F.col("g.pos").alias("pos"),
            (F.col("g.pos") - F.col("tpos")).alias("diagonal"),
            F.when(F.col("g.pos") == -1, F.size("words")).alias("n_words"),
        )
        .repartition("row")
    )
    order = Window.partitionBy("row", "tid").orderBy("diagonal", "pos")
    # A base phrase never spans two diagonals; a notice may.
    step = F.col("diagonal") - F.lag("diagonal").over(order) > F.when(F.col("base"), 0).otherwise(drift)
    spans = (
        votes.withColumn("copy", F.sum(F.coalesce(step, F.lit(False)).cast("int")).over(order))
        .groupBy("row", "tid", "copy")
        .agg(
            F.first("doc_id").alias("doc_id"), F.first("label").alias("label"), F.first("base").alias("base"),
            F.first("n_grams").alias("n_grams"), F.size(F.collect_set("tpos")).alias("covered"),
            F.min("diagonal").alias("start"), (F.max("pos") - F.min("pos") + 1).alias("length"), F.max("n_words").alias("n_words"),
        )
        .withColumn("share", F.when(F.col("length") <= 1.5 * F.col("n_grams") + drift, F.col("covered") / F.col("n_grams")))
        .withColumn("place", F.col("base") & (F.col("covered") == F.col("n_grams")))
        .withColumn("named", F.col("place") | (~F.col("base") & (F.col("share") >= coverage)))
    )
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return spans.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if(F.col("place")).alias("n_base"),
        F.min(F.when(F.col("place"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("place"), F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(F.col("place"), F.col("label"))).alias("base_labels"),
        joined(F.when(F.col("named"), F.col("label"))).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    ).drop("row")


def _table_hash(words: Column) -> Column:
    """The hash of a template's words as ``_grams`` has it."""
    two = F.xxhash64(F.lit(BASE_GRAM), F.get(words, F.lit(0)), F.get(words, F.lit(1)))
    three = F.xxhash64(F.lit(NOTICE_GRAM), F.get(words, F.lit(0)), F.get(words, F.lit(1)), F.get(words, F.lit(2)))
    return F.when(F.size(words) == BASE_GRAM, two).otherwise(three)
