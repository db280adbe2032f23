"""Operator inputs derived from the benchmark tables.

Every view is a deterministic projection (or a bounded grouping) of a table, so
it grows with the table and can be restated in any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.catalog import GOAL_TYPES, INPUTS, TRANSFORMS, TRAPS, WEIGHTS

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
SLOTS = [t.id for t in TRANSFORMS] + ["not-a-real-transform"]
INPUT_TYPES = list(dict.fromkeys(t for t, _ in INPUTS))
ORIGINS = ["agent", "human", "seeded"]
# Note keys of the evidence.
CLAIM_KEYS = [
    "inkParadox", "emptyOutput", "cellErrors", "qualityIgnored", "orderDiffers", "strideWarn",
    "emptyResult", "magicMismatch",
]
# Names under which documents are stored: some of the default inputs, and one that is none.
STORED_NAMES = ["xlsx-sales", "md-notes", "png-scan", "csv-sales", "txt-plain", "other"]
SIGNATURE_HEX = [
    "89504E470D0A1A0A", "504B0304", "255044462D312E37", "FFD8FFE0", "474946383961",
    "0000002066747970617669660000", "", "3C3F786D6C20",
]
DECLARED_TYPES = ["png", "docx", "pdf", "txt", "zip", "html", "avif"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text table whose rows are about to be converted.

    Splits are those of the scan; where conversions cost more than reading, lower
    ``spark.sql.files.maxPartitionBytes`` instead of shuffling the texts.
    """
    return table(spark, sf_dir, name)


def dealt(rows: DataFrame) -> DataFrame:
    """Short rows about to be converted, dealt over the shuffle partitions.

    A scan cuts a table by bytes and row groups, so a few MB of short rows end in one task however
    long their conversion takes. All columns are hashed: no single value draws rows to one task.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *rows.columns)


def pick(values: list[str], index: Column) -> Column:
    """``values[index]`` for a small literal list."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


# --------------------------------------------------------------------- chains


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long step table: each run of twelve events makes four chains of 1, 2, 3 and 6 steps.

    Chain membership is arithmetic on the event id, so no user or type, however
    frequent, can make a chain long.
    """
    events = table(spark, sf_dir, "events")
    r = F.col("event_id") % 12
    part = F.when(r >= 6, 3).when(r >= 3, 2).when(r >= 1, 1).otherwise(0)
    start = F.when(r >= 6, 6).when(r >= 3, 3).when(r >= 1, 1).otherwise(0)
    kind = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type")) - 1
    slot = (kind * 6 + F.round(F.col("value") * 100).cast("bigint")) % len(SLOTS)
    side = F.floor(F.col("value") * 20).cast("string")
    e = F.col("event_id")

    def entry(when: Column, key: str, value: Column) -> Column:
        return F.when(when, F.struct(F.lit(key).alias("key"), value.alias("value")))

    params = F.array(
        entry(F.col("tool_id") == "png-resize", "w", side),
        entry(F.col("tool_id") == "png-resize", "h", side),
        entry(F.col("tool_id") == "png-quality", "quality", (e % 100).cast("string")),
        entry((F.col("tool_id") == "docx-pdf-soffice") & (e % 2 == 0), "empty", F.lit("true")),
        entry(e % 7 == 0, "font", F.lit("Latin Modern")),
        entry(e % 7 == 1, "font", F.lit(" Helvetica ")),
    )
    return (
        events.withColumn("tool_id", pick(SLOTS, slot))
        .withColumn("chain_id", F.floor(e / 12) * 4 + part)
        .withColumn("idx", (r - start).cast("int"))
        .withColumn("params", F.map_from_entries(F.filter(params, lambda p: p.isNotNull())))
        .withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        .select("chain_id", "idx", "tool_id", "params", "k", "event_id", "event_type", "ts", "value")
    )


def with_attributes(chains: DataFrame) -> DataFrame:
    """Input and goal type, origin, self-score and evidence, from the chain id and its first event."""
    c = F.col("chain_id")
    none = F.lit(None).cast("string")
    claim = pick(CLAIM_KEYS, F.col("k") % 9)
    measured = F.array(
        F.when(c % 10 == 0, F.struct(F.lit("magicMismatch").alias("key"), F.lit("bytes differ").alias("value"))),
        F.when(c % 11 == 0, F.struct(F.lit("emptyOutput").alias("key"), F.lit("0 bytes").alias("value"))),
    )
    claimed = F.array(F.when(claim.isNotNull(), F.struct(claim.alias("key"), F.lit("true").alias("value"))))
    return chains.withColumns(
        {
            "input_type": F.when(c % 5 == 0, pick(INPUT_TYPES, F.floor(c / 5) % 12)).otherwise(none),
            "output_type": F.when(c % 3 == 0, pick(GOAL_TYPES, F.floor(c / 3) % 8)).otherwise(none),
            "origin": pick(ORIGINS, c % 3),
            "self_score": ((c * 37) % 101).cast("double"),
            "measured": F.map_from_entries(F.filter(measured, lambda x: x.isNotNull())),
            "claimed": F.map_from_entries(F.filter(claimed, lambda x: x.isNotNull())),
        }
    )


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chain with its steps as an array; six steps at most by construction."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "tool_id", F.map_entries("params").alias("params"))))
    grouped = steps(spark, sf_dir).groupBy("chain_id").agg(
        ordered.alias("steps"), F.min_by("k", "idx").alias("k"), F.min("ts").alias("created_at")
    )
    flat = F.transform(
        "steps",
        lambda s: F.struct(
            s["tool_id"].alias("tool_id"), F.map_from_entries(s["params"]).alias("params")
        ),
    )
    return with_attributes(grouped.withColumn("steps", flat))


def chain_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attributes alone, from the first event of every chain; no grouping needed."""
    first = steps(spark, sf_dir).filter("idx = 0").select("chain_id", "k", F.col("ts").alias("created_at"))
    return with_attributes(first)


# ------------------------------------------------------------------ artifacts


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents behind byte signatures: sign by id, declared type by id, every 50th empty."""
    d = F.col("doc_id")
    prefix = F.unhex(pick(SIGNATURE_HEX, d % 8))
    content = F.when(d % 50 == 49, F.lit(b"")).otherwise(F.concat(prefix, F.encode("text", "UTF-8")))
    return texts(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("doc-"), d.cast("string")).alias("name"),
        pick(DECLARED_TYPES, d % 7).alias("declared_type"),
        content.alias("content"),
    )


def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24-byte image headers with sides from the id; every 13th is cut short."""
    d = F.col("doc_id")

    def side(n: Column) -> Column:
        return F.lpad(F.hex(n), 8, "0")

    packed = F.concat(
        F.lit("89504E470D0A1A0A0000000D49484452"), side(1 + (d * 37) % 9000), side(1 + (d * 101) % 9000)
    )
    content = F.unhex(F.when(d % 13 == 12, F.left(packed, F.lit(40))).otherwise(packed))
    return table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))


# ---------------------------------------------------------------------- texts


def marked_up_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown made from document lines: the line number decides the construct."""

    def line(x: Column, i: Column) -> Column:
        k = i % 17
        word = F.split_part(x, F.lit(" "), F.lit(1))
        return (
            F.when(k == 0, F.concat(F.lit("## "), x))
            .when(k.isin(2, 3), F.concat(F.lit("- "), x))
            .when(k == 5, F.concat(F.lit("1. **"), word, F.lit("** "), x))
            .when(k.isin(7, 9, 10), F.concat(F.lit("| "), word, F.lit(" | `x<y` |")))
            .when(k == 8, "| --- | :-: |")
            .when(k.isin(11, 13), "```")
            .when(k == 14, F.concat(F.lit("see [the "), word, F.lit("](https://example.test/"), word, F.lit(") *now*")))
            .when(k == 15, F.lit(""))
            .otherwise(x)
        )

    lines = F.split("text", "\n")
    return texts(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(F.transform(lines, line), "\n").alias("md")
    )


def tagged_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML made from document lines, covering the tags the crawled pages do not have."""

    def line(x: Column, i: Column) -> Column:
        k = i % 11
        word = F.split_part(x, F.lit(" "), F.lit(1))

        def wrap(before: str, body: Column, after: str) -> Column:
            return F.concat(F.lit(before), body, F.lit(after))

        return (
            F.when(k == 0, wrap("<h2>", x, " &amp; more</h2>"))
            .when(k == 1, wrap("<p>some <strong> ", word, " </strong> and <em>this</em><br/>text</p>"))
            .when(k == 2, F.concat(F.lit("<ol><li>"), word, F.lit("</li><li><code> "), word, F.lit(" </code></li></ol>")))
            .when(k == 3, wrap("<blockquote>", x, "\nsecond line</blockquote>"))
            .when(k == 4, F.concat(F.lit("<table><tr><th>"), word, F.lit("</th><th>n|m</th></tr><tr><td>1</td><td>"), word, F.lit("</td></tr></table>")))
            .when(k == 5, wrap("<pre><code>", word, " &lt;= 1\nnext\n</code></pre>"))
            .when(k == 6, F.concat(F.lit('<p><a class="c" href="/'), word, F.lit('">&nbsp;'), word, F.lit("</a> &#8364; &unknown;</p>")))
            .when(k == 7, wrap("<UL><LI>", word, "</LI></UL><style>p{}</style><script>var a = 1;</script>"))
            .when(k == 8, wrap("<div>", x, "</div>"))
            .otherwise(x)
        )

    lines = F.split("text", "\n")
    return texts(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(F.transform(lines, line), "\n").alias("html")
    )


def order_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV text per part: five columns, one of them quoted with embedded quotes and commas."""
    name = F.concat(F.lit('"'), F.col("p_name"), F.lit(', ""'), F.col("p_brand"), F.lit('"""'))
    header = F.lit("name,type,size,price,note")
    row = F.concat_ws(",", name, "p_type", F.col("p_size").cast("string"), F.lit(""), F.lit("a|b"))
    short = F.concat_ws(",", "p_brand", F.col("p_partkey").cast("string"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return dealt(parts).select(
        F.col("p_partkey").alias("doc_id"),
        F.concat(header, F.lit("\r\n"), row, F.lit("\n\n"), short, F.lit("\r")).alias("csv"),
    )


def text_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placed text runs: document lines down 45-line pages, stream order reversed for every third document.

    Every eleventh document is placed far off the page.
    """
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    on_page = F.col("pos") % 45
    return lines.select(
        "doc_id",
        (F.floor(F.col("pos") / 45) + 1).cast("int").alias("page"),
        F.when(F.col("doc_id") % 3 == 0, 44 - on_page).otherwise(on_page).cast("int").alias("seq"),
        F.when(F.col("doc_id") % 11 == 0, 4800.0).otherwise(54.0 + F.col("pos") % 2 * 200).alias("x"),
        F.when(F.col("doc_id") % 11 == 0, 4600.0).otherwise(738.25 - F.floor(on_page / 2) * 15).alias("y"),
        "text",
    )


# ----------------------------------------------------------------------- runs


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executed steps: lines of an order, failing where the return flag says so."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_linenumber").alias("step"),
        F.col("l_partkey").alias("item"),
        (~((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40))).alias("ok"),
        pick(CLAIM_KEYS, F.col("l_suppkey") % 9).alias("note"),
        F.concat(F.lit("v"), F.col("l_partkey").cast("string")).alias("note_value"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished runs: an order each, its customer as the chain."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_custkey").alias("chain_id"),
        F.col("o_orderdate").alias("at"),
        (F.col("o_orderstatus") != "F").alias("ok"),
        F.floor(F.col("o_totalprice")).cast("bigint").alias("ms"),
        F.floor(F.col("o_totalprice") % 101).cast("int").alias("score"),
    )


def run_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict per run from the notes it left; a third of all runs are of one chain."""
    key, price = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    fired = [F.when((key * 31 + price + 17 * i) % 7 == 0, F.struct(F.lit(t.id).alias("id"), F.lit(WEIGHTS[t.severity]).alias("weight"))) for i, t in enumerate(TRAPS)]
    found = F.array_compact(F.array(*fired))
    return table(spark, sf_dir, "orders").select(
        F.when(key % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("o_custkey")).alias("chain_id"), key.alias("run_id"), F.col("o_orderdate").alias("at"),
        F.transform(found, lambda h: h["id"]).alias("hits"),
        F.greatest(F.lit(0), 100 - F.aggregate(found, F.lit(0), lambda n, h: n + h["weight"])).alias("score"),
    )
