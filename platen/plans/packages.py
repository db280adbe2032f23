"""Queries on archives and office packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import packages
from ..operators import evidence, runs, sheets
from ..sources import views
from ..sources.archives import bundle_archives, explode_archives, pack_members
from . import sql
from .registry import query
from .texts import _SHEET_SQL, _parsed_sql


def bundles(spark: SparkSession, d: str) -> DataFrame:
    """All documents packed by shelf, one store-method archive each: a source and a hundred ids, so no shelf grows."""
    shelf = F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 100).cast("string"))
    parts = views.table(spark, d, "documents").select(
        shelf.alias("shelf"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"),
        F.encode("text", "UTF-8").alias("data"), "doc_id",
    )
    return bundle_archives(parts, "shelf", "name", "data", "doc_id")


_SHELF = "source || '/' || doc_id // 100"


@query(
    "archive_bundles",
    f"""SELECT {_SHELF} AS shelf, count(*) AS entries, sum(strlen(text)) AS declared,
      round(sum(strlen(text)) / (sum(strlen(text) + 76 + 2 * length('doc-' || doc_id)) + 22), 9) AS declared_ratio
    FROM documents GROUP BY 1""",
)
def archive_bundles(spark: SparkSession, d: str) -> DataFrame:
    return bundles(spark, d).select("shelf", "entries", "declared", F.round("declared_ratio", 9).alias("declared_ratio"))


@query(
    "archive_entries",
    f"""SELECT {_SHELF} AS shelf, 'doc-' || doc_id AS name, 0 AS method, strlen(text) AS comp_size, strlen(text) AS size,
      md5(text) AS digest, true AS crc_ok, true AS size_ok FROM documents""",
)
def archive_entries(spark: SparkSession, d: str) -> DataFrame:
    entries = evidence.integrity(explode_archives(bundles(spark, d).select("shelf", "content")))
    return entries.select(
        "shelf", "name", "method", "comp_size", "size", F.md5("data").alias("digest"), "crc_ok", "size_ok"
    )


@query(
    "archive_totals",
    f"""SELECT {_SHELF} AS shelf, count(*) AS entries, count(*) AS method0, 0 AS method8, sum(strlen(text)) AS compressed_total,
      sum(strlen(text)) AS inflated_total, 1.0 AS declared_ratio FROM documents GROUP BY 1""",
)
def archive_totals(spark: SparkSession, d: str) -> DataFrame:
    entries = explode_archives(bundles(spark, d).select("shelf", "content"), data=False)
    return evidence.archive_totals(entries, "shelf")


@query(
    "archive_lookups",
    """SELECT a.doc_id, a.source, 'doc-' || (a.n_chars % 1000) AS name, b.doc_id IS NOT NULL AS found
    FROM documents a LEFT JOIN documents b ON b.source = a.source AND b.doc_id = a.n_chars % 1000""",
)
def archive_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Look one member up by exact name in the archives of its source."""
    wanted = views.table(spark, d, "documents").select(
        "doc_id", "source", F.concat(F.lit("doc-"), (F.col("n_chars") % 1000).cast("string")).alias("name")
    )
    entries = explode_archives(bundles(spark, d).select("shelf", "content"), data=False)
    present = entries.select(F.split_part("shelf", F.lit("/"), F.lit(1)).alias("source"), "name", F.lit(True).alias("found"))
    return wanted.join(present, ["source", "name"], "left").select(
        "doc_id", "source", "name", F.coalesce("found", F.lit(False)).alias("found")
    )


@query(
    "broken_archives",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'doc-' || doc_id END AS name,
      CASE doc_id % 3 WHEN 1 THEN 'unreadable zip: zip file version 9.9' WHEN 2 THEN 'no archive: its directory is missing' END AS error,
      CASE doc_id % 3 WHEN 0 THEN strlen(text) END AS bytes FROM documents""",
)
def broken_archives(spark: SparkSession, d: str) -> DataFrame:
    """Good archives, archives whose directory asks for an unknown version, and no archives at all, side by side."""
    i = F.col("doc_id")
    name = F.concat(F.lit("doc-"), i.cast("string"))
    docs = views.table(spark, d, "documents").withColumn(
        "members", F.when(i % 3 < 2, F.array(F.struct(name.alias("name"), F.encode("text", "UTF-8").alias("data"))))
    )
    packed = docs.withColumn("zip", F.hex(pack_members(F.col("members"))))
    # The version needed stands six bytes into the directory record, which starts after the stored member.
    at = F.instr("zip", F.lit("504B0102")) + 12
    aged = F.overlay("zip", F.lit("63"), at, F.lit(2))
    content = F.when(i % 3 == 0, F.unhex("zip")).when(i % 3 == 1, F.unhex(aged)).otherwise(F.encode("text", "UTF-8"))
    found = explode_archives(packed.select("doc_id", content.alias("content")))
    return found.select("doc_id", "name", "error", F.octet_length("data").alias("bytes"))


# ------------------------------------------------------------------- packages


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return views.texts(spark, d, "documents").select(
        "doc_id", F.lit("txt").alias("type"), F.encode("text", "UTF-8").alias("content"), "text"
    )


@query(
    "word_round_trip",
    r"""SELECT doc_id, true AS ok, regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g') AS text, 'txt' AS type FROM documents""",
)
def word_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Pack every document as a word package and read it back."""
    return runs.run_chain(_documents(spark, d), ["text-docx", "docx-text"], "txt").select("doc_id", "ok", "text", "type")


@query(
    "word_text",
    f"""WITH parts AS (
      SELECT doc_id, generate_subscripts(a, 1) - 1 AS i, unnest(a) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
    said AS (
      SELECT doc_id, i, CASE i % 5 WHEN 0 THEN x WHEN 1 THEN x || ' AT&T' WHEN 2 THEN replace(x, ' ', chr(9)) WHEN 3 THEN x || chr(9) || '<' || i || '>' ELSE '' END AS t,
        CASE i % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS runs FROM parts)
    SELECT doc_id, regexp_replace(string_agg(t, chr(10) ORDER BY i), '\\n{{3,}}', chr(10) || chr(10), 'g') AS text, count(*) AS paragraphs,
      count(*) FILTER (regexp_matches(t, '\\S')) AS non_empty, sum(runs) AS runs FROM said GROUP BY doc_id""",
)
def word_text(spark: SparkSession, d: str) -> DataFrame:
    """Word XML made from lines: plain, split runs with an entity, tab marks, cells, empty paragraphs."""

    def paragraph(x, i):
        e = packages.escape_markup(x)
        run = lambda *t: F.concat(F.lit("<w:r><w:t>"), *t, F.lit("</w:t></w:r>"))
        cell = lambda *t: F.concat(F.lit("<w:tc>"), run(*t), F.lit("</w:tc>"))
        k = i % 5
        body = (
            F.when(k == 0, run(e))
            .when(k == 1, F.concat(run(e), F.lit('<w:r><w:t xml:space="preserve"> AT&amp;T</w:t></w:r>')))
            .when(k == 2, F.concat(F.lit("<w:tab/>"), run(e)))
            .otherwise(F.concat(cell(e), cell(F.lit("&lt;"), i.cast("string"), F.lit("&#62;"))))
        )
        return F.when(k == 4, "<w:p/>").otherwise(F.concat(F.lit("<w:p>"), body, F.lit("</w:p>")))

    xml = F.concat(
        F.lit("<w:document><w:body>"), F.array_join(F.transform(F.split("text", "\n"), paragraph), ""),
        F.lit("</w:body></w:document>"),
    )
    parsed = views.texts(spark, d, "documents").withColumn("xml", xml).withColumn("w", packages.word_text(F.col("xml")))
    return parsed.select("doc_id", "w.text", "w.paragraphs", "w.non_empty", "w.runs")


@query(
    "sheet_round_trip",
    f"""WITH {_SHEET_SQL}, {_parsed_sql('sheets', 'doc_id', 'csv')}
    SELECT doc_id, true AS ok, array_to_string(list_transform(rows, lambda r: array_to_string(list_transform(
      list_concat(r, list_transform(range(CAST(w - len(r) AS BIGINT)), lambda z: '')),
      lambda c: CASE WHEN regexp_matches(c, '[",\\r\\n]') THEN '"' || replace(c, '"', '""') || '"' ELSE c END), ',') || chr(13) || chr(10)), '') AS csv
    FROM (SELECT *, list_max(list_transform(rows, lambda r: len(r))) AS w FROM grid)""",
)
def sheet_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Pack every CSV as a spreadsheet and read the sheet back."""
    docs = views.order_sheets(spark, d).select(
        "doc_id", F.lit("csv").alias("type"), F.encode("csv", "UTF-8").alias("content"), F.col("csv").alias("text")
    )
    results = runs.run_chain(docs, ["csv-xlsx", "xlsx-csv"], "csv")
    return results.select("doc_id", "ok", F.col("text").alias("csv"))


@query(
    "sheet_cells",
    """SELECT c_custkey, c_mktsegment || ',' || c_name || ',' || c_acctbal::VARCHAR || ',' ||
        CASE WHEN c_custkey % 97 = 0 THEN '#VALUE!' ELSE c_custkey::VARCHAR END || ',,#REF!9' || chr(13) || chr(10)
        || '"a ""b"" & c",' || c_nationkey || ',x,,,' || chr(13) || chr(10) AS csv,
      2 AS n_rows, 6 AS n_cols, 1 + (c_custkey % 97 <> 0)::INT AS numeric_like, (c_custkey % 97 = 0)::INT AS errors_found
    FROM customer""",
)
def sheet_cells(spark: SparkSession, d: str) -> DataFrame:
    """A sheet per customer: shared, numeric, error, string and inline cells, a gap and a bad index."""
    key = F.col("c_custkey").cast("string")
    shared = F.concat(
        F.lit("<sst><si><t>"), F.col("c_mktsegment"), F.lit("</t></si><si><r><t>Customer</t></r><r><t>"),
        F.replace("c_name", F.lit("Customer"), F.lit("")), F.lit("</t></r></si></sst>"),
    )
    fourth = F.when(F.col("c_custkey") % 97 == 0, '<c r="D1" t="e"><v>#VALUE!</v></c>').otherwise(
        F.concat(F.lit('<c r="D1" t="str"><v>'), key, F.lit("</v></c>"))
    )
    fourth = F.when(F.col("c_custkey") % 97 == 0, fourth).otherwise(F.concat(F.lit('<c r="D1"><v>'), key, F.lit("</v></c>")))
    sheet = F.concat(
        F.lit('<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="str"><v>'),
        F.col("c_acctbal").cast("string"), F.lit("</v></c>"), fourth, F.lit('<c r="F1" t="s"><v>9</v></c></row>'),
        F.lit('<row r="5"><c t="inlineStr"><is><t>a "b" &amp; c</t></is></c><c><v>'), F.col("c_nationkey").cast("string"),
        F.lit('</v></c><c t="str"><v>x</v></c></row>'),
    )
    customers = views.table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    parsed = (
        views.dealt(customers)
        .withColumn("_shared", packages.shared_strings(shared))
        .withColumn("_rows", packages.sheet_rows(sheet, F.col("_shared")))
        .withColumn("s", packages.sheet_csv(F.col("_rows")))
    )
    return parsed.select("c_custkey", "s.*")


@query(
    "shared_string_cells",
    """WITH cells AS (
      SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 45 THEN 'n' ELSE 's' END AS kind,
        CASE WHEN l_quantity > 45 THEN l_partkey::VARCHAR ELSE (ascii(l_returnflag) % 4)::VARCHAR END AS raw FROM lineitem),
    strings AS (SELECT DISTINCT l_orderkey, ascii(l_returnflag) % 4 AS idx, 'flag ' || l_linestatus AS value FROM lineitem WHERE l_returnflag <> 'R'),
    one AS (SELECT l_orderkey, idx, min(value) AS value FROM strings GROUP BY ALL)
    SELECT c.l_orderkey AS doc_id, l_linenumber, l_partkey, CASE WHEN kind = 's' THEN coalesce(value, '#REF!' || raw) ELSE raw END AS value
    FROM cells c LEFT JOIN one s ON s.l_orderkey = c.l_orderkey AND kind = 's' AND s.idx = CAST(raw AS INTEGER)""",
)
def shared_string_cells(spark: SparkSession, d: str) -> DataFrame:
    lines = views.table(spark, d, "lineitem").withColumn("doc_id", F.col("l_orderkey"))
    code = F.ascii("l_returnflag") % 4
    number = F.col("l_quantity") > 45
    cells = lines.select(
        "doc_id", "l_linenumber", "l_partkey", F.when(number, "n").otherwise("s").alias("kind"),
        F.when(number, F.col("l_partkey").cast("string")).otherwise(code.cast("string")).alias("raw"),
    )
    strings = (
        lines.filter("l_returnflag <> 'R'")
        .groupBy("doc_id", code.cast("bigint").alias("idx"))
        .agg(F.min(F.concat(F.lit("flag "), F.col("l_linestatus"))).alias("value"))
    )
    return sheets.resolve_shared(cells, strings).select("doc_id", "l_linenumber", "l_partkey", "value")


@query(
    "sheet_stats",
    """SELECT l_orderkey AS doc_id, count(DISTINCT l_linenumber) AS n_rows, max(l_suppkey % 20) + 1 AS n_cols,
      count(*) FILTER (l_partkey % 97 = 0) AS errors_found, count(*) FILTER (l_partkey % 97 <> 0) AS numeric_like
    FROM lineitem GROUP BY l_orderkey""",
)
def sheet_stats(spark: SparkSession, d: str) -> DataFrame:
    cells = views.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("row_idx"), (F.col("l_suppkey") % 20).alias("col_idx"),
        F.when(F.col("l_partkey") % 97 == 0, "e").otherwise("n").alias("kind"),
    )
    return sheets.sheet_stats(cells)


@query(
    "column_letters",
    """WITH RECURSIVE named AS (
      SELECT p_partkey, p_partkey * 7919 % 20000000 AS idx, p_partkey * 7919 % 20000000 + 1 AS n, '' AS letters FROM part
      UNION ALL SELECT p_partkey, idx, (n - 1) // 26, chr(CAST(65 + (n - 1) % 26 AS INTEGER)) || letters FROM named WHERE n > 0)
    SELECT p_partkey, idx, letters, idx AS back, regexp_matches(p_name, '^[0-9]+$') AS numeric_name,
      CAST(p_retailprice AS VARCHAR) <> '' AS numeric_price FROM named JOIN part USING (p_partkey) WHERE n = 0""",
)
def column_letters(spark: SparkSession, d: str) -> DataFrame:
    """Column numbers of one to five letters, to letters and back."""
    indexed = views.table(spark, d, "part").withColumn("idx", F.col("p_partkey") * 7919 % 20_000_000)
    lettered = indexed.withColumn("letters", packages.column_letters(F.col("idx")))
    return lettered.select(
        "p_partkey", "idx", "letters", packages.column_index(F.col("letters")).alias("back"),
        packages.is_numeric_cell(F.col("p_name")).alias("numeric_name"),
        packages.is_numeric_cell(F.col("p_retailprice").cast("string")).alias("numeric_price"),
    )




@query(
    "sheet_choices",
    """SELECT doc_id, doc_id % 4 <> 3 AS ok, CASE doc_id % 4 WHEN 0 THEN 'first' || chr(13) || chr(10) WHEN 1 THEN 'a' || chr(13) || chr(10) WHEN 2 THEN 'x,,,y' || chr(13) || chr(10) END AS csv,
      CASE doc_id % 4 WHEN 3 THEN 'package without a worksheet part' END AS error FROM documents""",
)
def sheet_choices(spark: SparkSession, d: str) -> DataFrame:
    """Packages with the usual first sheet, with sheets of other names, with a gap between cells, and with none."""
    def sheet(name: str, body: str) -> F.Column:
        xml = f"<worksheet><sheetData><row>{body}</row></sheetData></worksheet>"
        return F.struct(F.lit(name).alias("name"), F.encode(F.lit(xml), "UTF-8").alias("data"))

    inline = '<c t="inlineStr"><is><t>{}</t></is></c>'
    other = "xl/worksheets/{}.xml"
    i = F.col("doc_id") % 4
    members = (
        F.when(i == 0, F.array(sheet(other.format("a"), inline.format("a")), sheet(packages.FIRST_SHEET, inline.format("first"))))
        .when(i == 1, F.array(sheet(other.format("b"), inline.format("b")), sheet(other.format("a"), inline.format("a"))))
        .when(i == 2, F.array(sheet(packages.FIRST_SHEET, '<c r="D1" t="str"><v>y</v></c><c r="A1" t="str"><v>x</v></c>')))
        .otherwise(F.array(sheet("docProps/app.xml", "")))
    )
    docs = views.table(spark, d, "documents").select(
        "doc_id", F.lit("xlsx").alias("type"), members.alias("members"), F.lit(None).cast("string").alias("text")
    ).withColumn("content", pack_members(F.col("members"))).drop("members")
    done = runs.run_chain(docs, ["xlsx-csv"], "xlsx")
    return done.select("doc_id", "ok", F.when(F.col("ok"), F.col("text")).alias("csv"), F.get("log", F.lit(0))["error"].alias("error"))
