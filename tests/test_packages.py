"""Archives and office packages, against containers written by the standard library."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from platen.operators import evidence, runs
from platen.sources.archives import bundle_archives, explode_archives
from platen.sources.csv_files import read_csv, write_csv

# A harbour log as a word part: runs split inside a word, an empty paragraph, entities, a tab mark.
DOCX = (
    '<?xml version="1.0"?><w:document xmlns:w="urn:w"><w:body><w:p w:rsid="7"><w:pPr/><w:r><w:t>Har</w:t></w:r><w:r><w:t>bour log</w:t></w:r></w:p>'
    '<w:p/><w:p><w:r><w:t xml:space="preserve">Gulls &amp; terns: 12 &gt; 9</w:t></w:r></w:p>'
    "<w:p><w:r><w:t>tide 04:10</w:t><w:tab/></w:r></w:p></w:body></w:document>"
)
SHARED = "<sst count='4'><si><t>berth</t></si><si><r><t>dra</t></r><r><t>ught</t></r></si><si/><si><t xml:space='preserve'>quay &lt;4&gt;</t></si></sst>"
SHEET = (
    '<worksheet><sheetData><row r="3"><c r="B3" t="s"><v>1</v></c><c r="A3" s="2" t="s"><v>0</v></c></row>'
    '<row r="4"><c r="A4" t="s"><v>3</v></c><c r="B4"><v>6.25</v></c><c t="e"><v>#N/A</v></c><c r="E4" t="inlineStr"><is><r><t>in dock</t></r></is></c></row>'
    '<row r="9"><c r="A9" t="b"><v>1</v></c><c r="B9" t="s"><v>44</v></c><c r="C9"/></row></sheetData></worksheet>'
)


def pack(members, method=zipfile.ZIP_DEFLATED):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", method) as archive:
        for name, data in members.items():
            archive.writestr(name, data)
    return bytearray(buffer.getvalue())


def docs(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id int, type string, content binary")
    return df.withColumn("text", F.lit(None).cast("string"))


@pytest.mark.parametrize("method", [zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED])
def test_word_text(spark, method):
    content = pack({"[Content_Types].xml": "<Types/>", "_rels/.rels": "<R/>", "word/document.xml": DOCX}, method)
    row = runs.run_chain(docs(spark, ("docx", content)), ["docx-text"], "docx").first()
    assert row.ok and row.text == "Harbour log\n\nGulls & terns: 12 > 9\ntide\t04:10"
    assert row.type == "txt" and row.notes == {} and row.content is None


def test_word_failures(spark):
    given = docs(
        spark, ("docx", pack({"other.xml": "x"})), ("docx", bytearray(b"\x89PNG\r\n\x1a\n")), ("docx", bytearray(b"PK\x03\x04junk")),
        ("docx", pack({"word/document.xml": "<w:p></w:p>"})),
    )
    rows = {r.doc_id: r for r in runs.run_chain(given, ["docx-text"], "docx").collect()}
    assert rows[0].log[0].error == "package without a word/document.xml part (first members: other.xml)"
    assert "PNG" in rows[1].log[0].error and "magicMismatch" in rows[1].notes
    assert rows[2].log[0].error.startswith("no archive")
    assert rows[3].ok and "emptyResult" in rows[3].notes


def test_sheet(spark):
    content = pack({"xl/sharedStrings.xml": SHARED, "xl/worksheets/sheet1.xml": SHEET})
    row = runs.run_chain(docs(spark, ("xlsx", content)), ["xlsx-csv"], "xlsx").first()
    assert row.ok and row.text == "berth,draught,,,\r\nquay <4>,6.25,#N/A,,in dock\r\n1,#REF!44,,,\r\n"
    assert row.notes == {"cellErrors": "1 cell(s) hold an error value"}


def test_sheet_choice_and_absence(spark):
    late = pack({"xl/worksheets/b.xml": SHEET.replace("6.25", "7.5"), "xl/worksheets/a.xml": SHEET})
    rows = runs.run_chain(docs(spark, ("xlsx", late), ("xlsx", pack({"x": "y"}))), ["xlsx-csv"], "xlsx").collect()
    assert "6.25" in rows[0].text and "#REF!0" in rows[0].text
    assert rows[1].log[0].error == "package without a worksheet part"


def test_pack_and_unpack(spark):
    parts = F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.lit(len(b)).cast("bigint").alias("bytes"), F.lit(b).alias("data"))
            for n, b in [("notes.md", b"# inside\n"), ("data.csv", b"a,b\n1,2\n")]
        ]
    )
    row = runs.run_chain(docs(spark, ("files", None)).withColumn("files", parts), ["zip-pack", "zip-unpack"], "files").first()
    assert row.ok and [f.name for f in row.files] == ["notes.md", "data.csv"] and bytes(row.files[1].data) == b"a,b\n1,2\n"
    assert row.log[0].magic_type == "zip"


def test_entries_keep_directory_claims(spark):
    members = {"a.txt": "x" * 1000, "b.txt": "y"}
    df = spark.createDataFrame([(1, pack(members)), (2, bytearray(b"nope")), (3, None)], "doc_id int, content binary")
    rows = evidence.integrity(explode_archives(df)).collect()
    good = [r for r in rows if r.doc_id == 1]
    assert [r.name for r in good] == ["a.txt", "b.txt"] and all(r.crc_ok and r.size_ok for r in good)
    assert good[0].method == 8 and good[0].comp_size < good[0].size == 1000
    assert [r.error for r in rows if r.doc_id == 2] == ["no archive: its directory is missing"]
    totals = evidence.archive_totals(explode_archives(df)).filter("doc_id = 1").first()
    assert totals.entries == 2 and totals.declared_ratio > 1


def test_damaged_member_is_reported(spark):
    content = pack({"a.txt": "hello hello hello hello"})
    content[35:40] = b"\xff\xff\xff\xff\xff"
    row = explode_archives(spark.createDataFrame([(1, content)], "doc_id int, content binary")).first()
    assert row.error is not None or bytes(row.data) != b"hello hello hello hello"


def test_bundles_are_cut_into_volumes_without_loss(spark):
    parts = spark.range(3000).select(
        F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("b"), (F.col("id") % 50).cast("string"))).alias("bundle"),
        F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.encode(F.repeat(F.lit("z"), 50), "UTF-8").alias("data"), "id",
    )
    for volumes in (1, 6):
        packed = bundle_archives(parts, "bundle", "name", "data", "id", volumes=volumes).cache()
        assert packed.filter("bundle = 'hot'").count() == volumes
        back = explode_archives(packed.select("bundle", "content"))
        assert back.select("bundle", "name").exceptAll(parts.select("bundle", "name")).count() == 0
        assert back.count() == 3000


def test_crafted_archives_stay_rows(spark):
    good = pack({"a.txt": "a"})
    aged = bytearray(good)
    aged[aged.index(b"PK\x01\x02") + 6] = 99
    rows = [(1, good), (2, aged), (3, good[:-9]), (4, None)]
    df = spark.createDataFrame(rows, "doc_id int, content binary")
    got = {r.doc_id: (r.name, r.error) for r in explode_archives(df).collect()}
    assert got[1] == ("a.txt", None) and got[4] == (None, None)
    assert got[2][1].startswith("unreadable zip") and got[3][1].startswith("no archive")
    assert "data" not in explode_archives(df, data=False).columns
    docs_ = df.withColumns({"type": F.lit("docx"), "text": F.lit(None).cast("string")})
    assert [r.ok for r in runs.run_chain(docs_, ["docx-text"], "docx").collect()] == [False] * 4


def test_bomb_gives_an_error():
    import io as _io
    import zipfile as _zip

    from platen.sources import archives

    content = bytes(pack({"zeros": b"0" * 5_000_000}))
    info = _zip.ZipFile(_io.BytesIO(content)).infolist()[0]
    assert archives._inflate(content, info, 1_000_000) == (None, "member inflates beyond 1000000 bytes")
    assert len(archives._inflate(content, info)[0]) == 5_000_000


def test_wide_and_long_references(spark):
    from platen.functions import packages

    sheet = '<row><c r="ZZZZZZZZZZZZZZZZZZZZ1" t="str"><v>far</v></c><c r="C1" t="str"><v>c</v></c><c t="str"><v>d</v></c></row>'
    wide = "<row>" + "".join(f"<c><v>{i}</v></c>" for i in range(16_000)) + "</row>"
    df = spark.createDataFrame([(sheet,), (wide,)], "x string").withColumn("rows", packages.sheet_rows(F.col("x"), F.array().cast("array<string>")))
    got = [r[0] for r in df.select(packages.sheet_csv(F.col("rows"))["csv"]).collect()]
    assert got[0] == "far,,c,d\r\n" and got[1].count(",") == 15_999


def test_csv_files_round_trip(spark, tmp_path):
    rows = [("north", 'say "hi", twice', "120"), ("south", "two\nlines", "80")]
    path = str(tmp_path / "csv")
    write_csv(spark.createDataFrame(rows, "region string, note string, units string").coalesce(1), path)
    raw = next((tmp_path / "csv").glob("*.csv")).read_bytes()
    assert raw.startswith(b'region,note,units\r\nnorth,"say ""hi"", twice",120\r\n')
    assert sorted(tuple(r) for r in read_csv(spark, path).collect()) == sorted(rows)


@pytest.mark.parametrize("name", ["broken_archives", "archive_lookups", "archive_totals", "archive_entries", "word_round_trip", "sheet_round_trip"])
def test_containers_are_opened_a_few_rows_at_a_time(spark, sf_dir, name):
    """An Arrow batch of packages stands in every worker several times over; row functions get a hundred rows."""
    from platen.plans import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("name", ["sheet_round_trip", "sheet_cells"])
def test_sheets_are_dealt_over_the_tasks(spark, sf_dir, name):
    """A small file is one task of the scan; the conversion of its rows is not."""
    from platen.plans import QUERIES

    assert QUERIES[name](spark, sf_dir).select(F.spark_partition_id()).distinct().count() == 8
