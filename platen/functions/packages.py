r"""Word and spreadsheet package parts as in-row expressions over their XML text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .lang import let, until
from .tabular import render_csv
from .text import (
    column_index, column_letters, decode_entities, escape_markup, is_blank, is_numeric_cell, unix_lines,
)

WORD_PART = "word/document.xml"
SHARED_PART = "xl/sharedStrings.xml"
FIRST_SHEET = "xl/worksheets/sheet1.xml"
SHEET_PART = r"^xl/worksheets/.*\.xml$"
SHEET_OR_SHARED = r"^xl/(?:sharedStrings|worksheets/.*)\.xml$"

# ------------------------------------------------------------------- reading


def _element(name: str, group: bool = True) -> str:
    """An element by its qualified name: opening tag, then anything up to its own closing tag; or an empty element."""
    body = until(f"</{name}>")
    inner = f"({body})" if group else body
    return rf"<{name}(?=[\s/>])[^>]*+(?:(?<=/)>|>{inner}</{name}>)"


PARAGRAPH, WORD_CELL, WORD_RUN = _element("w:p", False), _element("w:tc", False), _element("w:t")
SHARED_ENTRY, PLAIN_TEXT, SHEET_ROW = _element("si"), _element("t"), _element("row")
CELL_VALUE, CELL_INLINE = _element("v"), _element("is")
CELL_XML = rf"<c(?=[\s/>])([^>]*+)(?:(?<=/)>|>({until('</c>')})</c>)"


def _chunk(xml: Column) -> Column:
    """``struct(text, runs)``: decoded runs glued together.

    Tab marks turn spaces into tabs when no tab is in the text.
    """

    def tabbed(out: Column) -> Column:
        marks = xml.rlike(_element("w:tab")) & ~F.contains(out, F.lit("\t"))
        return F.when(marks, F.replace(out, F.lit(" "), F.lit("\t"))).otherwise(out)

    def chunk(runs: Column) -> Column:
        joined = F.array_join(F.transform(runs, decode_entities), "")
        return F.struct(let(joined, tabbed).alias("text"), F.size(runs).alias("runs"))

    return let(F.regexp_extract_all(xml, F.lit(WORD_RUN), F.lit(1)), chunk)


def _sum_runs(chunks: Column) -> Column:
    return F.aggregate(chunks, F.lit(0), lambda total, c: total + c["runs"])


def word_text(xml: Column) -> Column:
    """``struct(text, paragraphs, non_empty, tables, runs)`` of a word document part."""

    def paragraph(p: Column) -> Column:
        def merged(chunks: Column) -> Column:
            return F.struct(
                F.array_join(F.transform(chunks, lambda c: c["text"]), "\t").alias("text"),
                _sum_runs(chunks).alias("runs"),
                p.rlike(r"<w:tbl(?=[\s>])").alias("table"),
            )

        cells = let(
            F.regexp_extract_all(p, F.lit(WORD_CELL), F.lit(0)),
            lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(p)),
        )
        return let(F.transform(cells, _chunk), merged)

    def with_loose_text(paragraphs: Column) -> Column:
        """A part without paragraphs still yields the text of its runs."""
        loose = let(
            _chunk(xml),
            lambda c: F.filter(
                F.array(F.struct(c["text"].alias("text"), c["runs"].alias("runs"), F.lit(False).alias("table"))),
                lambda x: x["text"] != "",
            ),
        )
        return F.when(F.size(paragraphs) > 0, paragraphs).otherwise(loose)

    def stats(p: Column) -> Column:
        text = F.array_join(F.transform(p, lambda x: x["text"]), "\n")
        return F.struct(
            F.regexp_replace(text, "\n{3,}", "\n\n").alias("text"),
            F.size(p).alias("paragraphs"),
            F.size(F.filter(p, lambda x: ~is_blank(x["text"]))).alias("non_empty"),
            F.size(F.filter(p, lambda x: x["table"])).alias("tables"),
            _sum_runs(p).alias("runs"),
        )

    found = F.transform(F.regexp_extract_all(xml, F.lit(PARAGRAPH), F.lit(0)), paragraph)
    return let(let(found, with_loose_text), stats)


def shared_strings(xml: Column) -> Column:
    """The shared-string table as an array; the index is the position."""

    def entry(si: Column) -> Column:
        parts = F.regexp_extract_all(si, F.lit(PLAIN_TEXT), F.lit(1))
        return F.array_join(F.transform(parts, decode_entities), "")

    return F.transform(F.regexp_extract_all(xml, F.lit(SHARED_ENTRY), F.lit(1)), entry)


def cell_value(kind: Column, raw: Column, inline: Column, shared: Column) -> Column:
    """Cell text by type; ``raw`` and ``inline`` are NULL when the element is missing."""

    def from_table(i: Column) -> Column:
        in_range = (i >= 0) & (i < F.size(shared))
        return F.when(in_range, F.get(shared, i.cast("int"))).otherwise(F.concat(F.lit("#REF!"), i.cast("string")))

    return (
        F.when((kind == "s") & raw.isNotNull(), from_table(F.coalesce(raw.try_cast("bigint"), F.lit(-1))))
        .when((kind == "inlineStr") & inline.isNotNull(), decode_entities(inline))
        .when(raw.isNotNull(), decode_entities(raw))
        .otherwise("")
    )


def sheet_rows(xml: Column, shared: Column) -> Column:
    """Rows of ``struct(col, value, is_error, is_number)`` in document order.

    Row numbers are ignored, so gaps close up. A cell without a usable reference takes the
    position after the right-most cell so far.
    """

    def captured(s: Column, pattern: str) -> Column:
        return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, 1))

    def attribute(attrs: Column, name: str, value: str = '[^"]++') -> Column:
        return captured(attrs, rf'(?:^|\s){name}="({value})"')

    def cell(attrs: Column, inner: Column) -> Column:
        """Every part is cut out once and the value made once; both are mentioned several times."""
        parts = F.struct(
            F.coalesce(attribute(attrs, "t"), F.lit("")).alias("kind"),
            captured(inner, CELL_VALUE).alias("raw"),
            captured(captured(inner, CELL_INLINE), PLAIN_TEXT).alias("inline"),
            F.regexp_extract(attribute(attrs, "r", "[A-Z]++[0-9]++"), "^[A-Z]+", 0).alias("letters"),
        )

        def valued(p: Column) -> Column:
            kind, raw, inline = p["kind"], p["raw"], p["inline"]
            plain = raw.isNotNull() & ~kind.isin("s", "e", "str") & ~((kind == "inlineStr") & inline.isNotNull())
            return let(
                cell_value(kind, raw, inline, shared),
                lambda value: F.struct(
                    column_index(p["letters"]).alias("col"),
                    value.alias("value"),
                    ((kind == "e") & raw.isNotNull()).alias("is_error"),
                    (plain & is_numeric_cell(value)).alias("is_number"),
                ),
            )

        return let(parts, valued)

    def placed(cells: Column) -> Column:
        """Fill in missing positions; the right-most one so far travels along."""

        def put(acc: Column, c: Column) -> Column:
            at = F.coalesce(c["col"], acc["free"])
            here = F.struct(at.alias("col"), c["value"].alias("value"), c["is_error"].alias("is_error"), c["is_number"].alias("is_number"))
            return F.struct(F.array_append(acc["row"], here).alias("row"), F.greatest(acc["free"], at + 1).alias("free"))

        empty = F.array().cast("array<struct<col:bigint,value:string,is_error:boolean,is_number:boolean>>")
        start = F.struct(empty.alias("row"), F.lit(0).cast("bigint").alias("free"))
        missing = F.exists(cells, lambda c: c["col"].isNull())
        return F.when(missing, F.aggregate(cells, start, put, lambda acc: acc["row"])).otherwise(cells)

    def row(inner: Column) -> Column:
        cells = F.zip_with(
            F.regexp_extract_all(inner, F.lit(CELL_XML), F.lit(1)),
            F.regexp_extract_all(inner, F.lit(CELL_XML), F.lit(2)),
            cell,
        )
        return let(cells, placed)

    return F.transform(F.regexp_extract_all(xml, F.lit(SHEET_ROW), F.lit(1)), row)


def rows_to_grid(rows: Column) -> Column:
    """Cells to arrays of text by column; the last cell at a position wins.

    Sorted once by position and place, every cell brings the blanks of the gap before it.
    """

    def spread(row: Column) -> Column:
        dense = F.forall(F.transform(row, lambda x, i: x["col"] == i), lambda ok: ok)
        ordered = F.array_sort(F.transform(row, lambda x, i: F.struct(x["col"].alias("col"), i.alias("i"), x["value"].alias("value"))))

        def filled(cells: Column) -> Column:
            def piece(c: Column, i: Column) -> Column:
                before = F.coalesce(F.get(cells, i - 1)["col"], F.lit(-1).cast("bigint"))
                return F.concat(F.array_repeat(F.lit(""), (c["col"] - before - 1).cast("int")), F.array(c["value"]))

            return F.flatten(F.transform(cells, piece))

        def last(cells: Column) -> Column:
            return F.filter(cells, lambda c, i: ~F.coalesce(F.get(cells, i + 1)["col"] == c["col"], F.lit(False)))

        return (
            F.when(F.size(row) == 0, F.array().cast("array<string>"))
            .when(dense, F.transform(row, lambda x: x["value"]))
            .otherwise(let(let(ordered, last), filled))
        )

    return F.transform(rows, spread)


def sheet_csv(rows: Column) -> Column:
    """``struct(csv, n_rows, n_cols, numeric_like, errors_found)``."""

    def count(flag: str) -> Column:
        return F.aggregate(rows, F.lit(0), lambda a, r: a + F.size(F.filter(r, lambda c: c[flag])))

    width = F.array_max(F.transform(F.flatten(rows), lambda c: c["col"])) + 1
    return F.struct(
        render_csv(rows_to_grid(rows)).alias("csv"),
        F.size(rows).alias("n_rows"),
        F.coalesce(width, F.lit(0)).alias("n_cols"),
        count("is_number").alias("numeric_like"),
        count("is_error").alias("errors_found"),
    )


# ------------------------------------------------------------------- writing
# The constant parts a word processor or spreadsheet needs.

_XML = '<?xml version="1.0" encoding="UTF-8"?>'
_CT = "http://schemas.openxmlformats.org/package/2006/content-types"
_REL = "http://schemas.openxmlformats.org/package/2006/relationships"
_DOC_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_MAIN = "application/vnd.openxmlformats-officedocument"


def _relationship(kind: str, target: str) -> str:
    return (
        f'{_XML}<Relationships xmlns="{_REL}"><Relationship Id="rId1" '
        f'Type="{_DOC_REL}/{kind}" Target="{target}"/></Relationships>'
    )


def _content_types(*overrides: tuple[str, str]) -> str:
    parts = "".join(f'<Override PartName="/{name}" ContentType="{_MAIN}.{kind}+xml"/>' for name, kind in overrides)
    return (
        f'{_XML}<Types xmlns="{_CT}"><Default Extension="rels" '
        'ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Default Extension="xml" ContentType="application/xml"/>{parts}</Types>'
    )


WORD_CONSTANT_PARTS = {
    "[Content_Types].xml": _content_types((WORD_PART, "wordprocessingml.document.main")),
    "_rels/.rels": _relationship("officeDocument", WORD_PART),
}
SHEET_CONSTANT_PARTS = {
    "[Content_Types].xml": _content_types(
        ("xl/workbook.xml", "spreadsheetml.sheet.main"), (FIRST_SHEET, "spreadsheetml.worksheet")
    ),
    "_rels/.rels": _relationship("officeDocument", "xl/workbook.xml"),
    "xl/workbook.xml": (
        f'{_XML}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
        f'xmlns:r="{_DOC_REL}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>'
    ),
    "xl/_rels/workbook.xml.rels": _relationship("worksheet", "worksheets/sheet1.xml"),
}


def word_xml(text: Column) -> Column:
    """One escaped paragraph per line."""
    paragraphs = F.transform(
        F.split(unix_lines(text), "\n", -1),
        lambda x: F.concat(
            F.lit('<w:p><w:r><w:t xml:space="preserve">'), escape_markup(x), F.lit("</w:t></w:r></w:p>")
        ),
    )
    return F.concat(
        F.lit(
            '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<w:document '
            'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
        ),
        F.array_join(paragraphs, ""),
        F.lit("<w:sectPr/></w:body></w:document>"),
    )


def sheet_xml(grid: Column) -> Column:
    """Numbers as plain cells, everything else as inline strings, references from positions."""

    def row(r: Column, ri: Column) -> Column:
        number = (ri + 1).cast("string")

        def cell(v: Column, ci: Column) -> Column:
            ref = F.concat(F.lit('<c r="'), column_letters(ci), number, F.lit('"'))
            plain = F.concat(ref, F.lit("><v>"), v, F.lit("</v></c>"))
            text = F.concat(
                ref, F.lit(' t="inlineStr"><is><t xml:space="preserve">'), escape_markup(v), F.lit("</t></is></c>")
            )
            return F.when(is_numeric_cell(v), plain).otherwise(text)

        return F.concat(
            F.lit('<row r="'), number, F.lit('">'), F.array_join(F.transform(r, cell), ""), F.lit("</row>")
        )

    return F.concat(
        F.lit(f'{_XML}<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'),
        F.array_join(F.transform(grid, row), ""),
        F.lit("</sheetData></worksheet>"),
    )


def member(name: str, text: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), F.encode(text, "UTF-8").alias("data"))


def word_members(text: Column) -> Column:
    fixed = [member(n, F.lit(x)) for n, x in WORD_CONSTANT_PARTS.items()]
    return F.array(*fixed, member(WORD_PART, word_xml(text)))


def sheet_members(grid: Column) -> Column:
    fixed = [member(n, F.lit(x)) for n, x in SHEET_CONSTANT_PARTS.items()]
    return F.array(*fixed, member(FIRST_SHEET, sheet_xml(grid)))
