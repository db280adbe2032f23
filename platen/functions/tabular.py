"""CSV held in a column: parse, quote, render, pipe tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .lang import let
from .text import is_blank

# A quote opens a quoted region anywhere in a field. Possessive quantifiers
# keep the match iterative, so a very long field cannot exhaust the stack.
_QUOTED = r'"(?:[^"]++|"")*+"'
_RECORD = rf'((?:[^"\r\n]++|{_QUOTED})*+)(?:\r\n|\r|\n|\z)'
_FIELD = rf'((?:[^",]++|{_QUOTED})*+),'
_UNQUOTE = r'"((?:[^"]++|"")*+)"'


def _close_quote(text: Column) -> Column:
    """An odd number of quotes means the last region never closes: it runs to the end."""
    quotes = F.length(F.regexp_replace(text, '[^"]', ""))
    return F.when(quotes % 2 == 1, F.concat(text, F.lit('"'))).otherwise(text)


def _field_value(raw: Column) -> Column:
    return F.replace(F.regexp_replace(raw, _UNQUOTE, "$1"), F.lit('""'), F.lit('"'))


def parse_csv(text: Column) -> Column:
    """Rows of string fields; CR, LF and CRLF end a row, a row of one blank field is dropped."""

    def fields(record: Column) -> Column:
        raw = F.regexp_extract_all(F.concat(record, F.lit(",")), F.lit(_FIELD), F.lit(1))
        return F.transform(raw, _field_value)

    records = F.regexp_extract_all(_close_quote(text), F.lit(_RECORD), F.lit(1))
    return F.filter(
        F.transform(records, fields),
        lambda row: ~((F.size(row) == 1) & is_blank(row[0])),
    )


def csv_cell(v: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(v.rlike(r'[",\r\n]'), quoted).otherwise(v)


def grid_width(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))


def pad_rows(rows: Column) -> Column:
    """Pad ragged rows with empty cells up to the widest one."""

    def pad(width: Column) -> Column:
        return F.transform(
            rows,
            lambda row: F.concat(row, F.array_repeat(F.lit(""), width - F.size(row))),
        )

    return let(grid_width(rows), pad)


def render_csv(rows: Column) -> Column:
    """Grid to CSV text: quoted where needed, padded, CRLF after every row."""
    lines = F.transform(
        pad_rows(rows),
        lambda row: F.concat(F.array_join(F.transform(row, csv_cell), ","), F.lit("\r\n")),
    )
    return F.array_join(lines, "")


def csv_to_markdown(text: Column) -> Column:
    """``struct(md, n_rows, n_cols)``: a pipe table with the first record as header."""

    def cell(c: Column) -> Column:
        return F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), r"\r?\n", " ")

    def line(row: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |\n"))

    def table(rows: Column) -> Column:
        clean = F.transform(pad_rows(rows), lambda row: F.transform(row, cell))
        return let(
            clean,
            lambda g: F.concat(
                line(g[0]),
                line(F.transform(g[0], lambda _: F.lit("---"))),
                F.array_join(F.transform(F.slice(g, F.lit(2), F.size(g)), line), ""),
            ),
        )

    def result(rows: Column) -> Column:
        return F.struct(
            F.when(F.size(rows) == 0, "_no rows_\n").otherwise(table(rows)).alias("md"),
            F.size(rows).alias("n_rows"),
            grid_width(rows).alias("n_cols"),
        )

    return let(parse_csv(text), result)
