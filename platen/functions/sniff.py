"""Byte-signature sniffing, header reading and declared-type checks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .lang import lookup
from .text import WS

# Fixed values: (type, signature bytes in hex, byte offset, printed name), first match wins.
SIGNATURES = [
    ("png", "89504E470D0A1A0A", 0, "PNG"),
    ("zip", "504B0304", 0, "ZIP (stored/deflate container)"),
    ("zip", "504B504B", 0, "ZIP (empty)"),
    ("pdf", "25504446", 0, "PDF (%PDF)"),
    ("jpeg", "FFD8FF", 0, "JPEG"),
    ("gif", "47494638", 0, "GIF"),
    ("avif", "6674797061766966", 4, "AVIF (ftypavif)"),
]
EMPTY_ARCHIVE = ("zip", "504B0506", 0, "ZIP (no entries)")
HEAD_BYTES = 512
PRINTABLE_SHARE = 0.92
PROLOG = f"(?i)^{WS}*(?:<\\?xml|<html|<!doctype)"

# Which signature a declared type must carry, per check.
INTAKE_EXPECTS = {"png": "png", "pdf": "pdf", "docx": "zip", "xlsx": "zip", "zip": "zip"}
ARTIFACT_EXPECTS = {**INTAKE_EXPECTS, "avif": "avif", "jpeg": "jpeg", "gif": "gif"}
SNIFF_TO_TYPE = {
    "png": "png", "zip": "zip", "pdf": "pdf", "text": "txt", "xml-or-html": "html",
    "jpeg": "unknown", "gif": "unknown", "avif": "unknown", "unknown": "unknown",
}

STRIDE_BUDGET = 64 * 1024 * 1024


def _starts(content: Column, hex_bytes: str, offset: int) -> Column:
    raw = bytes.fromhex(hex_bytes)
    return F.substring(content, offset + 1, len(raw)) == F.lit(raw)


def head_text(content: Column) -> Column:
    return F.decode(F.substring(content, 1, HEAD_BYTES), "ISO-8859-1")


def printable_ratio(content: Column) -> Column:
    """Share of tab, newline, return and ASCII graphic bytes among the first 512."""
    head = head_text(content)
    kept = F.length(F.regexp_replace(head, r"[^\t\n\r\x20-\x7e]", ""))
    return F.coalesce(F.try_divide(kept.cast("double"), F.length(head).cast("double")), F.lit(0.0))


def sniff(content: Column, detect_empty_archive: bool = False) -> Column:
    """``struct(type, magic, confident)`` from the first bytes alone."""

    def verdict(kind: str, magic: str, confident: bool) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(magic).alias("magic"), F.lit(confident).alias("confident"))

    signatures = SIGNATURES + ([EMPTY_ARCHIVE] if detect_empty_archive else [])
    chain = F
    for kind, hex_bytes, offset, name in signatures:
        chain = chain.when(_starts(content, hex_bytes, offset), verdict(kind, name, True))
    return (
        chain.when(head_text(content).rlike(PROLOG), verdict("xml-or-html", "markup prolog", True))
        .when(printable_ratio(content) > PRINTABLE_SHARE, verdict("text", "printable bytes only", False))
        .otherwise(verdict("unknown", "no known signature", False))
    )


def declared_or_sniffed(declared: Column, sniffed_type: Column) -> Column:
    return F.coalesce(declared, lookup(SNIFF_TO_TYPE, sniffed_type), F.lit("unknown"))


def intake_mismatch(declared: Column, sniffed_type: Column) -> Column:
    """True only when the declared type has a known signature and the bytes lack it."""
    expect = lookup(INTAKE_EXPECTS, declared)
    return expect.isNotNull() & (expect != sniffed_type)


def png_dims(content: Column) -> Column:
    """``struct(width, height)`` from the image header; NULL if it is not one."""

    def u32(start: int) -> Column:
        return F.conv(F.hex(F.substring(content, start, 4)), 16, 10).cast("bigint")

    ok = (F.octet_length(content) >= 24) & _starts(content, "8950", 0)
    return F.when(ok, F.struct(u32(17).alias("width"), u32(21).alias("height")))


def stride_bytes(dims: Column) -> Column:
    """Size of the RGBA buffer the header promises."""
    return dims["width"] * dims["height"] * 4


def content_size(content: Column, text: Column, files: Column | None = None) -> Column:
    """Bytes if present, else encoded text, else the sum of the parts, else 0."""
    parts = [F.octet_length(content).cast("bigint"), F.octet_length(text).cast("bigint")]
    if files is not None:
        parts.append(F.aggregate(files, F.lit(0).cast("bigint"), lambda a, f: a + f["bytes"]))
    return F.coalesce(*parts, F.lit(0).cast("bigint"))
