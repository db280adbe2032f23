"""The dimension tables: transforms, failure patterns, inputs, goals and routes.

All of them are constants of at most a few dozen rows. As tables they are local
relations and always broadcast; inside array functions they are literal maps.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.lang import lookup


class Transform(NamedTuple):
    id: str
    label: str
    in_type: str
    out_type: str
    mode: str
    traps: tuple[str, ...] = ()


class Trap(NamedTuple):
    id: str
    severity: str
    title: str
    lesson: str


# The transform catalogue, in matching order.
TRANSFORMS = [
    Transform("pdf-text", "pdf → text", "pdf", "txt", "real", ("T07",)),
    Transform("pdf-rasterize", "pdf → png (paint)", "pdf", "png", "real", ("T01",)),
    Transform("text-pdf", "text → pdf", "txt", "pdf", "real", ("T10",)),
    Transform("md-html", "markdown → html", "md", "html", "real", ("T07",)),
    Transform("html-md", "html → markdown", "html", "md", "real"),
    Transform("html-text", "html → text", "html", "txt", "real"),
    Transform("md-pdf", "markdown → pdf", "md", "pdf", "real", ("T10",)),
    Transform("text-md", "text → markdown", "txt", "md", "real"),
    Transform("docx-text", "docx → text (via zip)", "docx", "txt", "real", ("T02", "T11")),
    Transform("text-docx", "text → docx (pack)", "txt", "docx", "real", ("T11",)),
    Transform("xlsx-csv", "xlsx → csv (sheet1)", "xlsx", "csv", "real", ("T05", "T11")),
    Transform("csv-xlsx", "csv → xlsx (pack)", "csv", "xlsx", "real", ("T11",)),
    Transform("csv-md", "csv → markdown table", "csv", "md", "real"),
    Transform("png-decode", "png → RGBA pixels", "png", "rgba", "real", ("T08",)),
    Transform("png-encode", "RGBA → png", "rgba", "png", "real", ("T03",)),
    Transform("png-resize", "png → png (resize)", "png", "png", "real", ("T08",)),
    Transform("png-quality", "png → png (quality q)", "png", "png", "real", ("T06",)),
    Transform("zip-pack", "files → zip (store)", "files", "zip", "real", ("T11",)),
    Transform("zip-unpack", "zip → files", "zip", "files", "real", ("T11",)),
    Transform("ocr", "png → text (OCR)", "png", "txt", "simulated", ("T01", "T09")),
    Transform("docx-pdf-soffice", "docx → pdf (soffice-like)", "docx", "pdf", "simulated", ("T04",)),
    Transform("xlsx-recalc", "xlsx → xlsx (recalc)", "xlsx", "xlsx", "simulated", ("T05",)),
    Transform("office-text", "doc/rtf → text (legacy)", "doc", "txt", "simulated", ("T02", "T12")),
    Transform("rename-avif", 'png → "avif" (renamed)', "png", "png", "simulated", ("T03", "T13")),
    Transform("summarize", "text → summary", "txt", "txt", "simulated", ("T07", "T09")),
    Transform("png-tables", "png → csv-of-tables (scan)", "png", "csv-of-tables", "simulated", ("T09", "T14")),
]

# Severities with their weights, and the titles of the patterns.
WEIGHTS = {"high": 30, "medium": 15, "low": 8}
PASS_SCORE = 100
TRAPS = [
    Trap("T01", "high", "OCR after render on an image-only PDF",
         "Measure ink before trusting text that was read from a rendered page."),
    Trap("T02", "medium", "Extension-based dispatch inside a pipeline",
         "Choose the parser by the first bytes, not by the file name."),
    Trap("T03", "medium", "Round-trip through a converter that re-encodes",
         "Check the signature after every conversion; the format may not be the one asked for."),
    Trap("T04", "high", "exit 0 with no output file",
         "A success code says nothing about the file: require one, and require it non-empty."),
    Trap("T05", "medium", "Recalculate without validating",
         "Read the error list of a spreadsheet step, not only its return code."),
    Trap("T06", "medium", "Quality / compression parameter silently ignored",
         "Compare outputs at both ends of a setting before relying on it."),
    Trap("T07", "low", "Extraction order is not visual order",
         "Compare stream order with position order before summarising."),
    Trap("T08", "medium", "Declared size vs decode stride budget",
         "Check the decoded buffer size from the header before decoding."),
    Trap("T09", "high", "Silent empty result",
         "Zero rows without an error is a failure: assert that something was extracted."),
    Trap("T10", "medium", "Requested face may be substituted",
         "Check the embedded fonts after export."),
    Trap("T11", "low", "Zip-ratio accounting on chained intermediates",
         "Budget inflated bytes across the whole chain, not step by step."),
    Trap("T12", "high", "Unknown input type, name-only routing",
         "If no parser can read the input structurally, every output is a guess."),
    Trap("T13", "high", "Declared output format vs actual bytes",
         "Trust the signature over the label."),
    Trap("T14", "medium", "Extraction from a scan, asserted by absence",
         "Expect no tables from a scan and say so explicitly."),
    Trap("T15", "low", "Lossy step in a chain that claims a round trip",
         "Equal types at both ends do not mean equal content."),
]

# Default input per type (first match wins) and the goal types.
INPUTS = [
    ("pdf", "pdf-doc"), ("docx", "docx-memo"), ("xlsx", "xlsx-sales"), ("png", "png-scan"),
    ("md", "md-notes"), ("html", "html-notes"), ("csv", "csv-sales"), ("txt", "txt-plain"),
    ("zip", "zip-packed"), ("files", "zip-parts"), ("doc", "doc-legacy"), ("scan", "png-scan"),
    ("pdf", "png-bytes-named-pdf"),
]
GOAL_TYPES = ["txt", "csv", "csv-of-tables", "pdf", "png", "md", "html", "xlsx"]

# The routing edges, in search order.
ROUTES = [
    ("txt", "pdf", ("text-pdf",)), ("txt", "md", ("text-md",)), ("txt", "docx", ("text-docx",)),
    ("md", "html", ("md-html",)), ("md", "pdf", ("md-pdf",)), ("html", "md", ("html-md",)),
    ("html", "txt", ("html-text",)), ("pdf", "txt", ("pdf-text",)), ("pdf", "png", ("pdf-rasterize",)),
    ("docx", "txt", ("docx-text",)), ("docx", "md", ("docx-text", "text-md")),
    ("docx", "pdf", ("docx-text", "text-pdf")), ("xlsx", "csv", ("xlsx-csv",)),
    ("csv", "xlsx", ("csv-xlsx",)), ("csv", "md", ("csv-md",)), ("png", "txt", ("ocr",)),
    ("png", "rgba", ("png-decode",)), ("png", "pdf", ("ocr", "text-pdf")),
    ("zip", "files", ("zip-unpack",)), ("files", "zip", ("zip-pack",)),
]

# Fixed value: types that carry decoded text next to their bytes.
TEXT_TYPES = ["txt", "md", "csv", "html", "csv-of-tables"]

BY_ID = {t.id: t for t in TRANSFORMS}


# -------------------------------------------------------------- literal maps


def label_of(tool: Column) -> Column:
    return lookup({t.id: t.label for t in TRANSFORMS}, tool)


def in_type_of(tool: Column) -> Column:
    return lookup({t.id: t.in_type for t in TRANSFORMS}, tool)


def out_type_of(tool: Column) -> Column:
    return lookup({t.id: t.out_type for t in TRANSFORMS}, tool)


def mode_of(tool: Column) -> Column:
    return lookup({t.id: t.mode for t in TRANSFORMS}, tool)


def order_of(tool: Column) -> Column:
    return lookup({t.id: str(i) for i, t in enumerate(TRANSFORMS)}, tool).cast("int")


def connectors() -> dict[str, str]:
    """Bridge for every type pair: the first one-hop transform, else the first of two hops."""
    sources = {t.in_type for t in TRANSFORMS}
    targets = {t.out_type for t in TRANSFORMS} | sources
    found: dict[str, str] = {}
    for a in sources:
        for b in targets:
            direct = next((t.id for t in TRANSFORMS if t.in_type == a and t.out_type == b), None)
            via = next(
                (
                    t.id
                    for t in TRANSFORMS
                    if t.in_type == a and any(u.in_type == t.out_type and u.out_type == b for u in TRANSFORMS)
                ),
                None,
            )
            if direct or via:
                found[f"{a}>{b}"] = direct or f"{via} → …"
    return found


def connector_between(source: Column, target: Column) -> Column:
    return lookup(connectors(), F.concat(source, F.lit(">"), target))


# -------------------------------------------------------------------- tables


def _sql(value) -> str:
    if isinstance(value, (tuple, list)):
        return f"cast(array({', '.join(_sql(v) for v in value)}) as array<string>)"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _table(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    body = ", ".join("(" + ", ".join(_sql(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def transforms(spark: SparkSession) -> DataFrame:
    rows = [(i, t.id, t.label, t.in_type, t.out_type, t.mode, t.traps) for i, t in enumerate(TRANSFORMS)]
    return _table(spark, "ord, tool_id, label, in_type, out_type, mode, traps", rows)


def traps(spark: SparkSession) -> DataFrame:
    rows = [(t.id, t.severity, WEIGHTS[t.severity], t.title, t.lesson) for t in TRAPS]
    return _table(spark, "trap_id, severity, weight, title, lesson", rows)


def inputs(spark: SparkSession) -> DataFrame:
    return _table(spark, "ord, type, document", [(i, *r) for i, r in enumerate(INPUTS)])


def route_edges(spark: SparkSession) -> DataFrame:
    return _table(spark, "ord, from_type, to_type, steps", [(i, *r) for i, r in enumerate(ROUTES)])


def routes(spark: SparkSession) -> DataFrame:
    """Steps for every reachable pair: the direct edge, else the first two-edge path in edge order."""
    edges = route_edges(spark)
    first, second = edges.alias("a"), edges.alias("b")
    two = (
        first.join(F.broadcast(second), F.col("a.to_type") == F.col("b.from_type"))
        .select(
            (F.col("a.ord") + 1000).alias("ord"),
            F.col("a.from_type"),
            F.col("b.to_type"),
            F.concat("a.steps", "b.steps").alias("steps"),
        )
        .filter("from_type <> to_type")
    )
    return edges.unionByName(two).groupBy("from_type", "to_type").agg(F.min_by("steps", "ord").alias("steps"))
