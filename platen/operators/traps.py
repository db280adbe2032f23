"""Scoring conversion chains against the catalogue of failure patterns.

A chain is judged from a handful of *facts* (does it hold a tool, does one tool
come before another, which types does it start and end with). The facts can be
read from a steps array inside a row, which needs no shuffle, or gathered from
a long step table with plain mergeable aggregates, which never brings a chain's
steps together in one place. The patterns themselves are written once, on facts.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.sniff import STRIDE_BUDGET
from ..functions.text import WS, is_numeric_cell
from .catalog import TRAPS, TRANSFORMS, WEIGHTS, in_type_of, order_of, out_type_of

# Tools and types the patterns look for.
EXTENSION_DISPATCH = ["office-text", "rename-avif"]
RASTER_TOOLS = ["pdf-rasterize", "png-decode", "png-encode", "png-resize", "png-quality", "rename-avif"]
KNOWN_INPUTS = ["pdf", "docx", "xlsx", "png", "md", "csv", "txt", "html", "zip", "files"]
PACKAGE_TYPES = ["docx", "xlsx", "zip"]
SEQUENCES = [("pdf-rasterize", "ocr"), ("ocr", "summarize")]
WATCHED_TOOLS = sorted(
    {*EXTENSION_DISPATCH, *RASTER_TOOLS, "docx-pdf-soffice", "xlsx-recalc", "pdf-text", "summarize",
     "md-html", "png-tables", "ocr"}
)


class Facts(NamedTuple):
    """Column accessors the patterns are written on."""

    has: Callable[[str], Column]
    sequence: Callable[[str, str], Column]
    quality_param: Column
    oversized_resize: Column
    foreign_font: Column
    package_outputs: Column
    makes_tables: Column
    n_steps: Column
    input_type: Column
    output_type: Column

    def has_any(self, tools: list[str]) -> Column:
        found = self.has(tools[0])
        for tool in tools[1:]:
            found = found | self.has(tool)
        return found

    def round_trip(self) -> Column:
        return self.input_type.eqNullSafe(self.output_type)


# ------------------------------------------------------------ one-step tests


def _side(params: Column, key: str) -> Column:
    value = F.try_element_at(params, F.lit(key))
    return F.coalesce(F.when(is_numeric_cell(value), value.try_cast("double")), F.lit(0.0))


def _has_quality(params: Column) -> Column:
    return F.coalesce(F.map_contains_key(params, F.lit("quality")), F.lit(False))


def _oversized(tool: Column, params: Column) -> Column:
    return (tool == "png-resize") & (_side(params, "w") * _side(params, "h") * 4 > STRIDE_BUDGET)


def _foreign_font(params: Column) -> Column:
    font = F.coalesce(F.try_element_at(params, F.lit("font")), F.lit(""))
    return (font != "") & (F.lower(F.regexp_replace(font, f"{WS}+", "")) != "helvetica")


def _given(value: Column, otherwise: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), otherwise)


# ---------------------------------------------------------- where facts come from


def with_step_types(steps: Column, typed: bool = True) -> Column:
    """Types of a steps array: given ones (``in_type``, ``out_type`` of a step, if ``typed``) win, the catalogue fills the rest."""

    def side(s: Column, name: str, known: Column) -> Column:
        return _given(s[name], known) if typed else known

    return F.transform(
        steps,
        lambda s: F.struct(
            s["tool_id"].alias("tool_id"),
            s["params"].alias("params"),
            side(s, "in_type", in_type_of(s["tool_id"])).alias("in_type"),
            side(s, "out_type", out_type_of(s["tool_id"])).alias("out_type"),
        ),
    )


def row_facts(steps: str = "steps", input_type: str = "input_type", output_type: str = "output_type") -> Facts:
    """Facts read from ``array<struct<tool_id, params, in_type, out_type>>``."""
    s = F.col(steps)
    ids = F.transform(s, lambda x: x["tool_id"])

    def sequence(a: str, b: str) -> Column:
        at = F.array_position(ids, a).cast("int")
        later = F.slice(ids, at + 1, F.size(ids))
        return (at > 0) & F.array_contains(later, b)

    return Facts(
        has=lambda tool: F.array_contains(ids, tool),
        sequence=sequence,
        quality_param=F.exists(s, lambda x: _has_quality(x["params"])),
        oversized_resize=F.exists(s, lambda x: _oversized(x["tool_id"], x["params"])),
        foreign_font=F.exists(s, lambda x: _foreign_font(x["params"])),
        package_outputs=F.size(F.filter(s, lambda x: x["out_type"].isin(PACKAGE_TYPES))),
        makes_tables=F.exists(s, lambda x: F.coalesce(x["out_type"] == "csv-of-tables", F.lit(False))),
        n_steps=F.size(s),
        input_type=_given(F.col(input_type), F.get(s, F.lit(0))["in_type"]),
        output_type=_given(F.col(output_type), F.try_element_at(s, F.lit(-1))["out_type"]),
    )


def gather_facts(steps: DataFrame, key: str = "chain_id", attributes: tuple[str, ...] = ()) -> DataFrame:
    """One row of facts per chain from ``(key, idx, tool_id, params[, in_type, out_type])`` rows.

    Only mergeable aggregates: partial results are built before the shuffle, so a chain with very
    many rows costs no task more than its own partitions. Without given types all values have a
    fixed width, which keeps the aggregation in hash tables. ``attributes`` names numeric columns
    whose value at step 0 is a property of the chain.
    """
    tool, idx = F.col("tool_id"), F.col("idx")
    unknown = len(TRANSFORMS)

    def side(name: str, known: Column) -> Column:
        return _given(F.col(name), known) if name in steps.columns else known

    def end(first_or_last: Callable[[Column], Column], name: str, types: list[str]) -> Column:
        """Type at the first or last step, from the given types or from position and tool packed in one number."""
        if {"in_type", "out_type"} & set(steps.columns):
            return first_or_last(F.struct(idx, name)).getField(name)
        packed = idx.cast("bigint") * (unknown + 1) + F.coalesce(order_of(tool), F.lit(unknown))
        return F.get(F.array(*[F.lit(t) for t in types]), (first_or_last(packed) % (unknown + 1)).cast("int"))

    typed = steps.withColumns({"_in": side("in_type", in_type_of(tool)), "_out": side("out_type", out_type_of(tool))})
    aggregates = [F.bool_or(tool == t).alias(f"has_{t}") for t in WATCHED_TOOLS]
    for a, b in SEQUENCES:
        ordered = F.min(F.when(tool == a, idx)) < F.max(F.when(tool == b, idx))
        aggregates.append(F.coalesce(ordered, F.lit(False)).alias(f"seq_{a}_{b}"))
    return typed.groupBy(key).agg(
        *aggregates,
        F.bool_or(_has_quality(F.col("params"))).alias("quality_param"),
        F.bool_or(_oversized(tool, F.col("params"))).alias("oversized_resize"),
        F.bool_or(_foreign_font(F.col("params"))).alias("foreign_font"),
        F.count_if(F.col("_out").isin(PACKAGE_TYPES)).alias("package_outputs"),
        F.coalesce(F.bool_or(F.col("_out") == "csv-of-tables"), F.lit(False)).alias("makes_tables"),
        F.count(F.lit(1)).alias("n_steps"),
        end(F.min, "_in", [t.in_type for t in TRANSFORMS]).alias("first_in"),
        end(F.max, "_out", [t.out_type for t in TRANSFORMS]).alias("last_out"),
        *[F.min(F.when(idx == 0, F.col(a))).alias(a) for a in attributes],
    )


def gathered_facts() -> Facts:
    """Facts over the columns of ``gather_facts`` plus ``input_type`` and ``output_type``."""
    return Facts(
        has=lambda tool: F.col(f"`has_{tool}`"),
        sequence=lambda a, b: F.col(f"`seq_{a}_{b}`"),
        quality_param=F.col("quality_param"),
        oversized_resize=F.col("oversized_resize"),
        foreign_font=F.col("foreign_font"),
        package_outputs=F.col("package_outputs"),
        makes_tables=F.col("makes_tables"),
        n_steps=F.col("n_steps"),
        input_type=_given(F.col("input_type"), F.col("first_in")),
        output_type=_given(F.col("output_type"), F.col("last_out")),
    )


# ------------------------------------------------------------------- patterns

NEVER = None  # only evidence can fire it

PLAN: dict[str, Callable[[Facts], Column] | None] = {
    "T01": lambda f: f.sequence("pdf-rasterize", "ocr"),
    "T02": lambda f: f.has_any(EXTENSION_DISPATCH),
    "T03": lambda f: f.has("rename-avif") | (f.round_trip() & (f.n_steps > 1) & f.has_any(RASTER_TOOLS)),
    "T04": lambda f: f.has("docx-pdf-soffice"),
    "T05": lambda f: f.has("xlsx-recalc"),
    "T06": lambda f: f.has("png-quality") | f.quality_param,
    "T07": lambda f: f.has("pdf-text") & f.has_any(["summarize", "md-html"]),
    "T08": lambda f: f.oversized_resize,
    "T09": lambda f: f.has("png-tables") | f.sequence("ocr", "summarize") | (f.has("ocr") & f.makes_tables),
    "T10": lambda f: f.foreign_font,
    "T11": lambda f: f.package_outputs > 2,
    "T12": lambda f: ~F.coalesce(f.input_type.isin(KNOWN_INPUTS), F.lit(False)),
    "T13": NEVER,
    "T14": lambda f: f.has_any(["ocr", "pdf-rasterize"])
    & F.coalesce(f.output_type.isin("csv", "csv-of-tables"), F.lit(False)),
    "T15": lambda f: f.has_any(["png-quality", "ocr"]) & f.round_trip(),
}
NOTE_KEYS = {
    "T01": "inkParadox", "T04": "emptyOutput", "T05": "cellErrors", "T06": "qualityIgnored",
    "T07": "orderDiffers", "T08": "strideWarn", "T09": "emptyResult", "T13": "magicMismatch",
}
SILENCED_BY = {"T14": "T09"}  # does not fire when the other one did, on any basis

EMPTY_NOTES = "cast(map() as map<string,string>)"


def clean_notes(notes: Column) -> Column:
    """Drop empty and false flags; keys and values stay whole."""
    kept = F.map_filter(notes, lambda k, v: v.isNotNull() & (v != "") & (v != "false"))
    return F.coalesce(kept, F.expr(EMPTY_NOTES))


def merge_notes(earlier: Column, later: Column) -> Column:
    """Union of two note maps; on a shared key the later one wins."""
    return F.map_concat(F.map_filter(earlier, lambda k, _: ~F.map_contains_key(later, k)), later)


def _noted(notes: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(notes, F.lit(key)), F.lit(False))


def with_verdict(
    df: DataFrame,
    facts: Facts,
    measured: Column | None = None,
    claimed: Column | None = None,
    mode: str = "clamp",
) -> DataFrame:
    """Add ``hits``, ``penalty``, ``score`` and ``stars``.

    Basis of a hit: ``plan`` if the chain alone fires it, else ``measured`` if
    evidence derived from the bytes does, else ``claimed``.
    """
    if mode not in ("clamp", "raw"):
        raise ValueError("mode must be clamp or raw")
    basis: dict[str, Column] = {}
    for trap in TRAPS:
        chain = F.when(PLAN[trap.id](facts), "plan") if PLAN[trap.id] else F.when(F.lit(False), "plan")
        if trap.id in NOTE_KEYS:
            if measured is not None:
                chain = chain.when(_noted(measured, NOTE_KEYS[trap.id]), "measured")
            if claimed is not None:
                chain = chain.when(_noted(claimed, NOTE_KEYS[trap.id]), "claimed")
        if trap.id in SILENCED_BY:
            chain = F.when(F.col(f"_{SILENCED_BY[trap.id]}").isNull(), chain)
        basis[trap.id] = chain

    out = df
    dependent = set(SILENCED_BY)
    for ids in ([t.id for t in TRAPS if t.id not in dependent], sorted(dependent)):
        out = out.withColumns({f"_{i}": basis[i] for i in ids})

    all_hits = F.array(
        *[
            F.struct(
                F.lit(t.id).alias("trap_id"),
                F.lit(t.severity).alias("severity"),
                F.lit(WEIGHTS[t.severity]).alias("weight"),
                F.lit(t.title).alias("title"),
                F.lit(t.lesson).alias("lesson"),
                F.col(f"_{t.id}").alias("basis"),
            )
            for t in TRAPS
        ]
    )
    penalty = sum(
        (F.when(F.col(f"_{t.id}").isNotNull(), WEIGHTS[t.severity]).otherwise(0) for t in TRAPS), F.lit(0)
    )
    score = 100 - F.col("penalty")
    score = F.greatest(F.lit(0), score) if mode == "clamp" else score
    stars = F.floor(F.col("score") / 10 + 0.5) / 2
    return (
        out.withColumn("hits", F.filter(all_hits, lambda h: h["basis"].isNotNull()))
        .withColumn("penalty", penalty)
        .withColumn("score", score)
        .withColumn("stars", F.greatest(F.lit(0.0), F.least(F.lit(5.0), stars)))
        .drop(*[f"_{t.id}" for t in TRAPS])
    )


def score_chains(chains: DataFrame, mode: str = "clamp") -> DataFrame:
    """Verdict per row of ``(steps array, input_type, output_type[, measured, claimed])``; no shuffle."""
    measured = F.col("measured") if "measured" in chains.columns else None
    claimed = F.col("claimed") if "claimed" in chains.columns else None
    given = "in_type" in chains.schema["steps"].dataType.elementType.names
    typed = chains.withColumn("steps", with_step_types(F.col("steps"), given))
    return with_verdict(typed, row_facts(), measured, claimed, mode)


def score_steps(
    steps: DataFrame, chains: DataFrame | None = None, key: str = "chain_id", mode: str = "clamp",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Verdict per chain of a long step table, joined with chain attributes and evidence by key.

    ``keep`` names attribute columns to carry into the result.
    """
    return score_facts(with_attributes(gather_facts(steps, key), chains, key), key, mode, keep)


def with_attributes(facts: DataFrame, chains: DataFrame | None, key: str = "chain_id") -> DataFrame:
    return facts if chains is None else facts.join(chains, key, "left")


def score_facts(facts: DataFrame, key: str = "chain_id", mode: str = "clamp", keep: tuple[str, ...] = ()) -> DataFrame:
    """Verdict per row of gathered facts with input and output type and evidence, where there are any."""
    for column in ("input_type", "output_type"):
        if column not in facts.columns:
            facts = facts.withColumn(column, F.lit(None).cast("string"))
    measured = F.col("measured") if "measured" in facts.columns else None
    claimed = F.col("claimed") if "claimed" in facts.columns else None
    verdicts = with_verdict(facts, gathered_facts(), measured, claimed, mode)
    return verdicts.select(key, "n_steps", "hits", "penalty", "score", "stars", *keep)


def score_with_and_without_evidence(facts: DataFrame, key: str = "chain_id") -> DataFrame:
    """Both verdicts of the same facts in one row: ``before`` from the plan alone, ``after`` with evidence."""
    plain = with_verdict(facts, gathered_facts()).withColumn("before", F.struct("hits", "score"))
    plain = plain.drop("hits", "penalty", "score", "stars")
    judged = with_verdict(plain, gathered_facts(), F.col("measured"), F.col("claimed"))
    return judged.select(key, "before", F.struct("hits", "score").alias("after"))


def explode_hits(verdicts: DataFrame, *keys: str) -> DataFrame:
    """One row per hit.

    The outer form plus a filter on its output: a plain explode would make the
    optimizer push a test for empty hits below the scoring and score twice.
    """
    return verdicts.select(*keys, F.explode_outer("hits").alias("h")).select(*keys, "h.*").filter("trap_id is not null")


def prevalence(verdicts: DataFrame, traps: DataFrame) -> DataFrame:
    """Hits per pattern and basis; patterns nothing hit stay with a zero count."""
    counts = (
        explode_hits(verdicts)
        .groupBy("trap_id", "basis")
        .agg(F.count(F.lit(1)).alias("n_hits"))
    )
    return traps.join(counts, "trap_id", "left").select(
        "trap_id", "severity", "weight", "basis", F.coalesce("n_hits", F.lit(0).cast("bigint")).alias("n_hits")
    )


def trap_dossiers(requests: DataFrame, traps: DataFrame) -> DataFrame:
    """Requests ``(trap_id)`` with title, weight and lesson; an id outside the catalogue gives the error ``not_found``."""
    return requests.join(traps, "trap_id", "left").withColumn("error", F.when(F.col("title").isNull(), "not_found"))
