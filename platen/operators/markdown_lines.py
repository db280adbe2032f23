"""Markdown blocks over lines as rows, for documents of any number of lines.

Which block a line belongs to depends on all lines before it: a fence stays open, text continues a
list. A line is a function on the states of a small automaton, and functions compose, so the lines
of a document are folded in parallel: bands of lines into one function each, bands of bands likewise,
up to one per document; then the known state at the beginning is handed down again, band by band. A
function also counts the blocks that begin, which numbers them. No task holds more than ``BAND`` rows
of a document at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.markup import BULLET_LINE, FENCE_LINE, HEADING_LINE, NUMBER_LINE, TABLE_LINE, markdown_to_html
from ..functions.text import WS
from ..session import written

BAND = 256
CLASSES = ["fence", "heading", "item", "table", "blank", "text"]
# What may be open between two lines. A fence inside a table belongs to it.
STATES = ["nothing", "paragraph", "list", "table", "code", "code in table"]


def _step(state: str, line: str) -> tuple[str, bool, str | None]:
    """(state after the line, does the line begin a block, kind of its block)."""
    if state == "code":
        return ("nothing" if line == "fence" else state), False, "code"
    if state == "code in table":
        return ("table" if line == "fence" else state), False, "table"
    if line == "fence":
        return ("code in table", False, "table") if state == "table" else ("code", True, "code")
    if line == "blank":
        return "nothing", False, None
    if line == "heading":
        return "nothing", True, "heading"
    if line == "item":
        return "list", state != "list", "list"
    if line == "table":
        return "table", state != "table", "table"
    if state == "list":
        return "list", False, "list"
    return "paragraph", state != "paragraph", "paragraph"


_STEPS = [[_step(s, c) for s in STATES] for c in CLASSES]


def _of_step(pick, kind: str) -> Column:
    """A constant array, by class and state."""
    return F.array(*[F.array(*[F.lit(pick(x)).cast(kind) for x in row]) for row in _STEPS])


def line_class(text: Column) -> Column:
    """Position in ``CLASSES`` of a line without its end; NULL is blank."""
    ended = F.concat(F.coalesce(text, F.lit("")), F.lit("\n"))
    return (
        F.when(ended.rlike(f"^{FENCE_LINE}"), 0)
        .when(ended.rlike(f"^{HEADING_LINE}"), 1)
        .when(ended.rlike(f"^(?:{BULLET_LINE}|{NUMBER_LINE})"), 2)
        .when(ended.rlike(f"^{TABLE_LINE}"), 3)
        .when(ended.rlike(f"^{WS}*$"), 4)
        .otherwise(5)
    )


def _identity() -> Column:
    return F.array(*[F.struct(F.lit(i).alias("to"), F.lit(0).cast("long").alias("n")) for i in range(len(STATES))])


def _after_class(acc: Column, c: Column) -> Column:
    to, begins = F.get(_of_step(lambda x: STATES.index(x[0]), "int"), c), F.get(_of_step(lambda x: int(x[1]), "long"), c)
    return F.transform(acc, lambda x: F.struct(F.get(to, x["to"]).alias("to"), (x["n"] + F.get(begins, x["to"])).alias("n")))


def _after_function(acc: Column, f: Column) -> Column:
    return F.transform(acc, lambda x: F.struct(F.get(f, x["to"])["to"].alias("to"), (x["n"] + F.get(f, x["to"])["n"]).alias("n")))


def _handed_down(members: Column, start: Column, advance) -> Column:
    """Members with the ``state`` (to, n) before each of them."""
    first = F.struct(F.filter(F.transform(members, lambda m: F.struct(m.alias("m"), start.alias("state"))), lambda m: F.lit(False)).alias("done"), start.alias("state"))

    def hold(acc: Column, m: Column) -> Column:
        return F.struct(
            F.array_append(acc["done"], F.struct(m.alias("m"), acc["state"].alias("state"))).alias("done"), advance(acc["state"], m).alias("state")
        )

    return F.aggregate(members, first, hold, lambda acc: acc["done"])


def _advance_class(state: Column, m: Column) -> Column:
    to = F.get(F.get(_of_step(lambda x: STATES.index(x[0]), "int"), m["c"]), state["to"])
    begins = F.get(F.get(_of_step(lambda x: int(x[1]), "long"), m["c"]), state["to"])
    return F.struct(to.alias("to"), (state["n"] + begins).alias("n"))


def _advance_function(state: Column, m: Column) -> Column:
    after = F.get(m["f"], state["to"])
    return F.struct(after["to"].alias("to"), (state["n"] + after["n"]).alias("n"))


def markdown_blocks(lines: DataFrame, band: int = BAND) -> DataFrame:
    """(doc_id, line, block, kind) of (doc_id, line, text); ``block`` counts from 0, NULL with its kind on blank lines.

    ``line`` is a number from 0 without repeats in its document; gaps do no harm. Rows without a document
    or number are left out. Kinds: code, heading, list, table, paragraph. A fence does not close a table,
    text after a list item stays in the list.
    """
    classed = lines.where("doc_id is not null and line is not null").select("doc_id", F.col("line").cast("long").alias("line"), line_class(F.col("text")).alias("c"))
    members = F.array_sort(F.collect_list(F.struct("line", "c")))
    levels = [written(classed.groupBy("doc_id", F.floor(F.col("line") / band).alias("at")).agg(members.alias("members")), "markdown-lines")]
    last = levels[0].agg(F.max("at")).first()[0] or 0
    functions = levels[0].select("doc_id", "at", F.aggregate("members", _identity(), lambda acc, m: _after_class(acc, m["c"])).alias("f"))
    while last > 0:
        grouped = functions.groupBy("doc_id", F.floor(F.col("at") / band).alias("up")).agg(F.array_sort(F.collect_list(F.struct("at", "f"))).alias("members"))
        levels.append(written(grouped.withColumnRenamed("up", "at"), "markdown-lines"))
        functions = levels[-1].select("doc_id", "at", F.aggregate("members", _identity(), lambda acc, m: _after_function(acc, m["f"])).alias("f"))
        last //= band
    start = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
    known = levels[-1].withColumn("state", start)
    for below in reversed(levels[:-1]):
        handed = known.select("doc_id", F.explode(_handed_down(F.col("members"), F.col("state"), _advance_function)).alias("x"))
        known = below.join(handed.select("doc_id", F.col("x.m.at").alias("at"), F.col("x.state").alias("state")), ["doc_id", "at"])
    placed = known.select("doc_id", F.explode(_handed_down(F.col("members"), F.col("state"), _advance_class)).alias("x")).select(
        "doc_id", "x.m.line", "x.m.c", F.col("x.state.to").alias("s"), F.col("x.state.n").alias("n")
    )
    kind = F.get(F.get(_of_step(lambda x: x[2], "string"), F.col("c")), F.col("s"))
    begins = F.get(F.get(_of_step(lambda x: int(x[1]), "long"), F.col("c")), F.col("s"))
    return placed.select("doc_id", "line", F.when(kind.isNotNull(), F.col("n") + begins - 1).alias("block"), kind.alias("kind"))


def block_html(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, block, kind, html): every block rendered on its own; those not empty, joined by line ends, are the document.

    Only the lines of one block meet; a block must fit a row, a document need not.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n")
    rows = lines.select("doc_id", F.col("line").cast("long").alias("line"), "text").join(blocks.where("block is not null"), ["doc_id", "line"])
    return rows.groupBy("doc_id", "block", "kind").agg(text.alias("md")).select("doc_id", "block", "kind", markdown_to_html(F.col("md")).alias("html"))
