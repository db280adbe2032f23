"""Queries on tables whose groups may hold any share of the rows: long chains, documents, pages, files, stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import tabular
from ..operators import markdown_lines, reading_order, runs, step_tables, stored
from ..operators.catalog import TRAPS, WEIGHTS
from ..session import shared_folder
from ..sources import csv_split, views
from . import sql
from .chains import _CURRENT
from .registry import query

# ------------------------------------------------------------------------ files


@query(
    "csv_split_scan",
    """SELECT doc_id::VARCHAR AS doc_id, nullif(source, '') AS source, nullif('"' || left(text, 7) || '", ' || text, '') AS body FROM documents""",
)
def csv_split_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as CSV, quotes and line ends in their texts, and read by byte ranges."""
    body = F.concat(F.lit('"'), F.left("text", F.lit(7)), F.lit('", '), "text")
    cells = F.transform(F.array(F.col("doc_id").cast("string"), "source", body), lambda c: F.coalesce(tabular.csv_cell(c), F.lit("")))
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    views.table(spark, d, "documents").select(F.array_join(cells, ",")).write.option("lineSep", "\r\n").text(path)
    return csv_split.scan_csv(spark, path, columns=["doc_id", "source", "body"])


# ----------------------------------------------------------------------- chains


@query("step_table_errors", f"WITH {_CURRENT} SELECT chain_id, kind, step, message, fix, bridge FROM issues")
def step_table_errors(spark: SparkSession, d: str) -> DataFrame:
    """The step table is judged as it is: no chain becomes an array."""
    return step_tables.validate_steps(views.steps(spark, d), views.chain_attributes(spark, d))


@query(
    "step_table_states",
    f"""WITH {_CURRENT}
    SELECT e.chain_id, e.ends_at, e.goal, coalesce(i.n, 0) AS n_errors, coalesce(w.n, 0) AS n_warnings, i.n IS NULL AS ok
    FROM ends e
    LEFT JOIN (SELECT chain_id, count(*) AS n FROM issues GROUP BY 1) i USING (chain_id)
    LEFT JOIN (SELECT chain_id, count(*) AS n FROM steps WHERE mode = 'simulated' GROUP BY 1) w USING (chain_id)""",
)
def step_table_states(spark: SparkSession, d: str) -> DataFrame:
    return step_tables.chain_states(views.steps(spark, d), views.chain_attributes(spark, d))


_CHAIN_OF, _IDX_OF = (
    "event_id // 12 * 4 + CASE WHEN r >= 6 THEN 3 WHEN r >= 3 THEN 2 WHEN r >= 1 THEN 1 ELSE 0 END AS chain_id",
    "CAST(r - CASE WHEN r >= 6 THEN 6 WHEN r >= 3 THEN 3 WHEN r >= 1 THEN 1 ELSE 0 END AS INTEGER) AS idx",
)
assert _CHAIN_OF in _CURRENT and _IDX_OF in _CURRENT
_LONG = _CURRENT.replace(_CHAIN_OF, "CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id // 12 + 1 END AS chain_id").replace(
    _IDX_OF, "CAST(CASE WHEN event_id % 3 = 0 THEN event_id // 3 ELSE event_id % 12 - 1 END AS INTEGER) AS idx"
)


def _one_long_chain(spark: SparkSession, d: str) -> DataFrame:
    """A third of all steps in one chain."""
    e, hot = F.col("event_id"), F.col("event_id") % 3 == 0
    return views.steps(spark, d).withColumns({
        "chain_id": F.when(hot, F.lit(0).cast("long")).otherwise(F.floor(e / 12) + 1),
        "idx": F.when(hot, F.floor(e / 3)).otherwise(e % 12 - 1).cast("int"),
    })


@query("long_chain_types", f"WITH {_LONG} SELECT chain_id, idx, tool_id, current FROM typed")
def long_chain_types(spark: SparkSession, d: str) -> DataFrame:
    steps = _one_long_chain(spark, d)
    chains = views.with_attributes(steps.where("idx = 0").select("chain_id", "k"))
    return step_tables.typed_steps(steps, chains, band=512).select("chain_id", "idx", "tool_id", "current")


# --------------------------------------------------------------------- markdown

_CLASS_SQL = r"""CASE WHEN regexp_matches(line, '^\s*```') THEN 'fence'
    WHEN regexp_matches(line, '^#{1,6}\s+\S') THEN 'heading'
    WHEN regexp_matches(line, '^\s*[-*+]\s+\S') OR regexp_matches(line, '^\s*[0-9]+[.)]\s+\S') THEN 'item'
    WHEN regexp_matches(line, '^\s*\|.+\|\s*$') THEN 'table' WHEN trim(line, ' ' || chr(9) || chr(13)) = '' THEN 'blank' ELSE 'text' END"""


def _line_of(x: str, i: str) -> str:
    """The markdown that ``views.marked_up_text`` makes of a line."""
    word = f"split_part({x}, ' ', 1)"
    return f"""CASE WHEN {i} % 17 = 0 THEN '## ' || {x} WHEN {i} % 17 IN (2, 3) THEN '- ' || {x}
      WHEN {i} % 17 = 5 THEN '1. **' || {word} || '** ' || {x} WHEN {i} % 17 IN (7, 9, 10) THEN '| ' || {word} || ' | `x<y` |'
      WHEN {i} % 17 = 8 THEN '| --- | :-: |' WHEN {i} % 17 IN (11, 13) THEN '```'
      WHEN {i} % 17 = 14 THEN 'see [the ' || {word} || '](https://example.test/' || {word} || ') *now*'
      WHEN {i} % 17 = 15 THEN '' ELSE {x} END"""


@query(
    "markdown_blocks",
    f"""WITH RECURSIVE lines AS (
      SELECT doc_id, i AS n, {_line_of('x', 'i')} AS line FROM (
        SELECT doc_id, unnest(a) AS x, unnest(range(len(a))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))),
    classed AS (SELECT doc_id, n, {_CLASS_SQL} AS c FROM lines),
    walk AS (
      SELECT doc_id, -1::BIGINT AS n, 'none' AS open, -1::BIGINT AS block, NULL::VARCHAR AS kind FROM (SELECT DISTINCT doc_id FROM classed)
      UNION ALL
      SELECT w.doc_id, w.n + 1,
        CASE WHEN open = 'code' THEN CASE WHEN c = 'fence' THEN 'none' ELSE 'code' END
             WHEN open = 'tablecode' THEN CASE WHEN c = 'fence' THEN 'table' ELSE 'tablecode' END
             WHEN c = 'fence' THEN CASE WHEN open = 'table' THEN 'tablecode' ELSE 'code' END
             WHEN c IN ('blank', 'heading') THEN 'none' WHEN c = 'item' THEN 'list' WHEN c = 'table' THEN 'table'
             WHEN open = 'list' THEN 'list' ELSE 'paragraph' END,
        block + CASE WHEN open IN ('code', 'tablecode') THEN 0 WHEN c = 'fence' THEN (open <> 'table')::INT WHEN c = 'blank' THEN 0
             WHEN c = 'heading' THEN 1 WHEN c = 'item' THEN (open <> 'list')::INT WHEN c = 'table' THEN (open <> 'table')::INT
             ELSE (open NOT IN ('list', 'paragraph'))::INT END,
        CASE WHEN open = 'code' THEN 'code' WHEN open = 'tablecode' THEN 'table'
             WHEN c = 'fence' THEN CASE WHEN open = 'table' THEN 'table' ELSE 'code' END
             WHEN c = 'blank' THEN NULL WHEN c = 'heading' THEN 'heading' WHEN c = 'item' THEN 'list' WHEN c = 'table' THEN 'table'
             WHEN open = 'list' THEN 'list' ELSE 'paragraph' END
      FROM walk w JOIN classed x ON x.doc_id = w.doc_id AND x.n = w.n + 1)
    SELECT doc_id, n AS line, CASE WHEN kind IS NOT NULL THEN block END AS block, kind FROM walk WHERE n >= 0""",
)
def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Block and kind of every markdown line, found over lines as rows."""
    return markdown_lines.markdown_blocks(markdown_line_rows(spark, d))


def markdown_line_rows(spark: SparkSession, d: str) -> DataFrame:
    lines = F.posexplode(F.split("md", "\n", -1)).alias("line", "text")
    return views.marked_up_text(spark, d).select("doc_id", lines)


# ------------------------------------------------------------------------ pages


@query(
    "crowded_page",
    """WITH runs AS (
      SELECT CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey END AS doc_id, 1 AS page, l_linenumber + 10 * l_orderkey AS seq,
        CASE WHEN l_suppkey % 50 <> 0 THEN l_partkey % 600 END AS x, CASE WHEN l_orderkey % 5 <> 0 THEN l_suppkey % 2 ELSE 7 END AS y, l_returnflag AS text
      FROM lineitem)
    SELECT doc_id, page, seq, row_number() OVER (PARTITION BY doc_id, page ORDER BY -y, x NULLS LAST, seq) - 1 AS visual_pos FROM runs""",
)
def crowded_page(spark: SparkSession, d: str) -> DataFrame:
    """A page that holds a third of all runs, most of them in three lines."""
    order, supp = F.col("l_orderkey"), F.col("l_suppkey")
    runs = views.table(spark, d, "lineitem").select(
        F.when(order % 3 == 0, F.lit(0).cast("long")).otherwise(order).alias("doc_id"), F.lit(1).alias("page"),
        (F.col("l_linenumber") + 10 * order).alias("seq"), F.when(supp % 50 != 0, (F.col("l_partkey") % 600).cast("double")).alias("x"),
        F.when(order % 5 != 0, (supp % 2).cast("double")).otherwise(7.0).alias("y"), F.col("l_returnflag").alias("text"),
    )
    return reading_order.reading_positions(runs).select("doc_id", "page", "seq", "visual_pos")


# ------------------------------------------------------------------------- runs

_FIRED = ", ".join(f"CASE WHEN (o_orderkey * 31 + floor(o_totalprice)::BIGINT + {17 * i}) % 7 = 0 THEN {sql.q(t.id)} END" for i, t in enumerate(TRAPS))
_LOST = " + ".join(
    f"CASE WHEN (o_orderkey * 31 + floor(o_totalprice)::BIGINT + {17 * i}) % 7 = 0 THEN {WEIGHTS[t.severity]} ELSE 0 END" for i, t in enumerate(TRAPS)
)


@query(
    "run_verdict_changes",
    f"""WITH verdicts AS (
      SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS chain_id, o_orderkey AS run_id, o_orderdate AS done_at,
        list_filter([{_FIRED}], lambda x: x IS NOT NULL) AS hits, greatest(0, 100 - ({_LOST})) AS score FROM orders),
    paired AS (
      SELECT *, lag(run_id) OVER w AS previous_run, coalesce(lag(hits) OVER w, []) AS before, lag(score) OVER w AS score_before
      FROM verdicts WINDOW w AS (PARTITION BY chain_id ORDER BY done_at, run_id))
    SELECT chain_id, run_id, previous_run, array_to_string(list_filter(hits, lambda h: NOT list_contains(before, h)), ',') AS appeared,
      array_to_string(list_filter(before, lambda h: NOT list_contains(hits, h)), ',') AS resolved, score - score_before AS score_delta FROM paired""",
)
def run_verdict_changes(spark: SparkSession, d: str) -> DataFrame:
    """New and resolved hits and the change of the score, from each run of a chain to the next."""
    verdicts = views.run_verdicts(spark, d)
    changed = runs.changes_by_run(verdicts, F.date_trunc("month", F.col("at")))
    return changed.withColumns({c: F.array_join(c, ",") for c in ("appeared", "resolved")})


# ---------------------------------------------------------------- stored tables


@query(
    "stored_upserts",
    """WITH stored AS (
      SELECT source || '/' || doc_id % 40 AS name, doc_id AS version, text FROM documents)
    SELECT name, max(version) AS version, arg_max(text, version) AS text FROM stored GROUP BY name""",
)
def stored_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Documents stored under names in two batches, the second one given twice."""
    name = F.concat_ws("/", "source", (F.col("doc_id") % 40).cast("string"))
    docs = views.table(spark, d, "documents").select(name.alias("name"), F.col("doc_id").alias("version"), "text")
    table = stored.NewestRows(
        spark, f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}", "name string, version long, text string", ["name"], ["version"], buckets=8
    ).create()
    for part in (1, 0, 0):
        table.merge(docs.where(F.col("version") % 2 == part))
    return table.rows()


@query(
    "retained_in_batches",
    """WITH runs AS (
      SELECT o_orderkey AS run_id, o_custkey % 20 AS chain_id, o_orderdate AS done_at,
        row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
    SELECT chain_id, run_id, done_at FROM runs WHERE n <= 60""",
)
def retained_in_batches(spark: SparkSession, d: str) -> DataFrame:
    """The newest 60 runs per chain, kept over three batches that arrive in no order of time."""
    runs = views.table(spark, d, "orders").select(
        (F.col("o_custkey") % 20).alias("chain_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("done_at")
    )
    at = dict(runs.dtypes)["done_at"]
    history = stored.NewestRows(
        spark, f"{shared_folder(spark)}/retained-{uuid.uuid4().hex}", f"chain_id long, run_id long, done_at {at}", ["chain_id"], ["done_at", "run_id"],
        keep=60, buckets=8,
    ).create()
    for part in (2, 0, 1):
        history.merge(runs.where(F.col("run_id") % 3 == part))
    return history.rows()
