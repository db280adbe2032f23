"""Queries on run logs: fail-stop, notes, history, retention, the event feed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import runs
from ..session import shared_folder
from ..sources import csv_files, views
from ..streaming import step_events
from . import sql
from .registry import query

_LOG = f"""log AS (
  SELECT l_orderkey AS run_id, l_linenumber AS step, l_partkey AS item, NOT (l_returnflag = 'R' AND l_quantity > 40) AS ok,
    {sql.strings(views.CLAIM_KEYS)}[1 + l_suppkey % 9] AS note, 'v' || l_partkey AS note_value FROM lineitem),
stops AS (SELECT run_id, min(step) AS stop FROM log WHERE NOT ok GROUP BY run_id)"""
_RUNS = """runs AS (
  SELECT o_orderkey AS run_id, o_custkey AS chain_id, o_orderdate AS done_at, o_orderstatus <> 'F' AS ok,
    CAST(floor(o_totalprice) AS BIGINT) AS ms, CAST(floor(o_totalprice % 101) AS INTEGER) AS score FROM orders)"""


@query(
    "fail_stop_log",
    f"WITH {_LOG} SELECT run_id, step, item, ok FROM log LEFT JOIN stops USING (run_id) WHERE stop IS NULL OR step <= stop",
)
def fail_stop_log(spark: SparkSession, d: str) -> DataFrame:
    return runs.fail_stop(views.run_log(spark, d)).select("run_id", "step", "item", "ok")


@query(
    "run_success",
    f"""WITH {_LOG}, seen AS (SELECT run_id, bool_and(ok) AS all_ok, count(*) AS n_recorded FROM log GROUP BY run_id)
    SELECT o_orderkey AS run_id, 1 + o_orderkey % 7 AS n_steps, n_recorded, coalesce(all_ok AND n_recorded = 1 + o_orderkey % 7, false) AS ok
    FROM orders LEFT JOIN seen ON run_id = o_orderkey""",
)
def run_success(spark: SparkSession, d: str) -> DataFrame:
    expected = views.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("run_id"), (1 + F.col("o_orderkey") % 7).alias("n_steps")
    )
    return runs.run_success(views.run_log(spark, d), expected)


@query(
    "merged_notes",
    f"""WITH {_LOG} SELECT run_id, note, max(step) AS step, max_by(note_value, (step, note_value)) AS note_value
    FROM log WHERE note IS NOT NULL GROUP BY run_id, note""",
)
def merged_notes(spark: SparkSession, d: str) -> DataFrame:
    return runs.accumulate_notes(views.run_log(spark, d)).select("run_id", "note", "step", "note_value")


@query(
    "run_history",
    f"""WITH {_RUNS} SELECT run_id, chain_id, strftime(done_at, '%Y-%m-%d') AS day, ok, ms FROM runs ORDER BY done_at DESC, run_id DESC LIMIT 60""",
)
def run_history(spark: SparkSession, d: str) -> DataFrame:
    newest = runs.history(views.runs(spark, d), 60)
    return newest.select("run_id", "chain_id", F.date_format("at", "yyyy-MM-dd").alias("day"), "ok", "ms")


@query(
    "retained_runs",
    f"""WITH {_RUNS} SELECT run_id, chain_id, ms, row_number() OVER (PARTITION BY chain_id ORDER BY done_at DESC, run_id DESC) AS recency
    FROM runs QUALIFY recency <= 5""",
)
def retained_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.retain(views.runs(spark, d), 5).select("run_id", "chain_id", "ms", "recency")


@query(
    "latest_runs",
    f"""WITH {_RUNS} SELECT chain_id, run_id, ok, ms, score FROM runs
    QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY done_at DESC, run_id DESC) = 1""",
)
def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.latest_per_chain(views.runs(spark, d)).select("chain_id", "run_id", "ok", "ms", "score")


@query(
    "step_records",
    f"""WITH {sql.STEPS}, {_LOG}
    SELECT s.chain_id, s.idx, s.tool_id, l.ok, l.note FROM steps s
    LEFT JOIN (SELECT run_id, step - 1 AS idx, bool_and(ok) AS ok, max(note) AS note FROM log GROUP BY ALL) l
      ON l.run_id = s.chain_id AND l.idx = s.idx""",
)
def step_records(spark: SparkSession, d: str) -> DataFrame:
    """Each chain step beside the record of the run with the same number; repeated records count as one."""
    log = (
        views.run_log(spark, d).withColumnRenamed("run_id", "chain_id").groupBy("chain_id", "step")
        .agg(F.bool_and("ok").alias("ok"), F.max("note").alias("note"))
    )
    joined = runs.step_records(views.steps(spark, d), log, "chain_id")
    return joined.select("chain_id", "idx", "tool_id", "ok", "note")


@query(
    "run_scores",
    f"""WITH {sql.VERDICT}, {_RUNS}
    SELECT v.chain_id, v.score, l.run_id, l.score - v.score AS gap FROM verdict v JOIN (
      SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY done_at DESC, run_id DESC) = 1) l USING (chain_id)""",
)
def run_scores(spark: SparkSession, d: str) -> DataFrame:
    """Chain verdicts beside the score their latest run claimed."""
    from .chains import verdicts

    latest = runs.latest_per_chain(views.runs(spark, d)).select("chain_id", "run_id", F.col("score").alias("claimed_score"))
    joined = verdicts(spark, d).join(latest, "chain_id")
    return joined.select("chain_id", "score", "run_id", (F.col("claimed_score") - F.col("score")).alias("gap"))


@query(
    "step_event_feed",
    """WITH e AS (SELECT *, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'start' ELSE 'end' END AS phase FROM events)
    SELECT user_id AS run_id, event_id AS step, phase, CASE WHEN phase <> 'start' THEN CAST(floor(value * 100) AS BIGINT) END AS bytes,
      CASE WHEN phase = 'error' THEN json_extract_string(props, '$.k') END AS note FROM e""",
)
def step_event_feed(spark: SparkSession, d: str) -> DataFrame:
    """Stream the event files into a step log and read it back."""
    schema = views.table(spark, d, "events").schema
    return step_events.step_log_feed(spark, f"{d}/events*.parquet", schema, step_events.phase_events)


@query(
    "appended_runs",
    f"""WITH {_RUNS} SELECT run_id, chain_id, ms, score FROM runs""",
)
def appended_runs(spark: SparkSession, d: str) -> DataFrame:
    """Append the runs in two portions to a history table and read it back."""
    path = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    given = views.runs(spark, d)
    for part in (F.col("run_id") % 2 == 0, F.col("run_id") % 2 == 1):
        runs.append_runs(given.where(part), path)
    return spark.read.parquet(path).select("run_id", "chain_id", "ms", "score")


@query(
    "csv_file_round_trip",
    """SELECT o_orderkey::VARCHAR AS id, 'say "' || o_orderstatus || '", ' || o_orderpriority || chr(10) || 'next' AS note, o_custkey::VARCHAR AS customer FROM orders""",
)
def csv_file_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Write rows with quotes, commas and line ends to CSV files, and read them back."""
    note = F.concat(F.lit('say "'), "o_orderstatus", F.lit('", '), "o_orderpriority", F.lit("\nnext"))
    rows = views.table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), note.alias("note"), F.col("o_custkey").cast("string").alias("customer")
    )
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    csv_files.write_csv(rows, path)
    return csv_files.read_csv(spark, path)
