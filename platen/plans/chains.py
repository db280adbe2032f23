"""Queries on chain definitions: scoring, validation, listing, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import catalog, definitions, routing, traps, validate
from ..sources import views
from . import sql
from .registry import query


def hits_text(column: str = "hits") -> F.Column:
    return F.array_join(F.transform(column, lambda h: F.concat_ws(":", h["trap_id"], h["basis"])), ",")


def ids_text(column: str = "steps") -> F.Column:
    return F.array_join(F.transform(column, lambda s: s["tool_id"]), ">")


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts and attributes of every chain: one scan of the events, one aggregation."""
    return views.with_attributes(traps.gather_facts(views.steps(spark, d), attributes=("k",)))


def verdicts(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    return traps.score_facts(facts(spark, d), keep=keep)


@query(
    "trap_prevalence",
    f"""WITH {sql.VERDICT}, {sql.HITS}, {sql.TRAP_TABLE}
    SELECT t.trap_id, t.severity, t.weight, h.basis, count(h.chain_id) AS n_hits
    FROM traps t LEFT JOIN hits h USING (trap_id) GROUP BY ALL""",
)
def trap_prevalence(spark: SparkSession, d: str) -> DataFrame:
    return traps.prevalence(verdicts(spark, d), catalog.traps(spark))


@query(
    "trap_scores",
    f"WITH {sql.VERDICT} SELECT chain_id, n_steps, penalty, score, stars, hits FROM verdict",
)
def trap_scores(spark: SparkSession, d: str) -> DataFrame:
    return verdicts(spark, d).withColumn("hits", hits_text())


@query(
    "trap_scores_from_arrays",
    f"WITH {sql.VERDICT} SELECT chain_id, penalty, 100 - penalty AS score, hits FROM verdict",
)
def trap_scores_from_arrays(spark: SparkSession, d: str) -> DataFrame:
    scored = traps.score_chains(views.chains(spark, d), mode="raw")
    return scored.select("chain_id", "penalty", "score", hits_text().alias("hits"))


@query(
    "score_gap_by_origin",
    f"""WITH {sql.VERDICT}
    SELECT origin, count(*) AS n_chains, round(avg(self_score - score), 6) AS avg_gap,
           max(self_score - score) AS max_gap FROM verdict GROUP BY origin""",
)
def score_gap_by_origin(spark: SparkSession, d: str) -> DataFrame:
    scored = verdicts(spark, d, "origin", "self_score")
    gap = F.col("self_score") - F.col("score")
    return scored.groupBy("origin").agg(
        F.count(F.lit(1)).alias("n_chains"), F.round(F.avg(gap), 6).alias("avg_gap"), F.max(gap).alias("max_gap")
    )


@query(
    "verdict_changes",
    f"""WITH {sql.FACTS}, {sql.verdict_sql('judged')},
    plain AS (SELECT chain_id, hits AS before_hits, score AS before_score FROM (
      WITH {sql.verdict_sql('judged', measured=False, claimed=False)} SELECT * FROM verdict))
    SELECT chain_id,
      array_to_string(list_filter(string_split(hits, ','), lambda h: h <> '' AND NOT list_contains(string_split(before_hits, ','), h)), ',') AS appeared,
      array_to_string(list_filter(string_split(before_hits, ','), lambda h: h <> '' AND NOT list_contains(string_split(hits, ','), h)), ',') AS resolved,
      score - before_score AS score_delta
    FROM verdict JOIN plain USING (chain_id)""",
)
def verdict_changes(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.runs import verdict_diff

    diff = verdict_diff(traps.score_with_and_without_evidence(facts(spark, d)))
    return diff.select(
        "chain_id", F.array_join("appeared", ",").alias("appeared"), F.array_join("resolved", ",").alias("resolved"), "score_delta"
    )


@query(
    "chain_listing",
    f"""WITH {sql.VERDICT}, texts AS (
      SELECT chain_id, string_agg(tool_id || CASE WHEN n > 0 THEN '{{' || params || '}}' ELSE '' END, ' > ' ORDER BY idx) AS steps_view FROM (
        SELECT chain_id, idx, tool_id, (empty OR font IS NOT NULL OR quality IS NOT NULL OR side IS NOT NULL)::INT AS n,
               concat_ws(';', CASE WHEN empty THEN 'empty=true' END, 'font=' || font,
                              CASE WHEN side IS NOT NULL THEN 'h=' || side END,
                              'quality=' || quality, CASE WHEN side IS NOT NULL THEN 'w=' || side END) AS params
        FROM steps) GROUP BY chain_id)
    SELECT chain_id, input_type, output_type, origin, steps_view, self_score, score, self_score - score AS gap,
           hits AS hits_view, coalesce(claim, '') AS note_keys
    FROM verdict JOIN texts USING (chain_id)""",
)
def chain_listing(spark: SparkSession, d: str) -> DataFrame:
    return definitions.chain_view(traps.score_chains(views.chains(spark, d)))


# ----------------------------------------------------------------- validation

_CURRENT = f"""{sql.STEPS}, {sql.CONNECTORS},
typed AS (
  SELECT s.*, a.input_type, a.output_type,
    coalesce(last_value(s.out_type IGNORE NULLS) OVER (PARTITION BY s.chain_id ORDER BY idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a.input_type) AS current
  FROM steps s JOIN attrs a USING (chain_id)
),
ends AS (
  SELECT chain_id, max(input_type) AS input_type, max(output_type) AS goal, count(*) AS n_steps,
    coalesce(last(out_type ORDER BY idx) FILTER (out_type IS NOT NULL), max(input_type)) AS ends_at,
    concat_ws('>', max(input_type), string_agg(coalesce(out_type, '?'), '>' ORDER BY idx)) AS chain
  FROM typed GROUP BY chain_id
),
issues AS (
  SELECT chain_id, 'unknown-tool' AS kind, idx AS step, 'the catalogue has no tool ' || tool_id AS message, NULL AS fix, NULL AS bridge
  FROM typed WHERE in_type IS NULL
  UNION ALL
  SELECT chain_id, 'missing-connector', idx,
    'step ' || (idx + 1) || ' (' || label || ') reads ' || in_type || ', but gets ' || current,
    CASE WHEN tool IS NOT NULL THEN 'put ' || tool || ' before step ' || (idx + 1)
         ELSE 'no tool leads from ' || current || ' to ' || in_type END, tool
  FROM typed LEFT JOIN connectors ON pair = current || '>' || in_type WHERE current <> in_type
  UNION ALL
  SELECT chain_id, 'goal-mismatch', NULL, 'the last step gives ' || ends_at || ', wanted is ' || goal,
    CASE WHEN tool IS NOT NULL THEN 'add ' || tool || ' at the end'
         ELSE 'no tool leads from ' || ends_at || ' to ' || goal END, tool
  FROM ends LEFT JOIN connectors ON pair = ends_at || '>' || goal WHERE ends_at <> goal
)"""


@query("chain_errors", f"WITH {_CURRENT} SELECT chain_id, kind, step, message, fix, bridge FROM issues")
def chain_errors(spark: SparkSession, d: str) -> DataFrame:
    checked = validate.validate_chains(views.chains(spark, d))
    rows = checked.select("chain_id", F.explode_outer("errors").alias("e")).select("chain_id", "e.*")
    return rows.filter("kind is not null")


@query(
    "chain_validation",
    f"""WITH {_CURRENT}
    SELECT e.chain_id, e.ends_at, e.goal, e.chain, coalesce(i.n, 0) AS n_errors,
           coalesce(w.n, 0) AS n_warnings, i.n IS NULL AS ok
    FROM ends e
    LEFT JOIN (SELECT chain_id, count(*) AS n FROM issues GROUP BY 1) i USING (chain_id)
    LEFT JOIN (SELECT chain_id, count(*) AS n FROM steps WHERE mode = 'simulated' GROUP BY 1) w USING (chain_id)""",
)
def chain_validation(spark: SparkSession, d: str) -> DataFrame:
    checked = validate.validate_chains(views.chains(spark, d))
    return checked.select(
        "chain_id", "ends_at", "goal", F.array_join("chain", ">").alias("chain"),
        F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"), "ok",
    )


@query(
    "simulated_warnings",
    f"""WITH {sql.STEPS} SELECT chain_id, idx AS step, 'step ' || (idx + 1) || ' (' || label || ') only simulates its result' AS message
    FROM steps WHERE mode = 'simulated'""",
)
def simulated_warnings(spark: SparkSession, d: str) -> DataFrame:
    checked = validate.validate_chains(views.chains(spark, d))
    rows = checked.select("chain_id", F.explode_outer("warnings").alias("w")).select("chain_id", "w.step", "w.message")
    return rows.filter("message is not null")


@query(
    "current_types",
    f"WITH {_CURRENT} SELECT chain_id, idx, tool_id, current FROM typed",
)
def current_types(spark: SparkSession, d: str) -> DataFrame:
    known = validate.with_current_types(views.chains(spark, d))
    return known.select("chain_id", F.posexplode("known").alias("idx", "s")).select(
        "chain_id", "idx", "s.tool_id", "s.current"
    )


@query(
    "suggested_edits",
    f"""WITH {_CURRENT},
    first_fix AS (
      SELECT chain_id, min(step) AS spot, min_by(bridge, step) AS tool FROM issues
      WHERE kind = 'missing-connector' AND bridge NOT LIKE '%→%' GROUP BY chain_id),
    edited AS (
      SELECT chain_id, idx * 2 + 1 AS pos, tool_id FROM steps
      UNION ALL SELECT chain_id, spot * 2, tool FROM first_fix)
    SELECT e.chain_id, string_agg(e.tool_id, '>' ORDER BY pos) AS steps,
           coalesce(last(c.out_type ORDER BY pos), any_value(a.output_type)) AS output_type
    FROM edited e LEFT JOIN cat c ON c.id = e.tool_id JOIN attrs a USING (chain_id) GROUP BY e.chain_id""",
)
def suggested_edits(spark: SparkSession, d: str) -> DataFrame:
    fixed = validate.suggested_insert(validate.validate_chains(views.chains(spark, d)))
    edited = definitions.follow_last_step(fixed)
    return edited.select("chain_id", ids_text().alias("steps"), "output_type")


@query(
    "removed_first_steps",
    f"""WITH {sql.STEPS}
    SELECT s.chain_id, coalesce(string_agg(tool_id, '>' ORDER BY idx) FILTER (idx > 0), '') AS steps,
           coalesce(last(out_type ORDER BY idx) FILTER (idx > 0), any_value(a.output_type)) AS output_type
    FROM steps s JOIN attrs a USING (chain_id) GROUP BY s.chain_id""",
)
def removed_first_steps(spark: SparkSession, d: str) -> DataFrame:
    chains = views.chains(spark, d)
    shorter = chains.withColumn("steps", definitions.remove_step(F.col("steps"), F.lit(0)))
    return definitions.follow_last_step(shorter).select("chain_id", ids_text().alias("steps"), "output_type")


# ------------------------------------------------------------------- listings


@query(
    "step_usage",
    f"""WITH {sql.STEPS} SELECT tool_id, coalesce(mode, 'unknown') AS mode, count(*) AS n_steps
    FROM steps GROUP BY ALL""",
)
def step_usage(spark: SparkSession, d: str) -> DataFrame:
    return definitions.usage(views.steps(spark, d))


@query(
    "steps_touching_png",
    f"""WITH {sql.STEPS} SELECT chain_id, idx, tool_id, in_type, out_type FROM steps
    WHERE mode = 'real' AND 'png' IN (in_type, out_type)""",
)
def steps_touching_png(spark: SparkSession, d: str) -> DataFrame:
    found = definitions.filter_steps(views.steps(spark, d), "real", "png")
    return found.select("chain_id", "idx", "tool_id", "in_type", "out_type")


@query(
    "types_touched",
    f"""WITH {sql.STEPS} SELECT DISTINCT type FROM (
      SELECT in_type AS type FROM steps UNION ALL SELECT out_type FROM steps) WHERE type IS NOT NULL""",
)
def types_touched(spark: SparkSession, d: str) -> DataFrame:
    return definitions.types_touched(views.steps(spark, d))


@query(
    "unknown_tools",
    f"WITH {sql.STEPS} SELECT chain_id, idx, tool_id FROM steps WHERE mode IS NULL",
)
def unknown_tools(spark: SparkSession, d: str) -> DataFrame:
    steps = views.steps(spark, d)
    return steps.join(catalog.transforms(spark), "tool_id", "left_anti").select("chain_id", "idx", "tool_id")


@query(
    "trap_exposure",
    f"""WITH {sql.STEPS}, {sql.LISTED}, {sql.TRAP_TABLE}
    SELECT chain_id, idx, tool_id, t.trap_id, severity, weight, title
    FROM steps JOIN listed ON listed.id = tool_id JOIN traps t USING (trap_id)""",
)
def trap_exposure(spark: SparkSession, d: str) -> DataFrame:
    exposed = definitions.trap_exposure(views.steps(spark, d), catalog.transforms(spark), catalog.traps(spark))
    return exposed.select("chain_id", "idx", "tool_id", "trap_id", "severity", "weight", "title")


@query(
    "listed_and_fired",
    f"""WITH {sql.VERDICT}, {sql.HITS}, {sql.LISTED},
    exposure AS (SELECT chain_id, idx, tool_id, trap_id FROM steps JOIN listed ON listed.id = tool_id)
    SELECT e.chain_id, idx, tool_id, trap_id, basis AS state
    FROM exposure e JOIN hits h USING (chain_id, trap_id) WHERE e.chain_id IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT chain_id, idx, tool_id, trap_id, 'implicated' FROM exposure
    WHERE chain_id NOT IN (SELECT o_custkey FROM orders)""",
)
def listed_and_fired(spark: SparkSession, d: str) -> DataFrame:
    """Chains that have a run among the orders are the scored ones."""
    steps = views.steps(spark, d)
    exposure = definitions.trap_exposure(steps, catalog.transforms(spark), catalog.traps(spark))
    have_run = views.runs(spark, d).select("chain_id").distinct().withColumn("scored", F.lit(True))
    judged = verdicts(spark, d).join(have_run, "chain_id", "left").withColumn("scored", F.coalesce("scored", F.lit(False)))
    return definitions.listed_and_fired(exposure, judged)


@query(
    "default_inputs",
    f"""WITH {sql.STEPS}, {sql.DEFAULT_INPUTS},
    stored AS (SELECT {sql.strings(views.STORED_NAMES)}[1 + doc_id % {len(views.STORED_NAMES)}] AS name, doc_id AS seq FROM documents),
    here AS (SELECT type, min_by(document, ord) AS document FROM inputs WHERE document IN (SELECT name FROM stored) GROUP BY type)
    SELECT chain_id, input_type, coalesce(document, (SELECT min_by(name, (seq, name)) FROM stored)) AS document
    FROM attrs LEFT JOIN here ON type = input_type""",
)
def default_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Some of the catalogue's inputs are stored, under names by document id; the others are not there."""
    stored = views.table(spark, d, "documents").select(
        views.pick(views.STORED_NAMES, F.col("doc_id") % len(views.STORED_NAMES)).alias("name"), F.col("doc_id").alias("seq")
    )
    chosen = definitions.default_documents(views.chain_attributes(spark, d), catalog.inputs(spark), stored)
    return chosen.select("chain_id", "input_type", "document")


@query(
    "surviving_chains",
    f"""WITH {sql.STEPS} SELECT chain_id, origin FROM attrs
    WHERE chain_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def surviving_chains(spark: SparkSession, d: str) -> DataFrame:
    deleted = views.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("chain_id"))
    return definitions.without(views.chain_attributes(spark, d), deleted).select("chain_id", "origin")


# ---------------------------------------------------------- requests and specs

_RAW_SQL = """CASE event_id % 9
  WHEN 0 THEN '["' || tool_id || '"]'
  WHEN 1 THEN '[{"toolId":"' || tool_id || '","params":{"quality":' || k || '}}]'
  WHEN 2 THEN '[]'
  WHEN 3 THEN '"' || tool_id || '"'
  WHEN 4 THEN '["' || tool_id || '",null]'
  WHEN 5 THEN '["Bad Id ' || k || '"]'
  WHEN 6 THEN '["ocr",{"toolId":"' || tool_id || '","params":[1]}]'
  WHEN 7 THEN '[{"toolId":"' || tool_id || '","in":"zip","out":"' || event_type || '"},"pdf-text"]'
  ELSE '[{"params":{}}]' END"""


def step_list_requests(spark: SparkSession, d: str) -> DataFrame:
    return views.dealt(views.steps(spark, d).select("event_id", F.expr(_RAW_SQL).alias("raw")))


@query(
    "step_list_parsing",
    f"""WITH {sql.STEPS},
    requests AS (SELECT event_id, {_RAW_SQL} AS raw FROM steps),
    items AS (
      SELECT event_id, i, json_extract(raw, '$[' || i || ']') AS item FROM (
        SELECT event_id, raw, unnest(range(CASE WHEN json_type(raw) = 'ARRAY' THEN CAST(json_array_length(raw) AS BIGINT) ELSE 0 END)) AS i
        FROM requests)),
    parsed AS (
      SELECT event_id, i,
        CASE json_type(item) WHEN 'VARCHAR' THEN json_extract_string(item, '$') WHEN 'OBJECT' THEN json_extract_string(item, '$.toolId') END AS tool,
        json_extract_string(item, '$.in') AS given_in, json_extract_string(item, '$.out') AS given_out,
        json_type(item) = 'OBJECT' AND json_type(item, '$.params') <> 'OBJECT' AS bad_params,
        json_extract_string(item, '$.params.quality') AS quality
      FROM items),
    checked AS (
      SELECT p.*, NOT coalesce(regexp_full_match(tool, '[a-z0-9-]{{1,40}}'), false) AS bad_id,
        coalesce(given_in, c.in_type) AS in_type, coalesce(given_out, c.out_type) AS out_type
      FROM parsed p LEFT JOIN cat c ON c.id = tool),
    errors AS (
      SELECT event_id,
        min(i) FILTER (bad_id) AS at_id, min(i) FILTER (bad_params) AS at_params, count(*) AS n,
        string_agg(concat_ws('/', tool, in_type, out_type, quality), '>' ORDER BY i) AS steps
      FROM checked GROUP BY event_id)
    SELECT r.event_id,
      CASE WHEN n IS NULL THEN 'there is no list of steps'
           WHEN at_id IS NOT NULL AND at_id <= coalesce(at_params, at_id) THEN 'steps[' || at_id || '] names no tool'
           WHEN at_params IS NOT NULL THEN 'steps[' || at_params || '] has parameters of the wrong kind' END AS error,
      CASE WHEN n IS NOT NULL AND at_id IS NULL AND at_params IS NULL THEN steps END AS steps
    FROM requests r LEFT JOIN errors USING (event_id)""",
)
def step_list_parsing(spark: SparkSession, d: str) -> DataFrame:
    parsed = definitions.normalise_steps(step_list_requests(spark, d))
    shown = F.transform(
        "steps",
        lambda s: F.concat_ws("/", s["tool_id"], s["in_type"], s["out_type"], F.try_element_at(s["params"], F.lit("quality"))),
    )
    return parsed.select("event_id", F.col("error.message").alias("error"), F.array_join(shown, ">").alias("steps"))


@query(
    "build_request_checks",
    """WITH requests AS (
      SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'agent' WHEN 1 THEN 'human' WHEN 2 THEN 'martian' END AS origin,
        CASE o_orderkey % 5 WHEN 0 THEN repeat('x', CAST(o_orderkey % 90 AS INTEGER)) WHEN 1 THEN 'a' || chr(9) || 'b' ELSE o_orderpriority END AS name,
        CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN CAST(o_orderkey % 150 AS VARCHAR) ELSE 'high' END AS self_score,
        CAST(o_orderkey % 70 AS VARCHAR) AS history_limit
      FROM orders)
    SELECT o_orderkey,
      CASE WHEN origin = 'martian' THEN 'unknown origin; known are agent | human | seeded'
           WHEN length(name) NOT BETWEEN 1 AND 60 OR contains(name, chr(9)) THEN 'a name has 1 to 60 printable characters'
           WHEN self_score = 'high' OR CAST(nullif(self_score, 'high') AS INTEGER) > 100 THEN 'a self-score lies between 0 and 100' END AS error,
      CASE WHEN CAST(history_limit AS INTEGER) NOT BETWEEN 1 AND 60 THEN 'invalid_param' END AS limit_code,
      CASE WHEN CAST(history_limit AS INTEGER) < 1 THEN 'invalid_param' END AS open_limit_code
    FROM requests""",
)
def build_request_checks(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    requests = views.table(spark, d, "orders").select(
        "o_orderkey",
        views.pick(["agent", "human", "martian"], key % 4).alias("origin"),
        F.when(key % 5 == 0, F.repeat(F.lit("x"), (key % 90).cast("int")))
        .when(key % 5 == 1, "a\tb").otherwise(F.col("o_orderpriority")).alias("name"),
        F.when(key % 3 == 1, (key % 150).cast("string")).when(key % 3 == 2, "high").alias("self_score"),
        (key % 70).cast("string").alias("history_limit"),
    )
    checked = definitions.check_build_requests(requests)
    return checked.select(
        "o_orderkey", F.col("error.message").alias("error"),
        definitions.check_history_limit(F.col("history_limit"), 60)["code"].alias("limit_code"),
        definitions.check_history_limit(F.col("history_limit"))["code"].alias("open_limit_code"),
    )


@query(
    "reference_checks",
    f"""WITH {sql.STEPS}, requests AS (
      SELECT o_orderkey, o_custkey * 3 AS chain_id, CASE WHEN o_orderkey % 2 = 0 THEN 'run' ELSE 'score' END AS action FROM orders),
    known AS (SELECT chain_id, count(*) FILTER (idx > 0) AS n_steps FROM steps GROUP BY chain_id)
    SELECT o_orderkey, CASE WHEN n_steps IS NULL THEN 'not_found' WHEN n_steps = 0 AND action = 'run' THEN 'wrong_state'
      WHEN n_steps = 0 THEN 'empty_result' END AS code
    FROM requests LEFT JOIN known USING (chain_id)""",
)
def reference_checks(spark: SparkSession, d: str) -> DataFrame:
    """Requests for chains whose first step was removed: the one-step ones are empty now."""
    chains = views.chains(spark, d)
    chains = chains.withColumn("steps", definitions.remove_step(F.col("steps"), F.lit(0)))
    requests = views.table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_custkey") * 3).alias("chain_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "run").otherwise("score").alias("action"),
    )
    return definitions.check_references(requests, chains).select("o_orderkey", F.col("error.code").alias("code"))


@query(
    "built_chains",
    f"""WITH {_CURRENT.replace('a.input_type, a.output_type,', 'b.input_type, b.output_type,')
        .replace('a.input_type) AS current', 'b.input_type) AS current')
        .replace('FROM steps s JOIN attrs a USING (chain_id)', 'FROM steps s JOIN built b USING (chain_id)')
        .replace('typed AS (', '''built AS (
      SELECT s.chain_id,
        CASE WHEN first(label ORDER BY idx) IS NOT NULL AND last(label ORDER BY idx) IS NOT NULL
             THEN first(label ORDER BY idx) || ' chain' ELSE 'Pipeline' END AS name,
        coalesce(any_value(a.input_type), first(in_type ORDER BY idx), 'txt') AS input_type,
        coalesce(any_value(a.output_type), last(out_type ORDER BY idx), 'txt') AS output_type
      FROM steps s JOIN attrs a USING (chain_id) GROUP BY s.chain_id),
    typed AS (''', 1)}
    SELECT chain_id, name, b.input_type, b.output_type, chain_id NOT IN (SELECT chain_id FROM issues) AS valid FROM built b""",
)
def built_chains(spark: SparkSession, d: str) -> DataFrame:
    specs = views.chains(spark, d).withColumn("name", F.lit(None).cast("string"))
    checked = validate.validate_chains(definitions.build_chains(specs))
    return checked.select("chain_id", "name", "input_type", "output_type", F.col("ok").alias("valid"))


# -------------------------------------------------------------------- routing

ROUTE_TYPES = ["pdf", "docx", "xlsx", "png", "md", "html", "csv", "txt", "zip", "files", "doc", "scan", "rgba", "csv-of-tables"]


@query(
    "route_requests",
    f"""WITH {sql.CATALOG}, {sql.EDGES},
    requests AS (
      SELECT event_id, {sql.strings(ROUTE_TYPES)}[1 + event_id % 14] AS from_type,
             {sql.strings(ROUTE_TYPES)}[1 + user_id % 14] AS to_type FROM events),
    paths AS (
      SELECT ord, from_type, to_type, steps FROM edges
      UNION ALL SELECT a.ord + 1000, a.from_type, b.to_type, a.steps || '>' || b.steps FROM edges a JOIN edges b ON a.to_type = b.from_type),
    best AS (SELECT from_type, to_type, min_by(steps, ord) AS steps FROM paths GROUP BY ALL),
    found AS (
      SELECT r.*, CASE WHEN r.from_type = r.to_type THEN '' ELSE steps END AS steps
      FROM requests r LEFT JOIN best USING (from_type, to_type))
    SELECT event_id, from_type, to_type, steps, steps IS NOT NULL AS found,
      CASE WHEN steps = '' THEN from_type WHEN steps IS NOT NULL THEN from_type || '>' || array_to_string(list_transform(
        string_split(steps, '>'), lambda s: MAP {{{', '.join(f"{sql.q(t.id)}: {sql.q(t.out_type)}" for t in catalog.TRANSFORMS)}}}[s]), '>') END AS types
    FROM found""",
)
def route_requests(spark: SparkSession, d: str) -> DataFrame:
    requests = views.table(spark, d, "events").select(
        "event_id",
        views.pick(ROUTE_TYPES, F.col("event_id") % 14).alias("from_type"),
        views.pick(ROUTE_TYPES, F.col("user_id") % 14).alias("to_type"),
    )
    planned = routing.plan_routes(requests, catalog.routes(spark))
    return planned.select(
        "event_id", "from_type", "to_type", F.array_join("steps", ">").alias("steps"), "found",
        F.array_join("types", ">").alias("types"),
    )


GOALS = [
    "summarize the scanned pdf", "get the tables out of a spreadsheet as csv", "convert docx into markdown notes",
    "read the text from a Photo", "unpack this bundle", "write a report", "make it nicer", "open the DOC",
]


def _scored_sql(chains: list[tuple]) -> str:
    """``verdict`` over a few chains given as (input type, goal type, steps, claim), numbered from 0; needs ``cat``."""
    rows = ", ".join(f"({i}, {sql.q(a)}, {sql.q(b)}, {sql.q('>'.join(steps))}, {claim})" for i, (a, b, steps, claim) in enumerate(chains))
    return f"""proposals(chain_id, it, ot, path, claimed) AS (VALUES {rows}),
    steps AS (
      SELECT chain_id, idx, tool_id, CAST(NULL AS BIGINT) AS side, CAST(NULL AS BIGINT) AS quality, CAST(NULL AS VARCHAR) AS font, in_type, out_type
      FROM (SELECT chain_id, unnest(string_split(path, '>')) AS tool_id, unnest(range(len(string_split(path, '>')))) AS idx FROM proposals)
      LEFT JOIN cat ON id = tool_id),
    {sql.FACT_ROWS},
    judged AS (SELECT f.*, it, ot, path, claimed FROM facts f JOIN proposals USING (chain_id)),
    {sql.verdict_sql('judged', measured=False, claimed=False)}"""


@query(
    "goal_proposals",
    f"""WITH {sql.CATALOG}, {_scored_sql([routing.KNOWN_BAD] + [r[1:5] for r in routing.GOAL_RULES])}, goals AS (
      SELECT event_id, CASE WHEN event_id % 3 = 0 THEN repeat('please, ', 40) ELSE '' END || {sql.strings(GOALS)}[1 + event_id % 8] || ' ' || event_type AS goal FROM events),
    routed AS (
      SELECT *, lower(goal) AS g,
        CASE WHEN regexp_matches(lower(goal), '{routing.BAD_GOAL}') THEN 0
             {' '.join(f"WHEN regexp_matches(lower(goal), {sql.q(r[0])}) THEN {i + 1}" for i, r in enumerate(routing.GOAL_RULES))}
             ELSE 5 END AS rule FROM goals)
    SELECT event_id, goal, path AS steps, claimed AS self_score, score, claimed - score AS gap
    FROM routed JOIN verdict ON chain_id = rule""",
)
def goal_proposals(spark: SparkSession, d: str) -> DataFrame:
    goals = views.table(spark, d, "events").select(
        "event_id",
        F.concat(
            F.when(F.col("event_id") % 3 == 0, "please, " * 40).otherwise(""), views.pick(GOALS, F.col("event_id") % 8), F.lit(" "), F.col("event_type")
        ).alias("goal"),
    )
    scored = traps.score_chains(routing.propose_chains(goals))
    return scored.select(
        "event_id", "goal", ids_text().alias("steps"), "self_score", "score", (F.col("self_score") - F.col("score")).alias("gap")
    )


@query(
    "goal_fallbacks",
    f"""WITH given AS (
      SELECT event_id, {sql.strings(views.INPUT_TYPES)}[1 + event_id % 12] AS it, {sql.strings(catalog.GOAL_TYPES)}[1 + user_id % 8] AS ot FROM events),
    weighted AS (
      SELECT *, [{', '.join(f"(it = {sql.q(r[1])})::INTEGER * 2 + (ot = {sql.q(r[2])})::INTEGER * 3" for r in routing.GOAL_RULES)}] AS w FROM given),
    ruled AS (SELECT *, CASE WHEN w[5] = list_max(w) THEN 5 ELSE list_position(w, list_max(w)) END AS rule FROM weighted)
    SELECT event_id, it AS input_type, ot AS output_type, {sql.strings('>'.join(r[3]) for r in routing.GOAL_RULES)}[rule] AS steps,
      {[r[4] for r in routing.GOAL_RULES]}[rule] AS self_score FROM ruled""",
)
def goal_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    """Goals without a keyword, steered by the types that are given."""
    goals = views.table(spark, d, "events").select(
        "event_id", F.lit("make it nicer").alias("goal"),
        views.pick(views.INPUT_TYPES, F.col("event_id") % 12).alias("input_type"),
        views.pick(catalog.GOAL_TYPES, F.col("user_id") % 8).alias("output_type"),
    )
    return routing.propose_chains(goals).select("event_id", "input_type", "output_type", ids_text().alias("steps"), "self_score")


# ------------------------------------------------- types given by the caller


_EVENT_STEPS = sql.STEPS.replace("\nsteps AS (", "\nevent_steps AS (")
_GIVEN_SQL = f"""WITH {_EVENT_STEPS},
    steps AS (
      SELECT event_id AS chain_id, 0 AS idx, tool_id, CAST(NULL AS BIGINT) AS side, CASE WHEN event_id % 9 = 1 THEN k END AS quality, CAST(NULL AS VARCHAR) AS font,
        CASE WHEN event_id % 9 = 7 THEN 'zip' ELSE in_type END AS in_type, CASE WHEN event_id % 9 = 7 THEN event_type ELSE out_type END AS out_type
      FROM event_steps WHERE event_id % 9 IN (0, 1, 7)
      UNION ALL SELECT event_id, 1, 'pdf-text', NULL, NULL, NULL, 'pdf', 'txt' FROM event_steps WHERE event_id % 9 = 7),
    {sql.FACT_ROWS},
    judged AS (SELECT *, first_in AS it, last_out AS ot FROM facts),
    {sql.verdict_sql('judged', measured=False, claimed=False)}
    SELECT chain_id AS event_id, hits, score FROM verdict"""


@query("given_type_scores", _GIVEN_SQL)
def given_type_scores(spark: SparkSession, d: str) -> DataFrame:
    """Step lists of requests, some with types of their own, judged by the types they give."""
    parsed = definitions.normalise_steps(step_list_requests(spark, d)).where("error is null")
    none = F.lit(None).cast("string")
    scored = traps.score_chains(parsed.withColumns({"input_type": none, "output_type": none}))
    return scored.select("event_id", hits_text().alias("hits"), "score")


@query("given_type_scores_long", _GIVEN_SQL)
def given_type_scores_long(spark: SparkSession, d: str) -> DataFrame:
    """The same requests as a long step table."""
    parsed = definitions.normalise_steps(step_list_requests(spark, d)).where("error is null")
    long = parsed.select("event_id", F.posexplode("steps").alias("idx", "s")).select("event_id", "idx", "s.*")
    return traps.score_steps(long, key="event_id").select("event_id", hits_text().alias("hits"), "score")


@query(
    "trap_dossiers",
    f"""WITH {sql.TRAP_TABLE}, asked AS (SELECT event_id, 'T' || lpad(CAST(event_id % 18 AS VARCHAR), 2, '0') AS trap_id FROM events)
    SELECT event_id, trap_id, title, weight, CASE WHEN title IS NULL THEN 'not_found' END AS error FROM asked LEFT JOIN traps USING (trap_id)""",
)
def trap_dossiers(spark: SparkSession, d: str) -> DataFrame:
    asked = views.table(spark, d, "events").select(
        "event_id", F.concat(F.lit("T"), F.lpad((F.col("event_id") % 18).cast("string"), 2, "0")).alias("trap_id")
    )
    return traps.trap_dossiers(asked, catalog.traps(spark)).select("event_id", "trap_id", "title", "weight", "error")


@query(
    "type_filters",
    f"""WITH {sql.CATALOG}, sides AS (SELECT DISTINCT id, unnest([in_type, out_type]) AS io FROM cat),
    asked AS (SELECT event_id, {sql.strings(['png', 'docx', 'martian', 'rgba', 'avif'])}[1 + event_id % 5] AS io FROM events)
    SELECT event_id, io, count(id) AS n_tools, CASE WHEN count(id) = 0 THEN 'empty_result: no transform reads or writes this type; there are '
      || (SELECT string_agg(io, ' | ' ORDER BY io) FROM (SELECT DISTINCT io FROM sides)) END AS error
    FROM asked LEFT JOIN sides USING (io) GROUP BY event_id, io""",
)
def type_filters(spark: SparkSession, d: str) -> DataFrame:
    """Filters of which some match no transform; those say which types there are."""
    asked = views.table(spark, d, "events").select(
        "event_id", views.pick(["png", "docx", "martian", "rgba", "avif"], F.col("event_id") % 5).alias("io")
    )
    return definitions.filter_reports(asked, catalog.transforms(spark)).select("event_id", "io", "n_tools", "error")


@query(
    "empty_chains",
    f"""WITH {sql.STEPS} SELECT chain_id, count(*) = 1 AS is_empty, CASE WHEN count(*) = 1 THEN 'the chain is empty' END AS message
    FROM steps GROUP BY chain_id""",
)
def empty_chains(spark: SparkSession, d: str) -> DataFrame:
    """Chains without their first step; those that had one step are empty."""
    chains = views.chains(spark, d)
    checked = validate.validate_chains(chains.withColumn("steps", definitions.remove_step(F.col("steps"), F.lit(0))))
    found = F.filter("errors", lambda e: e["kind"] == "empty")
    return checked.select("chain_id", (F.size(found) > 0).alias("is_empty"), F.get(found, F.lit(0))["message"].alias("message"))


@query(
    "known_chains",
    f"""WITH {_EVENT_STEPS}, {_scored_sql([routing.KNOWN_BAD, routing.KNOWN_GOOD])}
    SELECT a.chain_id, hits, score, claimed - score AS gap FROM attrs a JOIN verdict v ON v.chain_id = a.chain_id % 2""",
)
def known_chains(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue's bad and good example, dealt to the chain ids, with the gap to the score they claim."""
    chosen = F.when(F.col("chain_id") % 2 == 0, routing.example(routing.KNOWN_BAD)).otherwise(routing.example(routing.KNOWN_GOOD))
    chains = views.chain_attributes(spark, d).select("chain_id", chosen.alias("p")).select("chain_id", "p.*")
    scored = traps.score_chains(chains)
    return scored.select("chain_id", hits_text().alias("hits"), "score", (F.col("self_score") - F.col("score")).alias("gap"))
