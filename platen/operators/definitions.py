"""Tables of chain definitions: parsing, checking, building, editing, listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .catalog import in_type_of, label_of, mode_of, out_type_of

# Identifier and name rules, accepted origins and declared types.
TOOL_ID = r"^[a-z0-9-]{1,40}\z"
CHAIN_NAME = r"^[^\x00-\x1f\x7f]{1,60}\z"
DOCUMENT_NAME = r"^[A-Za-z0-9._-]{1,40}\z"
ORIGINS = ["agent", "human", "seeded"]
DOCUMENT_TYPES = ["pdf", "docx", "xlsx", "png", "md", "html", "csv", "txt", "zip", "doc", "scan", "unknown"]


def error(code: str, message: Column | str) -> Column:
    """Error envelope ``struct(code, message)``."""
    return F.struct(F.lit(code).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def first_error(*checks: tuple[Column, Column]) -> Column:
    """The envelope of the first failing check, NULL when all pass."""
    chain = F
    for failed, envelope in checks:
        chain = chain.when(failed, envelope)
    return chain.otherwise(F.lit(None).cast("struct<code:string,message:string>"))


# ---------------------------------------------------------------- step lists


def normalise_steps(requests: DataFrame, raw: str = "raw") -> DataFrame:
    """Parse a JSON step list of ids or ``{toolId, params, in, out}`` objects.

    Adds ``steps`` (types filled from the catalogue where not given) and
    ``error``; a row carries one or the other. The partition id in ``error`` keeps a
    filter on it from being pushed below the parsing, which would paste the whole
    parser into the filter several times over.
    """

    def parse(e: Column) -> Column:
        whole = e.startswith("{")
        params = F.get_json_object(e, "$.params")
        tool = F.when(whole, F.get_json_object(e, "$.toolId")).otherwise(e)

        def given(key: str, default: Column) -> Column:
            return F.coalesce(F.when(whole, F.nullif(F.get_json_object(e, f"$.{key}"), F.lit(""))), default)

        return F.struct(
            tool.alias("tool_id"),
            F.coalesce(
                F.when(whole & params.startswith("{"), F.from_json(params, "map<string,string>")),
                F.expr("cast(map() as map<string,string>)"),
            ).alias("params"),
            given("in", in_type_of(tool)).alias("in_type"),
            given("out", out_type_of(tool)).alias("out_type"),
            (whole & params.isNotNull() & ~params.startswith("{")).alias("bad_params"),
        )

    def first_bad(test) -> Column:
        return F.array_min(
            F.filter(F.transform(F.col("_steps"), lambda s, i: F.when(test(s), i)), lambda i: i.isNotNull())
        )

    bad_id = first_bad(lambda s: ~F.coalesce(s["tool_id"].rlike(TOOL_ID), F.lit(False)))
    bad_params = first_bad(lambda s: s["bad_params"])

    def at(i: Column, text: str) -> Column:
        return F.concat(F.lit("steps["), i.cast("string"), F.lit(text))

    failure = first_error(
        (F.coalesce(F.size("_items") < 1, F.lit(True)), error("invalid_param", "there is no list of steps")),
        (
            F.col("_bad_id").isNotNull() & (F.col("_bad_id") <= F.coalesce("_bad_params", "_bad_id")),
            error("invalid_param", at(F.col("_bad_id"), "] names no tool")),
        ),
        (
            F.col("_bad_params").isNotNull(),
            error("invalid_param", at(F.col("_bad_params"), "] has parameters of the wrong kind")),
        ),
    )
    is_list = F.coalesce(F.ltrim(F.col(raw)).startswith("["), F.lit(False))
    return (
        requests.withColumn("_items", F.when(is_list, F.from_json(F.col(raw), "array<string>")))
        .withColumn("_steps", F.transform("_items", parse))
        .withColumn("_bad_id", bad_id)
        .withColumn("_bad_params", bad_params)
        .withColumn("error", F.when(F.spark_partition_id() >= 0, failure))
        .withColumn(
            "steps",
            F.when(
                F.col("error").isNull(),
                F.transform(
                    "_steps",
                    lambda s: F.struct(s["tool_id"].alias("tool_id"), s["params"].alias("params"),
                                       s["in_type"].alias("in_type"), s["out_type"].alias("out_type")),
                ),
            ),
        )
        .drop("_items", "_steps", "_bad_id", "_bad_params")
    )


def check_build_requests(requests: DataFrame) -> DataFrame:
    """Add ``error`` for build requests ``(origin, name, self_score as text)``."""
    score = F.col("self_score").try_cast("double")
    bad_score = F.col("self_score").isNotNull() & ~F.coalesce(score.between(0, 100), F.lit(False))
    return requests.withColumn(
        "error",
        first_error(
            (
                F.col("origin").isNotNull() & ~F.col("origin").isin(ORIGINS),
                error("invalid_param", "unknown origin; known are " + " | ".join(ORIGINS)),
            ),
            (
                F.col("name").isNotNull() & ~F.col("name").rlike(CHAIN_NAME),
                error("invalid_param", "a name has 1 to 60 printable characters"),
            ),
            (bad_score, error("invalid_param", "a self-score lies between 0 and 100")),
        ),
    )


def check_history_limit(limit: Column, most: int | None = None) -> Column:
    """Envelope for a history limit that is no whole number from 1 (to ``most``, where a caller sets one); NULL is the default."""
    number = limit.try_cast("double")
    ok = (number == F.floor(number)) & (number >= 1)
    rule = "limit must be a whole number from 1"
    if most is not None:
        ok, rule = ok & (number <= most), f"{rule} to {most}"
    return first_error((limit.isNotNull() & ~F.coalesce(ok, F.lit(False)), error("invalid_param", rule)))


def check_references(requests: DataFrame, chains: DataFrame) -> DataFrame:
    """Requests naming a chain that is not in the table get ``not_found``; runs of an empty one ``wrong_state``."""
    known = chains.select("chain_id", F.size("steps").alias("n_steps"))
    return requests.join(known, "chain_id", "left").withColumn(
        "error",
        first_error(
            (F.col("n_steps").isNull(), error("not_found", F.concat(F.lit("no pipeline "), F.col("chain_id").cast("string")))),
            (
                (F.col("n_steps") == 0) & (F.col("action") == "run"),
                error("wrong_state", F.concat(F.col("chain_id").cast("string"), F.lit(" has no steps"))),
            ),
            (
                (F.col("n_steps") == 0) & (F.col("action") == "score"),
                error("empty_result", F.concat(F.lit("pipeline "), F.col("chain_id").cast("string"), F.lit(" has no steps to score"))),
            ),
        ),
    )


def build_chains(specs: DataFrame) -> DataFrame:
    """Fill the defaults of a spec: types from the outer steps, name, origin."""
    first = F.get(F.col("steps"), F.lit(0))["tool_id"]
    last = F.try_element_at(F.col("steps"), F.lit(-1))["tool_id"]

    def given(name: str, *defaults: Column) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), *defaults)

    title = F.when(label_of(first).isNotNull() & label_of(last).isNotNull(), F.concat(label_of(first), F.lit(" chain")))
    return specs.withColumns(
        {
            "name": given("name", title, F.lit("Pipeline")),
            "input_type": given("input_type", in_type_of(first), F.lit("txt")),
            "output_type": given("output_type", out_type_of(last), F.lit("txt")),
            "origin": F.coalesce("origin", F.lit("agent")),
        }
    )


# --------------------------------------------------------------------- edits


def insert_step(steps: Column, tool: Column, position: Column | None = None) -> Column:
    """Insert a step without parameters at a 0-based position, clamped to the ends; NULL appends."""
    step = F.struct(tool.alias("tool_id"), F.expr("cast(map() as map<string,string>)").alias("params"))
    at = F.size(steps) if position is None else F.coalesce(F.greatest(F.lit(0), F.least(position, F.size(steps))), F.size(steps))
    return F.array_insert(steps, at.cast("int") + 1, step)


def remove_step(steps: Column, position: Column) -> Column:
    return F.filter(steps, lambda s, i: i != position)


def follow_last_step(chains: DataFrame) -> DataFrame:
    """After an edit the goal follows the last known step and an earlier score is cleared."""
    last = F.try_element_at(F.col("steps"), F.lit(-1))["tool_id"]
    out = chains.withColumn("output_type", F.coalesce(out_type_of(last), F.col("output_type")))
    return out.withColumn("score", F.lit(None).cast("int")) if "score" in chains.columns else out


# ------------------------------------------------------------------ listings


def explode_steps(chains: DataFrame, *keep: str) -> DataFrame:
    return chains.select("chain_id", *keep, F.posexplode("steps").alias("idx", "step")).select(
        "chain_id", *keep, "idx", "step.*"
    )


def filter_steps(steps: DataFrame, mode: str = "all", io: str | None = None) -> DataFrame:
    """Steps whose transform has the mode and consumes or produces the type."""
    typed = steps.withColumns(
        {
            "in_type": in_type_of(F.col("tool_id")),
            "out_type": out_type_of(F.col("tool_id")),
            "mode": mode_of(F.col("tool_id")),
        }
    ).filter("mode is not null")
    if mode not in ("all", "real", "simulated"):
        raise ValueError("mode must be one of real | simulated | all")
    if mode != "all":
        typed = typed.filter(F.col("mode") == mode)
    if io:
        typed = typed.filter((F.col("in_type") == io) | (F.col("out_type") == io))
    return typed


def filter_reports(requests: DataFrame, transforms: DataFrame) -> DataFrame:
    """Filters ``(request_id, io)`` with the number of transforms they match and, where none does, the available types."""
    sides = transforms.select("tool_id", F.explode(F.array_distinct(F.array("in_type", "out_type"))).alias("io"))
    counts = sides.groupBy("io").agg(F.count(F.lit(1)).alias("n_tools"))
    available = sides.agg(F.array_join(F.sort_array(F.collect_set("io")), " | ").alias("available"))
    joined = requests.join(counts, "io", "left").crossJoin(F.broadcast(available))
    return joined.withColumns(
        {
            "n_tools": F.coalesce("n_tools", F.lit(0).cast("bigint")),
            "error": F.when(F.col("n_tools").isNull(), F.concat(F.lit("empty_result: no transform reads or writes this type; there are "), "available")),
        }
    ).drop("available")


def usage(steps: DataFrame) -> DataFrame:
    """How often every transform occurs, with its mode; unknown ids count as ``unknown``."""
    return steps.groupBy("tool_id").agg(F.count(F.lit(1)).alias("n_steps")).withColumn(
        "mode", F.coalesce(mode_of(F.col("tool_id")), F.lit("unknown"))
    )


def types_touched(steps: DataFrame) -> DataFrame:
    """Distinct types any step consumes or produces.

    Tools are made distinct first: what meets in the union is one row per tool.
    """
    tools = steps.select("tool_id").distinct()
    ins = tools.select(in_type_of(F.col("tool_id")).alias("type"))
    outs = tools.select(out_type_of(F.col("tool_id")).alias("type"))
    return ins.union(outs).filter("type is not null").distinct()


def trap_exposure(steps: DataFrame, transforms: DataFrame, traps: DataFrame) -> DataFrame:
    """Every step with each failure pattern its transform is listed for."""
    listed = transforms.select("tool_id", F.explode("traps").alias("trap_id"))
    dossier = listed.join(traps, "trap_id", "left").withColumn(
        "title", F.coalesce("title", F.lit("(catalogue not loaded)"))
    )
    return steps.join(dossier, "tool_id")


def listed_and_fired(exposure: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Steps of scored chains keep the listed patterns that hit; unscored chains keep all as implicated.

    ``verdicts`` holds the hits of every chain, and ``scored`` says which of them count.
    """
    basis = F.map_from_entries(F.transform("hits", lambda h: F.struct(h["trap_id"], h["basis"])))
    state = F.when(F.col("scored"), F.try_element_at("_basis", F.col("trap_id"))).otherwise(F.lit("implicated"))
    joined = exposure.join(verdicts.select("chain_id", "scored", basis.alias("_basis")), "chain_id", "left")
    known = joined.withColumn("scored", F.coalesce("scored", F.lit(False)))
    return known.withColumn("state", state).where("state is not null").select("chain_id", "idx", "tool_id", "trap_id", "state")


def default_documents(chains: DataFrame, inputs: DataFrame, stored: DataFrame) -> DataFrame:
    """Document for chains without one: the first input of their type that is stored, else the first stored one.

    ``inputs`` are (ord, type, document), ``stored`` the names (name, seq) of the documents there are.
    """
    names = stored.groupBy("name").agg(F.min("seq").alias("seq"))
    here = inputs.join(names, F.col("document") == F.col("name"))
    by_type = here.groupBy("type").agg(F.min_by("document", "ord").alias("by_type"))
    first = names.agg(F.min_by("name", F.struct("seq", "name")).alias("first_stored"))
    return chains.join(by_type, F.col("input_type") == F.col("type"), "left").crossJoin(F.broadcast(first)).withColumn(
        "document", F.coalesce("by_type", "first_stored")
    ).drop("type", "by_type", "first_stored")


def without(chains: DataFrame, deleted: DataFrame) -> DataFrame:
    return chains.join(deleted.select("chain_id"), "chain_id", "left_anti")


def chain_view(chains: DataFrame) -> DataFrame:
    """Listing view: step text with parameters only where there are any, hits as ``id:basis``, note keys only."""

    def step(s: Column) -> Column:
        pairs = F.array_sort(F.transform(F.map_entries(s["params"]), lambda e: F.concat_ws("=", e["key"], e["value"])))
        return F.when(F.size(pairs) > 0, F.concat(s["tool_id"], F.lit("{"), F.array_join(pairs, ";"), F.lit("}"))).otherwise(
            s["tool_id"]
        )

    return chains.select(
        "chain_id", "input_type", "output_type", "origin",
        F.array_join(F.transform("steps", step), " > ").alias("steps_view"),
        "self_score", "score", (F.col("self_score") - F.col("score")).alias("gap"),
        F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["trap_id"], h["basis"])), ",").alias("hits_view"),
        F.array_join(F.array_sort(F.map_keys("claimed")), ",").alias("note_keys"),
    )
