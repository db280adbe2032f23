"""Type-checking conversion chains without running them: in-row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lang import let
from .catalog import connector_between, in_type_of, label_of, mode_of, out_type_of


def _issue(kind: str, step: Column, message: Column, fix: Column | None = None, bridge: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("kind"),
        step.cast("int").alias("step"),
        message.alias("message"),
        (none if fix is None else fix).alias("fix"),
        (none if bridge is None else bridge).alias("bridge"),
    )


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def with_current_types(chains: DataFrame) -> DataFrame:
    """Add ``known``: per step its catalogue entry and the type the chain holds before it.

    That type is the output of the last *known* step, else the input type;
    unknown steps leave it unchanged, a type error does not.
    """
    looked_up = F.transform(
        "steps",
        lambda s: F.struct(
            s["tool_id"].alias("tool_id"),
            label_of(s["tool_id"]).alias("label"),
            in_type_of(s["tool_id"]).alias("in_type"),
            out_type_of(s["tool_id"]).alias("out_type"),
            mode_of(s["tool_id"]).alias("mode"),
        ),
    )

    def hold(acc: Column, s: Column) -> Column:
        """Append the step with the type held so far; a known step hands on its own output."""
        entry = F.struct(
            s["tool_id"].alias("tool_id"), s["label"].alias("label"), s["in_type"].alias("in_type"),
            s["out_type"].alias("out_type"), s["mode"].alias("mode"), acc["held"].alias("current"),
        )
        return F.struct(
            F.array_append(acc["known"], entry).alias("known"), F.coalesce(s["out_type"], acc["held"]).alias("held")
        )

    none = F.expr(
        "cast(array() as array<struct<tool_id:string,label:string,in_type:string,out_type:string,mode:string,current:string>>)"
    )
    start = F.struct(none.alias("known"), F.nullif(F.col("input_type"), F.lit("")).alias("held"))
    return chains.withColumn("_known", looked_up).withColumn(
        "known", F.aggregate("_known", start, hold, lambda acc: acc["known"])
    ).drop("_known")


def step_error(s: Column, i: Column) -> Column:
    """The error of step ``i``, a struct with tool_id, label, in_type and the ``current`` type; NULL if it fits."""
    unknown = _issue("unknown-tool", i, _text("the catalogue has no tool ", s["tool_id"]))
    bridge = connector_between(s["current"], s["in_type"])
    fix = F.when(
        bridge.isNotNull(), _text("put ", bridge, " before step ", i + 1)
    ).otherwise(_text("no tool leads from ", s["current"], " to ", s["in_type"]))
    gap = _issue(
        "missing-connector",
        i,
        _text("step ", i + 1, " (", s["label"], ") reads ", s["in_type"], ", but gets ", s["current"]),
        fix,
        bridge,
    )
    return F.when(s["in_type"].isNull(), unknown).when(s["current"] != s["in_type"], gap)


def step_warning(s: Column, i: Column) -> Column:
    return F.when(
        s["mode"] == "simulated", _issue("simulated", i, _text("step ", i + 1, " (", s["label"], ") only simulates its result"))
    )


def goal_error(ends_at: Column, goal: Column) -> Column:
    bridge = connector_between(ends_at, goal)
    return F.when(
        ends_at != goal,
        _issue(
            "goal-mismatch",
            F.lit(None),
            _text("the last step gives ", ends_at, ", wanted is ", goal),
            F.when(bridge.isNotNull(), _text("add ", bridge, " at the end")).otherwise(
                _text("no tool leads from ", ends_at, " to ", goal)
            ),
            bridge,
        ),
    )


def empty_error(n_steps: Column) -> Column:
    return F.when(n_steps == 0, _issue("empty", F.lit(None), F.lit("the chain is empty")))


def validate_chains(chains: DataFrame) -> DataFrame:
    """Add ``errors``, ``warnings``, ``chain``, ``ends_at``, ``goal`` and ``ok``."""
    known = F.col("known")

    def present(issues: Column) -> Column:
        return F.filter(issues, lambda e: e.isNotNull())

    outs = F.filter(F.transform(known, lambda s: s["out_type"]), lambda t: t.isNotNull())
    first = F.nullif(F.col("input_type"), F.lit(""))
    goal = F.nullif(F.col("output_type"), F.lit(""))
    ends_at = F.coalesce(F.try_element_at(outs, F.lit(-1)), first)
    mismatch = goal_error(F.col("ends_at"), F.col("goal"))
    empty = empty_error(F.size("steps"))
    path = F.concat(F.array(first), F.transform(known, lambda s: F.coalesce(s["out_type"], F.lit("?"))))
    return (
        with_current_types(chains)
        .withColumn("ends_at", ends_at)
        .withColumn("goal", goal)
        .withColumn("errors", present(F.concat(F.array(empty), F.transform(known, step_error), F.array(mismatch))))
        .withColumn("warnings", present(F.transform(known, step_warning)))
        .withColumn("chain", F.filter(path, lambda t: t.isNotNull()))
        .withColumn("ok", F.size("errors") == 0)
        .drop("known")
    )


def suggested_insert(chains: DataFrame) -> DataFrame:
    """Apply the first one-step connector a validated chain asks for (a bulk edit of the table)."""
    from .definitions import insert_step

    def usable(e: Column) -> Column:
        return (e["kind"] == "missing-connector") & e["bridge"].isNotNull() & ~F.contains(e["bridge"], F.lit("→"))

    first = F.get(F.filter("errors", usable), F.lit(0))
    edited = let(
        F.struct(first["step"].alias("at"), first["bridge"].alias("tool")),
        lambda x: F.when(x["at"].isNull(), F.col("steps")).otherwise(insert_step(F.col("steps"), x["tool"], x["at"])),
    )
    return chains.withColumn("steps", edited)
