"""Type-checking chains that are stored as a long step table: (chain_id, idx, tool_id).

The type a chain holds before a step is the output of the last known step before it. That is a carry
along the chain, done in bands of ``BAND`` positions: inside a band by a window over the band, between
bands by one small row per band that hands its last known output on. A chain that holds a third of all
steps is spread over its bands; only the rows of its bands meet, one per ``BAND`` positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .catalog import TRANSFORMS, in_type_of, label_of, mode_of, order_of, out_type_of
from .validate import empty_error, goal_error, step_error, step_warning

BAND = 4096


def _last_known() -> Column:
    """The last known tool of a group of steps: its position and place in the catalogue in one number, so that tasks sum up by hash."""
    return F.max(F.col("idx").cast("long") * len(TRANSFORMS) + F.col("_ord"))


def _output(last: Column) -> Column:
    return F.get(F.array(*[F.lit(t.out_type) for t in TRANSFORMS]), F.pmod(last, F.lit(len(TRANSFORMS))).cast("int"))


def _given(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def typed_steps(steps: DataFrame, chains: DataFrame, band: int = BAND) -> DataFrame:
    """Steps with ``label``, ``in_type``, ``out_type``, ``mode`` of the catalogue, and ``current``, the type before the step.

    ``chains`` gives (chain_id, input_type), one row per chain; a chain without a row, or with an empty
    type, begins without a type. Rows with a NULL chain or position have no place in a chain and are left
    out; steps that share a position stand in the order of the catalogue, unknown ones first.
    """
    known = steps.where("chain_id is not null and idx is not null").select(
        "chain_id", "idx", "tool_id", label_of(F.col("tool_id")).alias("label"), in_type_of(F.col("tool_id")).alias("in_type"),
        out_type_of(F.col("tool_id")).alias("out_type"), mode_of(F.col("tool_id")).alias("mode"), F.floor(F.col("idx") / band).alias("_band"), order_of(F.col("tool_id")).alias("_ord"),
    )
    last = known.groupBy("chain_id", "_band").agg(_last_known().alias("_at")).select("chain_id", "_band", _output(F.col("_at")).alias("_last"))
    earlier = Window.partitionBy("chain_id").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    handed = last.join(chains.select("chain_id", _given("input_type").alias("_input")), "chain_id", "left").select(
        "chain_id", "_band", F.coalesce(F.last("_last", ignorenulls=True).over(earlier), F.col("_input")).alias("_handed")
    )
    inside = Window.partitionBy("chain_id", "_band").orderBy("idx", "_ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = known.withColumn("_own", F.last("out_type", ignorenulls=True).over(inside))
    return placed.join(handed, ["chain_id", "_band"]).select(
        "chain_id", "idx", "tool_id", "label", "in_type", "out_type", "mode", F.coalesce("_own", "_handed").alias("current")
    )


def chain_ends(typed: DataFrame, chains: DataFrame) -> DataFrame:
    """Per row of ``chains`` (chain_id, n_steps, ends_at, goal, n_simulated, n_unfit).

    ``n_unfit`` counts unknown tools and steps that read another type than they get. One partial
    aggregate per task; a chain without steps ends at its input type.
    """
    unfit = F.col("in_type").isNull() | (F.col("current") != F.col("in_type"))
    found = typed.withColumn("_ord", order_of(F.col("tool_id"))).groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("n_steps"), F.count_if(F.col("mode") == "simulated").alias("n_simulated"), F.count_if(unfit).alias("n_unfit"),
        _last_known().alias("_at"),
    ).withColumn("_last", _output(F.col("_at")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return chains.select("chain_id", _given("input_type").alias("_input"), _given("output_type").alias("goal")).join(found, "chain_id", "left").select(
        "chain_id", zero("n_steps"), F.coalesce("_last", "_input").alias("ends_at"), "goal", zero("n_simulated"), zero("n_unfit")
    )


def _step() -> Column:
    return F.struct("tool_id", "label", "in_type", "current")


def validate_steps(steps: DataFrame, chains: DataFrame, band: int = BAND) -> DataFrame:
    """One row per error: (chain_id, kind, step, message, fix, bridge), as ``validate.validate_chains`` finds them.

    ``chains`` has (chain_id, input_type, output_type). Warnings are ``simulated_steps``.
    """
    typed = typed_steps(steps, chains, band)
    found = typed.select("chain_id", step_error(_step(), F.col("idx")).alias("e"))
    ends = chain_ends(typed, chains)
    of_chains = ends.select("chain_id", F.explode(F.array(goal_error(F.col("ends_at"), F.col("goal")), empty_error(F.col("n_steps")))).alias("e"))
    return found.union(of_chains).where("e is not null").select("chain_id", "e.*")


def simulated_steps(steps: DataFrame) -> DataFrame:
    """(chain_id, step, message) of the steps that only simulate their result; no shuffle."""
    named = steps.select("chain_id", "idx", "tool_id", label_of(F.col("tool_id")).alias("label"), mode_of(F.col("tool_id")).alias("mode"))
    warned = named.where("mode = 'simulated'").withColumn("w", step_warning(F.struct("label", "mode"), F.col("idx")))
    return warned.select("chain_id", "w.step", "w.message")


def chain_states(steps: DataFrame, chains: DataFrame, band: int = BAND) -> DataFrame:
    """Per chain (chain_id, ends_at, goal, n_errors, n_warnings, ok); warnings do not count against ``ok``."""
    ends = chain_ends(typed_steps(steps, chains, band), chains)
    errors = F.col("n_unfit") + F.coalesce((F.col("ends_at") != F.col("goal")).cast("long"), F.lit(0)) + (F.col("n_steps") == 0).cast("long")
    return ends.select("chain_id", "ends_at", "goal", errors.alias("n_errors"), F.col("n_simulated").alias("n_warnings"), (errors == 0).alias("ok"))
