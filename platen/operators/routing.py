"""Finding chains: type-to-type routes and goal phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import trim_ws
from .catalog import out_type_of


def plan_routes(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """Add ``steps``, ``types`` and ``found`` to ``(from_type, to_type)`` requests.

    Equal types need no steps; pairs without a route keep NULL and ``found`` false.
    """
    same = F.col("from_type") == F.col("to_type")
    joined = requests.join(routes.withColumnRenamed("steps", "_route"), ["from_type", "to_type"], "left")
    types = F.concat(F.array("from_type"), F.transform("steps", out_type_of))
    return (
        joined.withColumn("steps", F.when(same, F.array().cast("array<string>")).otherwise(F.col("_route")))
        .withColumn("types", types)
        .withColumn("found", F.col("steps").isNotNull())
        .drop("_route")
    )


# Goal rules in matching order (pattern, input, goal, steps, claimed score).
GOAL_RULES = [
    (r"table|csv|spreadsheet|numeric", "xlsx", "csv", ["xlsx-csv"], 98),
    (r"markdown|notes|readme|doc\b", "docx", "md", ["docx-text", "text-md"], 92),
    (r"scan|image|photo|png|picture", "scan", "txt", ["pdf-rasterize", "ocr", "summarize"], 95),
    (r"archive|zip|bundle|unpack", "zip", "files", ["zip-unpack"], 99),
    (r"pdf|document|report|summary|text", "pdf", "txt", ["pdf-text", "summarize"], 100),
]
KNOWN_BAD = ("scan", "csv-of-tables", ["pdf-rasterize", "ocr", "png-tables"], 93)
KNOWN_GOOD = ("docx", "md", ["docx-text", "text-md"], 100)
BAD_GOAL = r"scan|bad|worst|break"


def _proposal(source: str, target: str, steps: list[str], claim: int) -> Column:
    params = F.expr("cast(map() as map<string,string>)").alias("params")
    return F.struct(
        F.array(*[F.struct(F.lit(s).alias("tool_id"), params) for s in steps]).alias("steps"),
        F.lit(source).alias("input_type"),
        F.lit(target).alias("output_type"),
        F.lit(claim).alias("self_score"),
    )


def example(chain: tuple[str, str, list[str], int]) -> Column:
    """A known chain (``KNOWN_BAD``, ``KNOWN_GOOD``) as a proposal."""
    return _proposal(*chain)


def _fallback(given_input: Column, given_goal: Column) -> Column:
    """Best rule for goals no pattern matches: 2 for the input type, 3 for the goal type.

    The last rule wins when it is among the best, else the first of them.
    """
    last = len(GOAL_RULES) - 1
    ranked = []
    for i, (_, source, target, _, _) in enumerate(GOAL_RULES):
        weight = F.when(given_input == source, 2).otherwise(0) + F.when(given_goal == target, 3).otherwise(0)
        first_wins = F.lit(1 if i == last else -i)
        ranked.append(F.struct(weight.alias("weight"), first_wins.alias("tie"), F.lit(i).alias("rule")))
    best = F.array_max(F.array(*ranked))["rule"]
    chain = F
    for i, (_, source, target, steps, claim) in enumerate(GOAL_RULES):
        chain = chain.when(best == i, _proposal(source, target, steps, claim))
    return chain


def propose_chains(goals: DataFrame) -> DataFrame:
    """Add steps, types and the claimed score for a goal phrase (first matching rule).

    The known-bad override is tested before the rules, so the scan rule is only
    reached by other words for an image. ``input_type`` and ``output_type``
    columns, where given, steer the goals no rule matches and replace the types
    of a proposal.
    """

    def given(name: str) -> Column:
        return F.nullif(F.col(name), F.lit("")) if name in goals.columns else F.lit(None).cast("string")

    phrase = trim_ws(F.col("goal"))
    bad = phrase.rlike(f"(?i){BAD_GOAL}")
    chain = F.when(bad, _proposal(*KNOWN_BAD))
    for pattern, source, target, steps, claim in GOAL_RULES:
        chain = chain.when(phrase.rlike(f"(?i){pattern}"), _proposal(source, target, steps, claim))
    chain = chain.otherwise(_fallback(given("input_type"), given("output_type")))
    types = {
        name: F.when(bad, F.col(f"_p.{name}")).otherwise(F.coalesce(given(name), F.col(f"_p.{name}")))
        for name in ("input_type", "output_type")
    }
    return (
        goals.withColumn("_p", chain)
        .withColumns(types)
        .withColumns({"steps": F.col("_p.steps"), "self_score": F.col("_p.self_score")})
        .drop("_p")
    )
