"""Preference formatting: one prompt, two masked completions.

The turns that the chosen and the rejected conversation share from the start are rendered once as
the prompt; what remains of each side is its completion. Loss masks are character spans of the
completions that cover what the assistant says and the mark that ends its turn, nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .rows import pick

OPEN, CLOSE = "<|turn|>", "<|end|>"
TURNS = "array<struct<role:string,text:string>>"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): turns in order (ties by role, then text), NULL role and text empty; NULL ids form one conversation."""
    t = pick(turns, conv_id=id_col, turn=turn_col, role=role_col, text=text_col)
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    listed = F.sort_array(F.collect_list(one))
    return t.groupBy("conv_id").agg(F.transform(listed, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def _rendered(turn: Column) -> Column:
    """A turn with its marks; the marks' opening inside a text is broken up so that no text can end its turn."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(OPEN), safe(turn["role"]), F.lit("\n"), safe(turn["text"]), F.lit(CLOSE + "\n"))


def _mask(turns: Column, texts: Column, speaker: str) -> Column:
    """Spans start:end of what ``speaker`` says, mark included, over the concatenation of ``texts``."""
    ends = F.transform(texts, lambda _, i: F.aggregate(F.slice(texts, F.lit(1), i + 1), F.lit(0), lambda n, t: n + F.length(t)))
    spans = F.zip_with(
        F.zip_with(turns, texts, lambda t, x: F.struct(t["role"].alias("role"), F.length(x).alias("n"))), ends,
        lambda t, end: F.when(
            t["role"] == speaker,
            F.concat_ws(":", end - t["n"] + len(OPEN) + len(speaker) + 1, end - 1),
        ),
    )
    return F.array_join(F.filter(spans, lambda s: s.isNotNull()), ",")


def preferences(pairs: DataFrame, speaker: str = "assistant") -> DataFrame:
    """Format (pair_id, chosen, rejected), both arrays of (role, text), in the row.

    Gives pair_id, n_common (turns of the prompt), prompt, chosen, rejected, chosen_mask,
    rejected_mask, n_chosen, n_rejected (turns of the completions). A NULL side is empty. Equal
    sides share all turns, and both completions are empty; sides that share nothing have an empty
    prompt. Repeated rows give repeated results. A conversation is a value of one row.
    """
    side = lambda c: F.coalesce(F.col(c), F.array().cast(TURNS))
    same = F.zip_with("c", "r", lambda a, b: a.eqNullSafe(b))
    first_other = F.array_position(same, F.lit(False)).cast("int")
    least = F.least(F.size("c"), F.size("r"))
    cut = lambda c: F.slice(c, F.col("n_common") + 1, F.size(c))
    out = (
        pairs.select("pair_id", side("chosen").alias("c"), side("rejected").alias("r"))
        .withColumn("n_common", F.when(first_other > 0, first_other - 1).otherwise(least))
        .select("pair_id", "n_common", F.slice("c", F.lit(1), F.col("n_common")).alias("p"), cut("c").alias("c"), cut("r").alias("r"))
        .withColumns({f"{x}t": F.transform(x, _rendered) for x in "pcr"})
    )
    return out.select(
        "pair_id", "n_common", F.array_join("pt", "").alias("prompt"), F.array_join("ct", "").alias("chosen"),
        F.array_join("rt", "").alias("rejected"), _mask(F.col("c"), F.col("ct"), speaker).alias("chosen_mask"),
        _mask(F.col("r"), F.col("rt"), speaker).alias("rejected_mask"), F.size("c").alias("n_chosen"), F.size("r").alias("n_rejected"),
    )


def with_other_replies(convs: DataFrame, speaker: str = "assistant") -> DataFrame:
    """Pairs out of single conversations: rejected is the conversation with the last reply of its neighbour.

    Conversations 2i and 2i + 1 are neighbours; each is chosen once, and rejected for it is the same
    conversation whose last ``speaker`` turn says what the neighbour's last one says. Without a
    neighbour, or a reply of it, the rejected side ends before the reply. Keys hold two
    conversations each, so none is hot.
    """
    last = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), F.lit(speaker)).cast("int")
    own = convs.select(
        "conv_id", "turns", F.floor(F.col("conv_id") / 2).alias("couple"),
        F.when(last < F.size("turns"), last).alias("at"),  # place of the last reply, from 0
    ).withColumn("reply", F.get("turns", F.col("at"))["text"])
    other = own.where("conv_id is not null").select(
        F.col("couple").alias("o_couple"), F.col("conv_id").alias("o_id"), F.col("reply").alias("o_reply")
    )
    joined = own.join(other, (F.col("couple") == F.col("o_couple")) & (F.col("conv_id") != F.col("o_id")), "left")
    head = F.slice("turns", F.lit(1), F.coalesce("at", F.size("turns")))
    tail = F.when(F.col("at").isNotNull(), F.slice("turns", F.col("at") + 2, F.size("turns"))).otherwise(F.array().cast(TURNS))
    reply = F.when(
        F.col("at").isNotNull() & F.col("o_reply").isNotNull(),
        F.array(F.struct(F.lit(speaker).alias("role"), F.col("o_reply").alias("text"))),
    ).otherwise(F.array().cast(TURNS))
    return joined.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.concat(head, reply, tail).alias("rejected"))
