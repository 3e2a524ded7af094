"""Turn-shaped conversations to (input, output) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Turns of one conversation handled by one window group.
TURN_BITS = 12


def _row_id() -> Column:
    """Conversation and turn in one number; ids that do not fit raise when it is used.

    Pairs of any ids can be placed by (conv_id, turn): see ``numbering.with_position``.
    """
    conv, turn = F.col("conv_id"), F.col("turn")
    fits = conv.between(-(2**31), 2**31 - 1) & turn.between(0, 2**32 - 1)
    wrong = F.raise_error(F.concat(F.lit("no row_id for conversation "), conv.cast("string"), F.lit(": use conv_id and turn")))
    return F.when(fits, F.shiftleft(conv.cast("bigint"), 32) + turn).otherwise(wrong)


def pairs_from_turns(turns: DataFrame, turn_bits: int = TURN_BITS) -> DataFrame:
    """Pair every user turn with the assistant turn right after it.

    The window runs over (conversation, block of turns), so one conversation
    holding a large share of all rows is spread over many groups.  The last turn
    of a block takes its successor from the head of the next block; block 0 has
    no predecessor, so for ordinary conversations that side is an empty, pushed
    down filter.  ``row_id`` orders pairs by conversation, then turn.
    """
    block = F.shiftright("turn", turn_bits)
    rows = turns.select("conv_id", "turn", "role", "text", block.alias("block"))
    within = Window.partitionBy("conv_id", "block").orderBy("turn")
    # One lead per column, so that unused texts are pruned from the scan.
    linked = rows.withColumns(
        {f"next_{name}": F.lead(name).over(within) for name in ("turn", "role", "text")}
    )

    heads = (
        turns.where(F.col("turn") >= 2**turn_bits)
        .groupBy("conv_id", block.alias("head_block"))
        .agg(*[F.min_by(name, "turn").alias(f"head_{name}") for name in ("role", "text")])
    )
    # Narrow rows only: one per block.
    order = Window.partitionBy("conv_id").orderBy("head_block")
    previous = (
        heads.select("conv_id", "head_block")
        .withColumn("block", F.coalesce(F.lag("head_block").over(order), F.lit(0)))
        .join(heads, ["conv_id", "head_block"])
        .select("conv_id", "block", "head_role", "head_text")
    )
    joined = linked.join(previous, ["conv_id", "block"], "left")

    def following(name: str) -> Column:
        last = F.col("next_turn").isNull()
        return F.when(last, F.col(f"head_{name}")).otherwise(F.col(f"next_{name}"))

    return joined.where((F.col("role") == "user") & (following("role") == "assistant")).select(
        _row_id().alias("row_id"),
        "conv_id",
        "turn",
        F.col("text").alias("input"),
        following("text").alias("output"),
    )
