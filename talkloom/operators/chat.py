"""Conversation state: prompt/reply pairs, the history before a turn, system messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions.tools import SYSTEM_CONTENT, tool_specs
from talkloom.plans.segments import SEGMENT, has_long_groups, next_row, null_safe_join, segment_of

PAIR = "array<struct<prompt:string,resp:string>>"


def pair_turns(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``(conv_id, turn, prompt, resp)``: each user turn answered by the very next turn."""
    seen = next_row(
        turns.select("conv_id", "turn", "role", "text"),
        ["conv_id"],
        "turn",
        ["role", "text"],
        "answer",
        segment,
    )
    return seen.filter((F.col("role") == "user") & (F.col("answer.role") == "assistant")).select(
        "conv_id", "turn", F.col("text").alias("prompt"), F.col("answer.text").alias("resp")
    )


def history_before(
    pairs: DataFrame,
    add_history: bool = True,
    max_pairs: int | None = None,
    turns: DataFrame | None = None,
    segment: int = SEGMENT,
) -> DataFrame:
    """Add ``history``: the earlier pairs of the conversation, oldest first.

    ``add_history=False`` keeps every history empty. ``max_pairs`` keeps the latest ones.
    A long conversation is worked on in segments; the pairs of earlier segments are
    put in front. Give the stored ``turns`` the pairs come from, if at hand: whether any
    conversation is long is then read off them instead of making the pairs twice.
    """
    if not add_history:
        return pairs.withColumn("history", F.array().cast(PAIR))
    pair = F.struct("prompt", "resp")
    start = Window.unboundedPreceding if max_pairs is None else -max_pairs
    if not has_long_groups(pairs if turns is None else turns, "turn", segment):
        whole = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(start, -1)
        return pairs.withColumn("history", F.collect_list(pair).over(whole).cast(PAIR))
    rows = pairs.withColumn("_seg", segment_of("turn", segment))
    inside = Window.partitionBy("conv_id", "_seg").orderBy("turn").rowsBetween(start, -1)
    local = rows.withColumn("history", F.collect_list(pair).over(inside))

    late = pairs.filter(F.col("turn") >= segment).select("conv_id").distinct()
    blocks = (
        null_safe_join(pairs, late, ["conv_id"], "left_semi")
        .groupBy("conv_id", segment_of("turn", segment).alias("_seg"))
        .agg(F.sort_array(F.collect_list(F.struct("turn", "prompt", "resp"))).alias("block"))
        .withColumn("block", F.transform("block", lambda p: F.struct(p["prompt"], p["resp"])))
    )
    if max_pairs is not None:
        blocks = blocks.withColumn("block", _last("block", max_pairs))
    along = Window.partitionBy("conv_id").orderBy("_seg").rowsBetween(start, -1)
    carried = blocks.select(
        "conv_id", "_seg", F.flatten(F.collect_list("block").over(along)).cast(PAIR).alias("_front")
    )
    joined = null_safe_join(local, carried, ["conv_id", "_seg"], "left")
    history = F.concat(F.coalesce("_front", F.array().cast(PAIR)), F.col("history").cast(PAIR))
    joined = joined.withColumn("history", history)
    if max_pairs is not None:
        joined = joined.withColumn("history", _last("history", max_pairs))
    return joined.drop("_seg", "_front")


def _last(column: str, n: int):
    size = F.size(column)
    return F.slice(F.col(column), F.greatest(size - n, F.lit(0)) + 1, F.lit(n))


def seed_system(histories: DataFrame, turns: DataFrame) -> DataFrame:
    """Add ``messages``: a system message with the tool list, then the history in order.

    The system text is the conversation's first system turn, else the standard one.
    """
    system = (
        turns.filter(F.col("role") == "system")
        .groupBy("conv_id")
        .agg(F.min_by("text", "turn").alias("system"))
    )
    specs = tool_specs()
    no_tools = F.lit(None).cast("array<" + _spec_type() + ">")
    content = F.coalesce(F.col("system"), F.lit(SYSTEM_CONTENT))
    first = F.struct(
        F.lit("system").alias("role"), content.alias("content"), specs.alias("tools")
    )

    def spoken(role, text):
        return F.struct(F.lit(role).alias("role"), text.alias("content"), no_tools.alias("tools"))

    said = F.flatten(
        F.transform(
            "history", lambda p: F.array(spoken("user", p["prompt"]), spoken("assistant", p["resp"]))
        )
    )
    return (
        null_safe_join(histories, system, ["conv_id"], "left")
        .withColumn("messages", F.concat(F.array(first), said))
        .drop("system")
    )


def _spec_type() -> str:
    from talkloom.sources.schemas import TOOL_SPEC

    return TOOL_SPEC.simpleString()
