"""Histories that share what they have in common.

The history before a turn is a prefix of its conversation's pairs. So pairs are stored once, in
segments of bounded length that never change, and a turn holds only how many pairs come before
it: the first segments whole and a part of the next one. Stored bytes grow with the pairs, not
with their square, and a conversation that goes on adds segments and turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.operators.chat import PAIR
from talkloom.plans.numbering import number_rows
from talkloom.plans.segments import null_safe_join
from talkloom.sources.scratch import written

#: Pairs of a segment.
LENGTH = 64


def shared_histories(pairs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """``turns(conv_id, turn, before)`` and ``segments(conv_id, segment, pairs)`` of ``pair_turns``' rows.

    ``before`` counts the earlier pairs. ``length`` pairs make a segment, the last one of a
    conversation may be shorter. A conversation of any length is numbered and cut by many tasks.
    """
    stored = written(pairs.select("conv_id", "turn", "prompt", "resp"), "pairs")
    numbered = number_rows(stored.select("conv_id", "turn"), ["conv_id", "turn"], "_number")
    first = numbered.groupBy("conv_id").agg(F.min("_number").alias("_first"))
    turns = null_safe_join(numbered, first, ["conv_id"], "inner").select(
        "conv_id", "turn", (F.col("_number") - F.col("_first")).alias("before")
    )
    turns = written(turns, "history-turns")
    pair = F.struct("before", "prompt", "resp")
    segments = (
        null_safe_join(stored, turns, ["conv_id", "turn"], "inner")
        .groupBy("conv_id", F.floor(F.col("before") / length).alias("segment"))
        .agg(F.sort_array(F.collect_list(pair)).alias("pairs"))
        .select("conv_id", "segment", F.transform("pairs", lambda p: F.struct(p["prompt"], p["resp"])).cast(PAIR).alias("pairs"))
    )
    return turns, written(segments, "history-segments")


def history_pieces(turns: DataFrame, segments: DataFrame, max_pairs: int | None = None, length: int = LENGTH) -> DataFrame:
    """Rows ``(conv_id, turn, segment, pairs)``: the histories of ``turns``, a bounded piece each, in order of ``segment``.

    ``max_pairs`` keeps the latest pairs. A turn without a history has no row.
    """
    start = F.lit(0).cast("long") if max_pairs is None else F.greatest(F.col("before") - max_pairs, F.lit(0))
    wanted = turns.withColumn("_start", start).where(F.col("_start") < F.col("before")).withColumn(
        "segment", F.explode(F.sequence(F.floor(F.col("_start") / length), F.floor((F.col("before") - 1) / length)))
    )
    low = F.greatest(F.col("_start") - F.col("segment") * length, F.lit(0))
    high = F.least(F.col("before") - F.col("segment") * length, F.lit(length))
    return null_safe_join(wanted, segments, ["conv_id", "segment"], "inner").select(
        "conv_id", "turn", "segment", F.slice("pairs", (low + 1).cast("int"), (high - low).cast("int")).alias("pairs")
    )


def expanded_histories(turns: DataFrame, segments: DataFrame, max_pairs: int | None = None, length: int = LENGTH) -> DataFrame:
    """``turns`` with ``history`` as ``history_before`` gives it: one array a turn, as long as the history is.

    Choose the turns first: all histories of a long conversation are as large as its square.
    """
    pieces = history_pieces(turns, segments, max_pairs, length)
    whole = pieces.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("segment", "pairs"))).alias("_pieces"))
    joined = null_safe_join(turns, whole, ["conv_id", "turn"], "left")
    history = F.flatten(F.transform("_pieces", lambda p: p["pairs"]))
    return joined.withColumn("history", F.coalesce(history, F.array().cast(PAIR))).drop("_pieces")
