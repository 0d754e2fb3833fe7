"""Names of a large registry against the form in the plan, and shared histories against whole ones."""

import random

import pytest
from pyspark.sql import functions as F

from talkloom.operators import chat as H
from talkloom.operators.registry import match_registry
from talkloom.operators.route import match_tools
from talkloom.operators.shared_history import expanded_histories, history_pieces, shared_histories


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("block_chars", [1_000_000, 12])
def test_equals_the_form_in_the_plan(spark, block_chars):
    rng = random.Random(2)
    names = ["ab", "b", "abc", "bca", "中文", "文a", "😀b", "ab", "zz", " ", "a.b", "xyz", "c"]
    texts = ["".join(rng.choices("abc中文😀 .", k=rng.randrange(0, 30))) for _ in range(120)] + [None, "", "zz zz"]
    replies = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    replies = replies.withColumn("ord", F.lit(1)).withColumn("name", F.lit("n"))
    registry = spark.createDataFrame([*enumerate(names), (99, None)], "ord int, name string")
    got = match_registry(replies, registry, "text", "found", block_chars)
    assert got.columns == [*replies.columns, "found"]
    assert rows(got) == rows(replies.withColumn("found", match_tools(F.col("text"), names)))


def test_the_empty_name_and_no_names(spark):
    replies = spark.createDataFrame([(1, "ab"), (2, ""), (3, None)], "id long, reply string")
    registry = spark.createDataFrame([(0, "b"), (1, "")], "ord int, name string")
    expected = replies.withColumn("matches", match_tools(F.col("reply"), ["b", ""]))
    assert rows(match_registry(replies, registry)) == rows(expected)
    assert rows(match_registry(replies, registry.where("false"))) == rows(replies.withColumn("matches", F.array()))


def test_a_hundred_thousand_names(spark):
    registry = spark.range(100_000).select(F.col("id").cast("int").alias("ord"), F.concat(F.lit("tool-"), F.format_string("%05d", "id")).alias("name"))
    replies = spark.createDataFrame([(1, "use tool-99999, then tool-00007"), (2, "tool-5"), (3, "tool-123456")], "id long, reply string")
    got = {r.id: [(m["at"], m["ord"]) for m in r.matches] for r in match_registry(replies, registry, block_chars=400_000).collect()}
    assert got == {1: [(4, 99_999), (21, 7)], 2: [], 3: [(0, 12_345)]}


def made_pairs(spark):
    sizes = [1, 2, 3, 7, 10]
    made = [(None if k == 3 else k, 2 * t, f"p{k}.{t}", None if t == 4 else f"r{k}.{t}") for k, n in enumerate(sizes) for t in range(n)]
    return spark.createDataFrame(made, "conv_id long, turn long, prompt string, resp string").repartition(4)


@pytest.mark.parametrize("length", [1, 3, 64])
@pytest.mark.parametrize("max_pairs", [None, 0, 2, 5])
def test_expanded_histories_equal_whole_ones(spark, length, max_pairs):
    pairs = made_pairs(spark)
    turns, segments = shared_histories(pairs, length)
    got = expanded_histories(turns, segments, max_pairs, length).select("conv_id", "turn", "history")
    whole = H.history_before(pairs)
    if max_pairs is not None:
        whole = whole.withColumn("history", F.expr(f"slice(history, greatest(size(history) - {max_pairs}, 0) + 1, {max_pairs})"))
    assert rows(got) == rows(whole.select("conv_id", "turn", "history"))


def test_a_long_conversation_is_stored_in_proportion(spark):
    n = 50_000
    pairs = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), (2 * F.col("id")).alias("turn"), F.concat(F.lit("p"), "id").alias("prompt"), F.lit("r").alias("resp"))
    turns, segments = shared_histories(pairs)
    assert turns.count() == n and segments.agg(F.sum(F.size("pairs")), F.max(F.size("pairs"))).first()[:] == (n, 64)
    late = turns.where(F.col("turn") == 2 * (n - 1))
    pieces = history_pieces(late, segments)
    assert pieces.agg(F.sum(F.size("pairs")), F.max(F.size("pairs"))).first()[:] == (n - 1, 64)
    latest = expanded_histories(late, segments, max_pairs=100).first().history
    assert [p.prompt for p in latest] == [f"p{k}" for k in range(n - 101, n - 1)]
