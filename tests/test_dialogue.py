"""Routing, tool calls, conversation state and growing replies."""

import json
import random

import pytest
from pyspark.sql import functions as F

from talkloom.functions import plugins as U
from talkloom.functions.tools import ALLOWED_EMOTIONS, DECLARED_TOOLS, SYSTEM_CONTENT, tool_table
from talkloom.functions.strings import allowed_value
from talkloom.operators import chat as H
from talkloom.operators import route as N
from talkloom.streaming import replies as ST


def test_matches_follow_first_appearance_then_registry(spark):
    names = ["default", "ab", "a", "b"]
    rng = random.Random(4)
    texts = ["".join(rng.choices(["a", "b", "c", "default"], k=4)) for _ in range(60)] + ["", "zzz"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, reply string")
    rows = df.select("i", N.match_tools(F.col("reply"), names).alias("m"),
                     N.route(F.col("reply"), names).alias("tool")).collect()
    for r in rows:
        found = [(n, texts[r.i].index(n)) for n in names if n in texts[r.i]]
        found.sort(key=lambda x: x[1])
        assert [(m.name, m.at) for m in r.m] == found
        assert r.tool == (found[0][0] if found else "default")


def test_calls_are_told_from_text(spark):
    replies = ['{"name": "f", "parameters": {"a": 1, "b": "x"}}', "plain", "[1]", "{broken", None]
    df = spark.createDataFrame(list(enumerate(replies)), "i int, reply string")
    calls = [r.c for r in df.orderBy("i").select(N.parse_tool_call(F.col("reply")).alias("c")).collect()]
    assert (calls[0].name, calls[0].parameters) == ("f", {"a": "1", "b": "x"})
    assert calls[1:] == [None] * 4


def test_declared_tools_and_functions(spark):
    """One declared tool has no function of its name: it is what the anti join gives."""
    specs = tool_table(spark)
    assert [json.loads(r[0]) for r in specs.select(F.to_json(F.struct("*"))).collect()] == DECLARED_TOOLS
    functions = N.tool_registry(spark, {"senior_emotional_expert": None, "flirting_hutao": None})
    functions = functions.withColumnRenamed("tool_name", "name")
    calls = spark.createDataFrame(
        [("emotional_expert", {"emotion": "爱"}), ("flirting_hutao", {"emotion": "爱"}), ("x", None)],
        "name string, parameters map<string,string>")
    assert {r.name for r in N.resolve_calls(calls, functions).collect()} == {"flirting_hutao"}
    assert {r.name for r in N.unresolved_calls(calls, functions).collect()} == {"emotional_expert", "x"}
    required = specs.select("name", "parameters.required")
    lacking = N.missing_parameters(calls, required).collect()
    assert [(r.name, r.missing) for r in lacking] == [("flirting_hutao", ["user"])]


def test_tool_functions_by_name(spark):
    calls = spark.createDataFrame([("expert", {"emotion": "爱"}), ("expert", {"emotion": "恨"}), ("other", {})],
                                  "name string, parameters map<string,string>")
    done = U.apply_tools(calls, {"expert": lambda p: allowed_value(p["emotion"], ALLOWED_EMOTIONS)})
    assert [r.result for r in done.collect()] == ['{"emotion":"爱","user":"旅行者"}', "null", None]
    assert U.apply_tools(calls, {}).filter("result is not null").count() == 0


def conversations(seed=6):
    """One conversation holds most turns; turn numbers have gaps."""
    rng = random.Random(seed)
    rows = []
    for conv, n in [(0, 90), (1, 7), (2, 1), (3, 12)]:
        turn = rng.randrange(0, 3)
        for _ in range(n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system"])
            rows.append((conv, turn, role, f"{conv}:{turn}"))
            turn += rng.choice([1, 1, 1, 2, 15])
    return rows


def replay_pairs(rows):
    pairs = []
    for (c, t, role, text), (c2, _, role2, text2) in zip(rows, rows[1:]):
        if c == c2 and (role, role2) == ("user", "assistant"):
            pairs.append((c, t, text, text2))
    return pairs


@pytest.mark.parametrize("segment", [1, 5, 4096])
@pytest.mark.parametrize("max_pairs", [None, 1, 3])
def test_pairs_and_histories_across_segments(spark, segment, max_pairs):
    rows = conversations()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    pairs = H.pair_turns(turns, segment)
    expected = replay_pairs(rows)
    assert sorted(map(tuple, pairs.collect())) == expected
    got = H.history_before(pairs, max_pairs=max_pairs, segment=segment).collect()
    assert len(got) == len(expected)
    for r in got:
        earlier = [(p, a) for c, t, p, a in expected if c == r.conv_id and t < r.turn]
        assert [tuple(h) for h in r.history] == (earlier[-max_pairs:] if max_pairs else earlier)


def test_history_switch_and_system_seed(spark):
    rows = conversations()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pairs = H.pair_turns(turns)
    off = H.history_before(pairs, add_history=False)
    assert off.filter(F.size("history") > 0).count() == 0 and off.count() == pairs.count()
    first = {}
    for c, _, role, text in rows:
        if role == "system":
            first.setdefault(c, text)
    for r in H.seed_system(H.history_before(pairs), turns).collect():
        head, *said = r.messages
        assert (head.role, head.content) == ("system", first.get(r.conv_id, SYSTEM_CONTENT))
        assert [t.name for t in head.tools] == [t["name"] for t in DECLARED_TOOLS]
        assert [(m.role, m.content) for m in said] == [
            x for p, a in r.history for x in (("user", p), ("assistant", a))]


def snapshot_rows():
    rng = random.Random(8)
    rows = []
    for conv in range(5):
        for turn in range(3):
            text, seq = "", 0
            for _ in range(rng.randrange(1, 30)):
                text += rng.choice(["ab", "中", "😀 ", "c\n"])
                seq += rng.choice([1, 1, 4])
                rows.append((conv, turn, f"p{turn}", seq, text))
    return rows


def replay_deltas(rows):
    seen, out = {}, []
    for c, t, _, seq, text in rows:
        out.append((c, t, seq, text[seen.get((c, t), 0):]))
        seen[c, t] = len(text)
    return sorted(out)


SNAPSHOT = "conv_id long, turn long, prompt string, seq long, resp string"


@pytest.mark.parametrize("max_pairs", [None, 2])
def test_null_conversations_keep_their_history_across_segments(spark, max_pairs):
    rows = [(c, 2 * k, f"p{k}", f"r{k}") for c in (None, 1) for k in range(6)]
    pairs = spark.createDataFrame(rows, "conv_id long, turn long, prompt string, resp string")
    tiny, whole = (H.history_before(pairs, max_pairs=max_pairs, segment=n).collect() for n in (3, 4096))
    assert sorted(map(str, tiny)) == sorted(map(str, whole))
    assert {(r.conv_id, len(r.history)) for r in tiny} == {(c, min(k, max_pairs or k)) for c in (None, 1) for k in range(6)}


def test_null_conversations_take_their_system_turn(spark):
    turns = spark.createDataFrame([(None, 0, "system", "own"), (1, 0, "system", "other")], "conv_id long, turn long, role string, text string")
    pairs = spark.createDataFrame([(None, 1, "p", "r"), (1, 1, "p", "r")], "conv_id long, turn long, prompt string, resp string")
    seeded = H.seed_system(H.history_before(pairs), turns).collect()
    assert {(r.conv_id, r.messages[0].content) for r in seeded} == {(None, "own"), (1, "other")}


@pytest.mark.parametrize("segment", [3, 4096])
def test_deltas_in_batch(spark, segment):
    rows = snapshot_rows()
    shuffled = random.Random(1).sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, SNAPSHOT)
    assert sorted(map(tuple, ST.suffix_delta(df, segment).collect())) == replay_deltas(rows)


def test_streams_equal_batches(spark, tmp_path):
    rows = snapshot_rows()
    source = tmp_path / "in"
    # Three files in time order; the last also brings a late snapshot, which is dropped.
    third = len(rows) // 3
    ordered = sorted(rows, key=lambda r: (r[3], r))
    late = (0, 0, "p0", 0, "late")
    for i, part in enumerate([ordered[:third], ordered[third:2 * third], ordered[2 * third:] + [late]]):
        spark.createDataFrame(part, SNAPSHOT).coalesce(1).write.mode("append").parquet(str(source))
    stream = ST.read_snapshots(spark, str(source), files_per_batch=1)
    ST.store_deltas(ST.suffix_delta_stream(stream), str(tmp_path / "d"), str(tmp_path / "dc")).awaitTermination()
    deltas = spark.read.schema(ST.DELTA).parquet(str(tmp_path / "d")).collect()
    whole = {}
    for r in sorted(deltas, key=lambda r: r.seq):
        whole[r.conv_id, r.turn] = whole.get((r.conv_id, r.turn), "") + r.delta
    final = {(c, t): text for c, t, _, _, text in rows}
    assert whole == final
    assert sorted(map(tuple, deltas)) == replay_deltas(rows)

    stream = ST.read_snapshots(spark, str(source), files_per_batch=1)
    ST.latest_snapshot_stream(stream, str(tmp_path / "l"), str(tmp_path / "lc")).awaitTermination()
    latest = ST.latest_snapshot(ST.read_log(spark, str(tmp_path / "l"))).collect()
    assert {(r.conv_id, r.turn): r.resp for r in latest} == final
