"""Token sequences, clipping, batches and padding."""

import random

import pytest
from pyspark.sql import functions as F

from talkloom.functions.plugins import apply_steps, generate
from talkloom.operators.tokens import assign_batches, collate, flatten_features, skip_overlength, tokenize_corpus
from talkloom.plans.numbering import number_rows
from talkloom.plans.training import batch_inference, training_examples


def replay(context, target, max_len, special, eos, skip):
    p = (special + [ord(c) for c in context][: max_len - len(special)])[:max_len]
    ids = p + [ord(c) for c in target][:max_len] + [eos]
    if skip and len(ids) > max_len:
        return None
    return ids[:max_len], len(ids) > max_len, len(p) >= max_len and target != ""


@pytest.mark.parametrize("skip", [False, True])
@pytest.mark.parametrize("plugged", [False, True])
def test_tokenize_corpus_equals_replay(spark, skip, plugged):
    def reader():
        return lambda texts: [[ord(c) for c in t] for t in texts]

    tokenizer = reader if plugged else None
    rng = random.Random(3)
    rows = [(i, "c" * rng.randrange(0, 14), "t" * rng.randrange(0, 14)) for i in range(120)]
    df = spark.createDataFrame(rows, "pos int, context string, target string")
    out = tokenize_corpus(df, 12, tokenizer, (7, 8), 2, skip)
    got = {r.pos: (r.input_ids, r.eos_lost, r.target_lost) for r in out.collect()}
    expected = {p: replay(c, t, 12, [7, 8], 2, skip) for p, c, t in rows}
    assert got == {p: v for p, v in expected.items() if v is not None}


def test_length_limit_is_inclusive(spark):
    df = spark.createDataFrame([(i, [1] * (9 + i)) for i in range(3)], "pos int, input_ids array<int>")
    assert [r.pos for r in skip_overlength(df, 10, True).orderBy("pos").collect()] == [0, 1]
    assert skip_overlength(df, 10, False) is df
    with pytest.raises(TypeError):
        skip_overlength(df, 10, "False")


@pytest.mark.parametrize("parts", [1, 8])
def test_numbering_does_not_depend_on_partitions(spark, parts):
    # One key holds most rows, another order column tells them apart.
    rows = [(7 if i % 3 else i % 11, i * 37 % 1009) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(parts)
    got = {(r.a, r.b): r.number for r in number_rows(df, ["a", F.desc("b")]).collect()}
    ordered = sorted(rows, key=lambda r: (r[0], -r[1]))
    assert got == {r: i for i, r in enumerate(ordered)}


@pytest.mark.parametrize("side", ["right", "left"])
def test_batches_are_padded_to_their_longest(spark, side):
    rows = [(i, [5] * (i % 4 + 1)) for i in range(10)]
    df = spark.createDataFrame(rows, "pos int, input_ids array<int>")
    out = collate(assign_batches(df, 4, ["pos"]), 5 if side == "left" else 0, side).collect()
    assert {r.pos: r.batch_id for r in out} == {i: i // 4 for i in range(10)}
    for r in out:
        width = max(i % 4 + 1 for i in range(10) if i // 4 == r.batch_id)
        n, pad = r.pos % 4 + 1, 5 if side == "left" else 0
        gap = width - n
        put = (lambda body, fill: body + fill * gap) if side == "right" else (lambda body, fill: fill * gap + body)
        assert r.input_ids == put([5] * n, [pad])
        assert r.attention_mask == put([1] * n, [0])
        assert r.labels == [-100 if x == pad else x for x in r.input_ids]
    with pytest.raises(ValueError):
        collate(df, side="middle")


def test_nested_layout_is_flattened(spark):
    df = spark.createDataFrame([(1, ([1, 2],))], "pos int, features struct<input_ids:array<int>>")
    flat = flatten_features(df)
    assert flat.columns == ["pos", "input_ids"]
    assert flatten_features(flat) is flat


def test_inference_of_the_first_records(spark):
    rows = [(i, f"q{i}", None, "label") for i in range(20)]
    df = spark.createDataFrame(rows, "pos int, instruction string, input string, output string")

    def echo():
        return lambda prompts: [p + "\n noise \n " + p.split("\n")[0] + " " for p in prompts]

    got = batch_inference(df, echo, 3, ["pos"]).orderBy("pos").collect()
    assert [(r.pos, r.answer, r.target) for r in got] == [
        (i, f"Instruction: q{i}", "label") for i in range(3)]
    assert batch_inference(df, echo).count() == 20


def test_each_plugin_is_its_own(spark):
    def make(word):
        return lambda: lambda prompts: [word + p for p in prompts]

    df = spark.createDataFrame([("x",)], "prompt string")
    for word in ["a", "b"]:
        assert generate(df, make(word)).first().reply == word + "x"


def test_user_steps_run_in_order_before_prompts(spark):
    records = spark.createDataFrame(
        [(i, f"do {i}", None, "x" * i) for i in range(6)], "id int, instruction string, input string, output string"
    )

    def long_ones(df):
        return df.filter(F.length("output") > 2)

    def doubled(df):
        return df.withColumn("output", F.concat("output", "output"))

    def sizes(steps):
        return {r.id: len(r.input_ids) - len(f"Instruction: do {r.id}\nAnswer: ") - 1
                for r in training_examples(records, steps=steps).collect()}

    assert sizes([long_ones, doubled]) == {3: 6, 4: 8, 5: 10}
    assert sizes([doubled, long_ones]) == {2: 4, 3: 6, 4: 8, 5: 10}
    assert apply_steps(records, []) is records
    answers = batch_inference(records, lambda: lambda texts: [t[:4] for t in texts], 2, ["id"], steps=[long_ones])
    assert sorted(r.id for r in answers.collect()) == [3, 4]
    with pytest.raises(TypeError, match="nothing gave NoneType"):
        def nothing(df):
            return None

        apply_steps(records, [nothing])
