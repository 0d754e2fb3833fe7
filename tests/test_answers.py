"""From questions to answers: each question's row meets its knowledge where that is put together."""

import json

import pytest

from talkloom.functions import prompts as P
from talkloom.operators import retrieve
from talkloom.plans import gathering, numbering, scoring
from talkloom.plans.answers import answer_questions
from talkloom.sources import scratch

PASSAGES = [(1, "nearby", [1.0, 0.0]), (2, "second", [0.9, 0.2]), (3, "other", [0.0, 1.0]), (4, None, [0.8, 0.1])]
LONG = "l" * 600
# Question 5 stands there twice; 6 matches nothing; 7 has no vector; the last one has no id.
QUESTIONS = [
    (4, LONG, [1.0, 0.1]), (5, "a", [1.0, 0.1]), (5, "b", [0.0, 2.0]), (6, "c", [-1.0, -1.0]), (7, "d", None), (None, "e", None),
]


@pytest.fixture
def answered(spark):
    def searching():
        return lambda prompts: [P.SEARCH_TOOL if "nearbysecond" in p else "none" for p in prompts]

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    passages = spark.createDataFrame(PASSAGES, "pos long, text string, embedding array<double>")
    response = json.dumps({"items": [{"title": "t", "snippet": "s"}]})
    yield lambda: answer_questions(
        spark.createDataFrame(QUESTIONS, "query_id long, query string, embedding array<double>"),
        intents=passages,
        corpus=passages,
        searches=spark.createDataFrame([(4, response)], "query_id long, response string"),
        knowledge=passages,
        fallback=spark.createDataFrame([(6, "spare"), (6, "spare"), (5, "unused")], "query_id long, text string"),
        intent_model=searching,
        answer_model=lambda: lambda prompts: [str(len(p)) for p in prompts],
        chat_threshold=0.5,
        radius=0.3,
    )
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("block, pack", [(gathering.BLOCK_BYTES, gathering.PACK_BYTES), (1, 1)])
def test_rows_of_repeated_and_unmatched_questions(answered, monkeypatch, block, pack):
    monkeypatch.setattr(gathering, "BLOCK_BYTES", block)
    monkeypatch.setattr(gathering, "PACK_BYTES", pack)

    def chat(known, query):
        return P.QA_TEMPLATE.replace("{text}", P.CHAT_CONTEXT + known).replace("{query}", query)

    expected = [(4, P.SEARCH_TOOL, P.SEARCH_QA_TEMPLATE.replace("{text}", "t。s").replace("{query}", LONG))]
    # Question 5 has each row with each result of its id, of the intents and then of the chats; the null text has a number.
    known = "\n".join(f"背景知识{n}:{t}" for n, t in [(1, "other"), (2, "other"), (5, "nearby"), (6, "nearby"), (7, "second"), (8, "second")])
    expected += [(5, P.DEFAULT_TOOL, chat(known, q)) for q in "ab" for _ in range(8)]
    expected += [(6, P.DEFAULT_TOOL, chat("spare", "c"))] * 2 + [(7, P.DEFAULT_TOOL, chat("", "d"))]
    rows = answered().collect()
    assert sorted(tuple(r[:3]) for r in rows) == sorted(expected)
    assert all(r.answer == str(len(r.prompt)) for r in rows)


def test_no_knowledge_is_shuffled(answered):
    """Nothing above the step that puts texts together moves its rows."""
    plan = answered()._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    gathers = [i for i, line in enumerate(plan) if "knowledge#" in line and "MapInArrow" in line]
    assert gathers
    for i in gathers:
        at = depth[i]
        for j in range(i - 1, -1, -1):
            if depth[j] < at:
                at = depth[j]
                assert "Exchange" not in plan[j] and "Join" not in plan[j]


@pytest.mark.parametrize("find", [
    lambda q, p: retrieve.threshold_matches(q, p, threshold=0.5),
    lambda q, p: retrieve.l2_range_context(q, p, radius=9.0),
])
def test_no_match_is_stored(spark, monkeypatch, find):
    """Every question matches every passage, but no stored table is larger than both together."""
    queries = spark.createDataFrame([(i, [1.0, i / 30]) for i in range(30)], "query_id long, embedding array<double>")
    passages = spark.createDataFrame([(i, f"t{i};", [1.0, i / 30]) for i in range(30)], "pos long, text string, embedding array<double>")
    rows = []

    def counted(df, tag, to=scratch.written):
        stored = to(df, tag)
        rows.append(stored.count())
        return stored

    for module in (retrieve, gathering, numbering, scoring):
        monkeypatch.setattr(module, "written", counted)
    known = find(queries, passages).collect()
    assert len(known) == 30 and all(r.knowledge.count(";") == 30 for r in known)
    assert max(rows) <= 60


def test_vector_of_a_position_without_one(spark):
    """A position's texts are taken by any of its vectors; a position that is null is found by none."""
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    rows = [(1, "b", [1.0, 0.1]), (1, "a", None), (None, "c", [1.0, 0.0]), (2, "d", None), (3, "e", [0.0, 1.0])]
    passages = spark.createDataFrame(rows, "pos long, text string, embedding array<double>")
    assert [r.knowledge for r in retrieve.l2_range_context(queries, passages, radius=0.5).collect()] == ["ab"]
