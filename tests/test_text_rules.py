"""Boundary rows of the scalar rules."""

import random
import re

from pyspark.sql import functions as F

from talkloom.functions import prompts as P
from talkloom.functions import strings as S
from talkloom.functions.plugins import code_points


def column(spark, values, build, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v")).alias("out")).collect()]


def random_texts(seed, n=200):
    rng = random.Random(seed)
    alphabet = ["a", "é", "中", "😀", "<", ">", "b", " ", "\t", "\n", "\r", "\x0b", "\x1c", "\x1f",
                "\x85", " ", " ", " ", "　"]
    return ["".join(rng.choices(alphabet, k=rng.randrange(0, 25))) for _ in range(n)]


def test_last_line_strips_like_python(spark):
    texts = random_texts(1) + ["", "x\n", "　x \ny 　", "a\n　b　c "]
    expected = [t.split("\n")[-1].strip() for t in texts]
    assert column(spark, texts, S.last_line) == expected


def test_strip_markup_removes_tags_and_all_space(spark):
    texts = random_texts(2) + ["<p a='1'>x y</p>　z", "a < b > c", "<>x<"]
    expected = [re.sub(r"(<[^>]+>|\s)", "", t) for t in texts]
    assert column(spark, texts, S.strip_markup) == expected


def test_split_lines_folds_the_three_terminators(spark):
    texts = ["a\nb", "a\r\nb\rc\n", "\r\r\n", "", "a\n\n"]
    expected = [t.replace("\r\n", "\n").replace("\r", "\n").split("\n") for t in texts]
    assert column(spark, texts, S.split_lines) == expected


def test_length_rules_count_code_points(spark):
    texts = ["😀" * 512, "😀" * 513, "a" * 300, "é" * 301]
    assert column(spark, texts, S.route_by_length) == ["cosine", "l2", "cosine", "cosine"]
    assert column(spark, texts, S.truncate) == [t[:300] for t in texts]


def test_code_points_beyond_the_basic_plane(spark):
    texts = random_texts(3) + ["", "😀a中"]
    assert column(spark, texts, code_points) == [[ord(c) for c in t] for t in texts]


def test_input_line_only_for_non_empty_input(spark):
    context = lambda v: P.format_example(F.lit("do"), v, F.lit("out"))[0]
    plain = "Instruction: do\nAnswer: "
    got = column(spark, [None, "", "  ", "x"], context)
    assert got == [plain, plain, "Instruction: do\nInput:   \nAnswer: ",
                   "Instruction: do\nInput: x\nAnswer: "]


def test_template_marks_inside_values_stay_text(spark):
    got = column(spark, ["{docs} {query}"], lambda v: P.intent_prompt(F.lit("D"), v))
    assert got == [P.INTENT_TEMPLATE.replace("{docs}", "D").replace("{query}", "{docs} {query}")]


def test_qa_prompt_has_the_refusal_for_search_only(spark):
    tools = [P.SEARCH_TOOL, P.CLASSIFICATION_TOOL, P.DEFAULT_TOOL, "other"]
    got = column(spark, tools, lambda v: P.qa_prompt(v, F.lit("T"), F.lit("Q")))
    expected = [t.format(text="T", query="Q") for t in P.QA_TEMPLATES.values()]
    assert got == expected + [None]
    assert "抱歉" in got[0] and "抱歉" not in got[1]


def test_persona_info_is_joined_by_lines(spark):
    got = column(spark, [["一", "二"]], lambda v: P.persona_prompt(F.lit("U"), F.lit("E"), v),
                 "array<string>")
    assert got == [P.PERSONA_TEMPLATE.format(user="U", emotion="E", info="一\n二")]


def test_numbered_sources_and_json_results(spark):
    assert column(spark, [["a", "b"], []], S.number_sources, "array<string>") == [
        ["来源1:a", "来源2:b"], []]
    build = lambda v: S.json_result(S.allowed_value(v, ["爱", "聊天", "作诗"]))
    assert column(spark, ["爱", "恨", None], build) == [
        '{"emotion":"爱","user":"旅行者"}', "null", "null"]
