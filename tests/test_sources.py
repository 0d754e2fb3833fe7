"""Readers and writers on files made for the purpose."""

import random

import pytest
from pyspark.sql import functions as F

from talkloom.operators.chunk import build_corpus
from talkloom.operators.instruct import first_n, prompt_records, rejected_records
from talkloom.sources import lines as L
from talkloom.sources import records as R
from talkloom.sources.schemas import INSTRUCTION, PROMPT_RECORD


@pytest.fixture
def small_splits(spark):
    """Let even a small file be read in many splits."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, "64")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def python_lines(path):
    with open(path, encoding="utf-8") as f:
        return [line.removesuffix("\n") for line in f.readlines()]


@pytest.mark.parametrize("limit", [200_000, -1])
def test_lines_are_numbered_across_splits(spark, tmp_path, small_splits, monkeypatch, limit):
    monkeypatch.setattr(L, "MAX_BROADCAST_SPLITS", limit)
    rng = random.Random(5)
    for i in range(4):
        parts = ["".join(rng.choices("ab中 ", k=rng.randrange(0, 30))) + rng.choice(["\n", "\r\n", "\r"])
                 for _ in range(60)]
        (tmp_path / f"f{i}.txt").write_bytes("".join(parts).encode() + (b"" if i % 2 else b"tail"))
    (tmp_path / "other.TXT").write_text("ignored\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.txt").write_text("ignored\n")
    rows = L.read_text_corpus(spark, str(tmp_path)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.file, r.pos)):
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.pos, r.text))
    expected = {f"f{i}.txt": list(enumerate(python_lines(tmp_path / f"f{i}.txt"))) for i in range(4)}
    assert got == expected


@pytest.mark.parametrize("body", ["a\nb", "a\nb\n", "a\r\nb\r\n", "a\rb\r", "\n", "", "x", "a\r\r\n\nb\r"])
def test_knowledge_keeps_the_part_behind_the_last_newline(spark, tmp_path, small_splits, body):
    path = tmp_path / "kb.csv"
    path.write_bytes(body.encode())
    with open(path, encoding="utf8") as f:
        expected = list(enumerate(f.read().split("\n")))
    rows = L.read_knowledge(spark, str(path)).collect()
    assert sorted((r.pos, r.text) for r in rows) == expected


def test_instruction_array_keeps_order_and_optional_input(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '[{"instruction": "一", "output": "x"},\n {"instruction": "b", "input": "", "output": "y"},'
        ' {"instruction": null, "output": "z"}, {"instruction": "d"}]', encoding="utf-8")
    read = R.read_instructions(spark, str(tmp_path / "a.json"))
    assert [(r.pos, r.instruction, r.input, r.output) for r in read.orderBy("pos").collect()] == [
        (0, "一", None, "x"), (1, "b", "", "y"), (2, None, None, "z"), (3, "d", None, None)]
    assert [r.context for r in prompt_records(read).orderBy("pos").collect()] == [
        "Instruction: 一\nAnswer: ", "Instruction: b\nAnswer: "]
    assert sorted(r.pos for r in rejected_records(read).collect()) == [2, 3]


def test_malformed_array_fails(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"instruction": "a"')
    with pytest.raises(Exception):
        R.read_instructions(spark, str(tmp_path / "a.json")).collect()


@pytest.mark.parametrize("with_pos", [True, False])
def test_jsonl_rejects(spark, tmp_path, with_pos):
    (tmp_path / "p.jsonl").write_text('{"context": "c", "target": "t"}\nnot json\n{"context": "c"}\n')
    read = R.read_jsonl(spark, str(tmp_path / "p.jsonl"), PROMPT_RECORD, with_pos=with_pos).cache()
    good, bad = R.split_rejects(read, ["context", "target"])
    assert [(r.context, r.target) for r in good.collect()] == [("c", "t")]
    assert bad.count() == 2
    if with_pos:
        assert sorted(r.pos for r in bad.collect()) == [1, 2]


def test_jsonl_keeps_nulls_and_characters(spark, tmp_path):
    df = spark.createDataFrame([("中\n", None, "é")], INSTRUCTION)
    R.write_jsonl(df, str(tmp_path / "out"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*"))
    assert text == '{"instruction":"中\\n","input":null,"output":"é"}\n'


def test_mixed_corpus(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes("|".join(["x", "", "p" * 150, "q", "rr", "s" * 151, "tt"]).encode())
    (tmp_path / "b.pdf").write_bytes(b"one||three")
    (tmp_path / "c.txt").write_text("l1\n\nl3\n")
    split = lambda content: content.decode().split("|")
    units = L.read_binary_corpus(spark, str(tmp_path), {"docx": split, "pdf": split})
    corpus = build_corpus(units, L.read_text_corpus(spark, str(tmp_path)))
    got = sorted((r.kind, r.chunk_pos, r.text) for r in corpus.collect())
    assert got == [
        ("docx", 0, "p" * 150 + "rr"),
        ("docx", 1, "s" * 151),
        ("pdf", 0, "one"), ("pdf", 1, ""), ("pdf", 2, "three"),
        ("txt", 0, "l1"), ("txt", 1, ""), ("txt", 2, "l3"),
    ]


def test_first_n(spark):
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("pos"))
    assert sorted(r.pos for r in first_n(df, ["pos"], 5).collect()) == [0, 1, 2, 3, 4]
    assert sorted(r.pos for r in first_n(df, ["pos"], 500).collect()) == list(range(500))
    assert first_n(df, ["pos"], 0).count() == 0 and first_n(df, ["pos"], 5000).count() == 1000


def test_first_n_both_ways(spark, monkeypatch):
    """Few and many keys, two order columns, a null among them, and rows that carry more."""
    rows = [(None if i % 7 == 0 else i % 7, i, "x" * i) for i in range(60)]
    df = spark.createDataFrame(rows, "a int, b int, text string").repartition(5)
    expected = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))[:17]
    few = first_n(df, ["a", "b"], 17)
    assert "TakeOrderedAndProject" in few._jdf.queryExecution().toString()
    monkeypatch.setattr("talkloom.operators.instruct.FEW_KEYS", 16)
    for found in (few, first_n(df, ["a", "b"], 17)):
        assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
