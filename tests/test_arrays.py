"""JSON arrays read in splits against the whole reading and Python's own parser."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.sources import arrays as A
from talkloom.sources import records as R
from talkloom.sources.schemas import INSTRUCTION

NESTED = T.StructType(
    [
        T.StructField("instruction", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("more", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    ]
)


@pytest.fixture
def splits(spark):
    """Let even a small file be read in splits of the given number of bytes, some to a task."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {name: spark.conf.get(name) for name in names}
    most = "spark.sql.files.maxPartitionNum"

    def use(size, tasks=6):
        for name in names:
            spark.conf.set(name, str(size))
        spark.conf.set(most, str(tasks))

    yield use
    for name, value in before.items():
        spark.conf.set(name, value)
    spark.conf.unset(most)


def odd_text(rng):
    """Braces, brackets, quotes and backslashes, most of all."""
    return "".join(rng.choices(['{', '}', '[', ']', '"', '\\', '\\"', "},{", "null", ",", ":", "中", "é", "\n", " ", "a", "😀", '\\\\"}'], k=rng.randrange(0, 25)))


def made_elements(seed, count):
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        if rng.random() < 0.15:
            rows.append(None)
            continue
        row = {"instruction": odd_text(rng), "output": odd_text(rng)}
        if rng.random() < 0.5:
            row["more"] = {odd_text(rng): [odd_text(rng) for _ in range(rng.randrange(3))] for _ in range(rng.randrange(3))}
        rows.append(row)
    return rows


def write(path, rows, rng):
    """An array with white space wherever it may stand."""
    space = lambda: rng.choice(["", " ", "\n", "\t\n "])
    body = ("," + space()).join(space() + json.dumps(r, ensure_ascii=rng.random() < 0.5) + space() for r in rows)
    path.write_text(f"{space()}[{body}{space()}]{space()}", encoding="utf-8")


def as_python(rows):
    return sorted(((r.file.rsplit("/", 1)[1], r.pos, r.instruction, r.output, r.more) for r in rows), key=lambda r: r[:2])


@pytest.mark.parametrize(("size", "few"), [(16, True), (64, False), (700, True)])
def test_splits_equal_python(spark, tmp_path, splits, monkeypatch, size, few):
    if not few:
        monkeypatch.setattr(A, "MAX_BROADCAST_SPLITS", 0)
    rng = random.Random(size)
    expected = []
    for k in range(3):
        rows = made_elements(k, 40)
        write(tmp_path / f"f{k}.json", rows, rng)
        for pos, row in enumerate(rows):
            row = row or {}
            expected.append((f"f{k}.json", pos, row.get("instruction"), row.get("output"), row.get("more")))
    splits(size)
    read = A.read_array_splits(spark, str(tmp_path), NESTED)
    assert as_python(read.collect()) == sorted(expected, key=lambda r: r[:2])


def test_one_file_is_read_by_many_tasks_and_equals_the_whole_reading(spark, tmp_path, splits):
    rng = random.Random(3)
    rows = made_elements(9, 150)
    write(tmp_path / "a.json", rows, rng)
    whole = as_python(R.read_instructions(spark, str(tmp_path / "a.json"), NESTED).collect())
    splits(700, tasks=40)
    read = A.read_array_splits(spark, str(tmp_path / "a.json"), NESTED)
    assert as_python(read.collect()) == whole and len(whole) == 150
    pieces = spark.read.option("lineSep", "}").text(str(tmp_path / "a.json"))
    blocks = pieces.select(F.col("_metadata.file_block_start").alias("b")).distinct().count()
    assert blocks > 15 and pieces.rdd.getNumPartitions() > 15


def test_an_object_over_many_splits(spark, tmp_path, splits):
    text = '}"{\\' * 500
    (tmp_path / "a.json").write_text(json.dumps([{"instruction": text, "output": "x"}, {"instruction": "b", "output": text}]))
    splits(100)
    rows = A.read_array_splits(spark, str(tmp_path / "a.json"), INSTRUCTION).orderBy("pos").collect()
    assert [(r.pos, r.instruction, r.output) for r in rows] == [(0, text, "x"), (1, "b", text)]


@pytest.mark.parametrize("body", ["[]", " [ \n ] ", "[null]", "[null, null ]", "", "  \n"])
def test_arrays_without_objects(spark, tmp_path, splits, body):
    (tmp_path / "a.json").write_text(body)
    splits(16)
    rows = A.read_array_splits(spark, str(tmp_path / "a.json"), INSTRUCTION).orderBy("pos").collect()
    assert [(r.pos, r.instruction) for r in rows] == [(k, None) for k in range(body.count("null"))]


@pytest.mark.parametrize(
    "body",
    ['[{"instruction": "a"', '[{"instruction": "a"}', '[{"instruction": "a}]', '[{"instruction": "a"} {"output": "b"}]', '[1, {"output": "b"}]',
     '[{"output": "b"},]', '[{"output": "b"}], [', '{"output": "b"', '[{"output": }]', '[[{"output": "b"}]]', '["a"]'],
)
def test_malformed_files_fail(spark, tmp_path, splits, body):
    (tmp_path / "a.json").write_text(body)
    splits(16)
    with pytest.raises(Exception):
        A.read_array_splits(spark, str(tmp_path / "a.json"), INSTRUCTION).collect()


def test_large_files_are_read_in_splits(spark, tmp_path, monkeypatch):
    (tmp_path / "a.json").write_text('[{"instruction": "a", "output": "b"}]')
    seen = []
    plain = R.read_array_splits
    monkeypatch.setattr(R, "read_array_splits", lambda *a: seen.append(1) or plain(*a))
    for size, calls in ((10_000, 0), (10, 1)):
        rows = R.read_instructions(spark, str(tmp_path), whole_bytes=size).collect()
        assert [(r.pos, r.instruction, r.output) for r in rows] == [(0, "a", "b")] and len(seen) == calls
