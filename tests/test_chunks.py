"""Packing paragraphs: the array form, the row form and an independent replay."""

import random

import pytest
from pyspark.sql import functions as F

from talkloom.operators.chunk import line_passages, pack_paragraph_rows, pack_paragraphs


def replay(paragraphs, keep_tail, flush=150):
    out, held = [], ""
    for p in paragraphs:
        if len(p) <= 1:
            continue
        if len(held) > flush:
            out.append(held)
            held = ""
        held += p
    return out + ([held] if keep_tail and held else [])


def documents(seed, longest, separator=""):
    rng = random.Random(seed)
    sizes = [0, 1, 2, 75, 76, 149, 150, 151, 152, 400]
    docs = {}
    for d in range(40):
        n = rng.randrange(0, longest)
        docs[d] = [
            "".join(rng.choices("ab中😀" + separator, k=rng.choice(sizes + [rng.randrange(0, 60)] * 10)))
            for _ in range(n)
        ]
    docs[98] = ["x" * 150, "yy", "z" * 151]
    docs[99] = ["x" * 151, "yy", "z", "w" * 200]
    return docs


def collected(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.doc_id, r.chunk_pos)):
        assert r.chunk_pos == len(got.setdefault(r.doc_id, []))
        got[r.doc_id].append(r.text)
    return got


@pytest.mark.parametrize("keep_tail", [False, True])
@pytest.mark.parametrize("separator", ["", "\n"])
def test_array_form(spark, keep_tail, separator):
    docs = documents(1, 60, separator)
    df = spark.createDataFrame(list(docs.items()), "doc_id int, paragraphs array<string>")
    got = collected(pack_paragraphs(df, "doc_id", F.col("paragraphs"), keep_tail))
    assert got == {d: r for d, p in docs.items() if (r := replay(p, keep_tail))}


@pytest.mark.parametrize("keep_tail", [False, True])
@pytest.mark.parametrize("segment", [1, 7, 64, 1024])
def test_row_form(spark, keep_tail, segment):
    docs = documents(2, 200)
    rows = [(d, i, p) for d, ps in docs.items() for i, p in enumerate(ps)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id int, pos long, text string")
    got = collected(pack_paragraph_rows(df, "doc_id", keep_tail=keep_tail, segment=segment, run=5))
    assert got == {d: r for d, p in docs.items() if (r := replay(p, keep_tail))}


def test_array_form_is_linear_on_long_paragraphs(spark):
    body = "word " * 400_000
    df = spark.createDataFrame([(1, [body, "short", body])], "doc_id int, paragraphs array<string>")
    assert collected(pack_paragraphs(df, "doc_id", F.col("paragraphs"))) == {1: [body, "short" + body][:1]}


def test_lines_of_texts(spark):
    texts = ["a\nb", "a\nb\n", "a\r\n\r\nb\r", "", "\n", "x\r\r\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = collected(line_passages(df, "doc_id", "text"))
    expected = {}
    for i, t in enumerate(texts):
        folded = t.replace("\r\n", "\n").replace("\r", "\n")
        parts = folded.split("\n")
        if parts[-1] == "":
            parts.pop()
        if parts:
            expected[i] = parts
    assert got == expected


def test_null_keys_are_packed_alike_in_segments(spark):
    rows = [(key, k, "x" * 90) for key in (None, 1) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id int, pos int, text string")
    tiny, whole = (pack_paragraph_rows(df, "doc_id", keep_tail=True, segment=n, run=2).collect() for n in (2, 1024))
    assert sorted(map(str, tiny)) == sorted(map(str, whole))
    assert [len(r.text) for r in tiny if r.doc_id is None] == [180] * 6
