"""Commits that die, repeat or collide, old versions, and embeddings made once per text."""

import pytest
from pyspark.sql import functions as F

from talkloom.operators import stores
from talkloom.operators.stores import EmbeddingStore, FlatIndex
from talkloom.sources.snapshots import Conflict, Snapshots


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    return Snapshots(spark, f"file://{tmp_path}/t", "pos long, text string", position="pos")


def made(spark, first, last):
    return spark.range(first, last).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("text"), F.lit(1).alias("extra"))


def test_versions_and_ranges(spark, table):
    assert table.version() == 0 and rows(table.read()) == []
    assert [table.append(made(spark, 0, 5), "a"), table.append(made(spark, 5, 9), "b")] == [1, 2]
    assert [r[0] for r in rows(table.read())] == list(range(9))
    assert [r[0] for r in rows(table.read(1))] == list(range(5)) and rows(table.read(0)) == []
    assert [r[0] for r in rows(table.read(between=(4, 6)))] == [4, 5, 6]
    only = table.read(between=(6, 8))
    assert len({f.rsplit("/", 2)[1] for f in only.inputFiles()}) == 1
    with pytest.raises(ValueError):
        table.append(made(spark, 8, 12), "c")
    with pytest.raises(ValueError):
        table.read(7)


def test_a_repeated_commit_adds_nothing(spark, table):
    assert table.append(made(spark, 0, 3), "a") == table.append(made(spark, 0, 3), "a") == 1
    assert table.append(made(spark, 3, 4), "b") == 2 and table.append(made(spark, 0, 3), "a") == 2
    assert len(rows(table.read())) == 4


def test_a_dying_commit_is_not_seen(spark, table, monkeypatch):
    table.append(made(spark, 0, 3), "a")
    with monkeypatch.context() as broken:
        broken.setattr(Snapshots, "_put_manifest", lambda self, manifest: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.append(made(spark, 3, 6), "b")
    assert len(rows(table.read())) == 3 and table.version() == 1 and len(table.unnamed()) == 1
    assert table.append(made(spark, 3, 6), "b") == 2
    assert [r[0] for r in rows(table.read())] == list(range(6)) and len(table.unnamed()) == 1


def test_commits_at_the_same_time_both_count(spark, table, monkeypatch):
    plain, seen = Snapshots._put_manifest, []

    def late(self, manifest):
        if not seen:
            seen.append(1)
            table.append(made(spark, 10, 12), "other")
        return plain(self, manifest)

    monkeypatch.setattr(Snapshots, "_put_manifest", late)
    assert table.append(made(spark, 0, 3), "mine") == 2
    assert [r[0] for r in rows(table.read())] == [0, 1, 2, 10, 11]
    assert [r[0] for r in rows(table.read(1))] == [10, 11]
    with pytest.raises(Conflict):
        table.append(made(spark, 20, 21), "x", expect=1)


def test_compaction_keeps_rows_tokens_and_old_versions(spark, table):
    for k in range(3):
        table.append(made(spark, k, k + 1), f"t{k}")
    assert table.compact() == 4
    assert len(table.manifest()["parts"]) == 1 and [r[0] for r in rows(table.read())] == [0, 1, 2]
    assert [r[0] for r in rows(table.read(2))] == [0, 1]
    assert table.append(made(spark, 1, 2), "t1") == 4 and table.append(made(spark, 3, 4), "t3") == 5
    assert [r[0] for r in rows(table.read())] == [0, 1, 2, 3] and table.compact(version=1) == 1


def test_empty_commits_and_null_positions(spark, table):
    assert table.append(made(spark, 0, 0), "none") == 1 and rows(table.read()) == []
    with pytest.raises(ValueError):
        table.append(made(spark, 0, 2).withColumn("pos", F.lit(None).cast("long")), "null")


def test_index_versions(spark, tmp_path):
    index = FlatIndex(spark, f"file://{tmp_path}/index")
    passages = spark.createDataFrame([(0, "a", [1.0]), (1, None, [2.0]), (2, "c", None)], "pos long, text string, embedding array<float>")
    index.append(passages.where("pos < 2"), "one")
    index.append(passages.where("pos = 2"), "two")
    assert rows(index.passages(1)) == [(0, "a", [1.0]), (1, None, [2.0])] and len(rows(index.passages())) == 3


def logging_encoder(path):
    def factory():
        def encode(texts):
            with open(path, "a") as log:
                log.writelines(f"{t}\n" for t in texts)
            return [[float(len(t))] for t in texts]

        return encode

    return factory


def test_each_text_is_encoded_once(spark, tmp_path):
    log = tmp_path / "log"
    encoder = logging_encoder(str(log))
    store = EmbeddingStore(spark, f"file://{tmp_path}/store", "m1")
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(["a", "bb", "a", None, "", "ccc", "a"])], "id long, text string").repartition(3)
    texts = texts.withColumn("content", F.lit("clash")).withColumn("_text", F.lit(1))
    first = {r.id: r.embedding for r in store.embed(texts, encoder).collect()}
    assert first == {0: [1.0], 1: [2.0], 2: [1.0], 3: None, 4: [0.0], 5: [3.0], 6: [1.0]}
    assert sorted(log.read_text().split("\n")[:-1]) == ["", "a", "bb", "ccc"]
    log.write_text("")
    changed = texts.withColumn("text", F.when(F.col("id") == 1, "dddd").otherwise(F.col("text")))
    again = {r.id: r.embedding for r in store.embed(changed, encoder).collect()}
    assert again == first | {1: [4.0]} and log.read_text() == "dddd\n"
    log.write_text("")
    assert store.embed(texts, encoder).count() == 7 and log.read_text() == ""
    other = EmbeddingStore(spark, f"file://{tmp_path}/store", "m2")
    other.fill(texts.where("id = 0"), encoder)
    assert log.read_text() == "a\n"


def test_fills_at_the_same_time_store_a_text_once(spark, tmp_path, monkeypatch):
    log = tmp_path / "log"
    encoder = logging_encoder(str(log))
    store = EmbeddingStore(spark, f"file://{tmp_path}/store", "m")
    texts = spark.createDataFrame([("a",), ("b",)], "text string")
    plain, seen = stores.embedding, []

    def during(*args):
        if not seen:
            seen.append(1)
            store.fill(texts.where("text = 'a'"), encoder)
        return plain(*args)

    monkeypatch.setattr(stores, "embedding", during)
    assert store.fill(texts, encoder) == 2
    assert store.snapshots.read().count() == 2 and sorted(log.read_text().split()) == ["a", "a", "b"]
