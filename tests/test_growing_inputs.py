"""Work per task stays bounded as tables grow: snapshot files, neighbours across segments, page texts."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from suite import dialogue as D
from talkloom.operators import web as W
from talkloom.plans import segments


@pytest.fixture
def talk(spark, tmp_path):
    """Forty conversations with replies of one to forty words, one of them null, one id null."""
    rows = []
    for conv in range(40):
        key = None if conv == 7 else conv
        rows += [(key, 0, "user", f"question {conv}"), (key, 1, "assistant", " ".join(f"w{conv}x{i}" for i in range(conv + 1)))]
    rows += [(50, 0, "user", "no reply"), (50, 1, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def test_snapshot_files_grow_in_number(spark, talk, monkeypatch):
    monkeypatch.setattr(D, "FILE_ROWS", 50)
    path, files = D._stored_snapshots(spark, talk)
    stored = spark.read.parquet(path).withColumn("file", F.input_file_name())
    assert files == -(-stored.count() // 50) == 17
    assert stored.groupBy("conv_id", "turn").agg(F.countDistinct("file").alias("n")).where("n > 1").count() == 0
    assert stored.groupBy("file").count().agg(F.max("count")).first()[0] < stored.count() / 4


@pytest.mark.parametrize(
    ("name", "plain", "batch"),
    [
        ("st1_latest_snapshot_stream", "st1_latest_snapshot", 4),
        ("st1_latest_snapshot_compacted", "st1_latest_snapshot", 3),
        ("st2_suffix_delta_stream", "st2_suffix_delta", 9),
        ("st2_suffix_delta_event_time", "st2_suffix_delta", 5),
    ],
)
def test_streams_of_more_files(spark, talk, monkeypatch, name, plain, batch):
    monkeypatch.setattr(D, "FILE_ROWS", 50)
    written, read = [], D.ST.read_snapshots
    monkeypatch.setattr(D.ST, "read_snapshots", lambda s, p, files_per_batch, **k: written.append(files_per_batch) or read(s, p, files_per_batch, **k))
    assert rows_of(getattr(D, name)(spark, talk).where("conv_id is not null")) == rows_of(getattr(D, plain)(spark, talk).where("conv_id is not null"))
    assert written == [batch]


@pytest.mark.parametrize("ahead", [True, False])
def test_whole_rows_are_shuffled_once(spark, ahead):
    rows = [(k, i, f"t{k}-{i}" if i % 4 else None) for k in (None, 1, 2) for i in range(0, 40, 3 if k else 1)]
    df = spark.createDataFrame(rows, "k long, i long, text string").repartition(3)
    neighbour = segments.next_row if ahead else segments.previous_row
    found, plain = (neighbour(df, ["k"], "i", ["i", "text"], "other", n) for n in (5, 4096))
    assert rows_of(found) == rows_of(plain)
    assert found.schema["other"].dataType.simpleString() == plain.schema["other"].dataType.simpleString()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # The rows were joined with the edges of their segments, by other keys than the window's.
    assert "LeftOuter" not in plan


def test_pages_become_strings_a_few_at_a_time(monkeypatch):
    """A whole batch of pages was held as Python strings beside the batch itself."""
    alive, most = [], []

    class Texts:
        def __init__(self, array):
            self.array = array

        def __len__(self):
            return len(self.array)

        def slice(self, *at):
            return Texts(self.array.slice(*at))

        def to_pylist(self):
            most.append(len(self.array))
            return self.array.to_pylist()

    pages = Texts(pa.array([f"page {i}" for i in range(1000)]))
    found = W._page_by_page((pages,), lambda page: alive.append(page) or [page, None], pa.list_(pa.string()))
    assert found.to_pylist() == [[f"page {i}", None] for i in range(1000)]
    assert max(most) == W.PAGES and alive == [f"page {i}" for i in range(1000)]
    empty = W._page_by_page((pa.array([], pa.string()),), len, pa.list_(pa.string()))
    assert len(empty) == 0
