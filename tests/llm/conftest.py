import pytest

from talkloom.sources.scratch import scratch_root


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs or longer tuples, over several partitions."""

    def make(rows, lang="en", source="s"):
        full = [(*row, *(lang, source)[len(row) - 2 :]) for row in rows]
        frame = spark.createDataFrame(full, "doc_id long, text string, lang string, source string")
        return frame.repartition(3)

    return make


@pytest.fixture(scope="session")
def folder(spark):
    return lambda name: f"{scratch_root(spark)}/test-{name}"
