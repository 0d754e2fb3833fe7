"""Every registered query against its SQL, over whole tables, and with another partitioning."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as spark_entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = spark_entry.queries(), spark_entry.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for file in sorted(Path(SF_DIR).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = [
        tuple(None if isinstance(v, float) and math.isnan(v) else v for v in row)
        for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)
    ]
    return sorted(clean, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    expected = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_repeats_itself(spark, name):
    """Beside its own tests: named columns, rows, and the same rows again, whatever the partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for parts in ["1", "8"]:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(QUERIES[name](spark, SF_DIR).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", before)
    first, again = results
    assert list(first.columns) == list(again.columns) and len(set(first.columns)) == len(first.columns)
    assert len(first) and rows(first) == rows(again)


@pytest.mark.parametrize("name", ["t6_batches", "r4_rank", "h2_history", "w8_answer_list", "e3_answer_questions"])
def test_partitions_do_not_matter(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for parts in ["1", "8"]:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(rows(QUERIES[name](spark, SF_DIR).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] and results[0]


def test_flagship_runs(spark):
    assert spark_entry.entry(spark).columns == ["query_id", "tool", "prompt", "answer"]
