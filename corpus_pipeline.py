"""A corpus pipeline of five stages: filter, deduplicate, decontaminate, mix, write token ids.

Each stage takes what its predecessor kept and returns the rows that go on; the last
one returns a row per written document. Between stages rows are stored as Parquet.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from talkloom.llm import decontaminate, mixing, neardup, toxicity
from talkloom.llm.queries import table, token_rows, tokenizer_path
from talkloom.session import ship
from talkloom.sources.scratch import scratch_path, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shipped(spark: SparkSession) -> None:
    ship(spark, Path(__file__).resolve().parent, ["talkloom"])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _shipped(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _shipped(spark)
    return neardup.without_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _shipped(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _shipped(spark)
    return token_rows(docs, scratch_path(spark, "pipeline-tokens"), tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_ids", write_ids),
]

#: Language models and a tokenizer are not SQL: a test holds the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
