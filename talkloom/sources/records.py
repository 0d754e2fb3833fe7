"""Instruction arrays, JSON lines and stored token datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.functions.rows import exploded
from talkloom.sources.arrays import read_array_splits
from talkloom.sources.lines import numbered_lines
from talkloom.sources.schemas import INSTRUCTION


#: Files up to this size are read whole, one task a file.
WHOLE_BYTES = 64 << 20


def read_instructions(
    spark: SparkSession, path: str, schema: T.StructType = INSTRUCTION, whole_bytes: int = WHOLE_BYTES
) -> DataFrame:
    """Rows of JSON array files as ``(file, pos, <fields>)``.

    Small files are read as wholes; if any is larger, files are read in splits, two
    times, with the same rows. A malformed file fails the read.
    """
    # Sizes alone: the contents are not read for this.
    largest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
    if largest is not None and largest > whole_bytes:
        return read_array_splits(spark, path, schema)
    raw = spark.read.text(path, wholetext=True)
    rows = F.from_json("value", T.ArrayType(schema), {"mode": "FAILFAST"})
    files = raw.select(F.col("_metadata.file_path").alias("file"), "value")
    return exploded(files, "file", rows, "pos", "record").select("file", "pos", "record.*")


def read_jsonl(
    spark: SparkSession, path: str, schema: T.StructType, with_pos: bool = False
) -> DataFrame:
    """One JSON object per line, plus ``_corrupt_record`` for lines that do not parse.

    ``with_pos`` adds ``file`` and the line number ``pos``, counted in parallel.
    """
    if not with_pos:
        full = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
        return spark.read.schema(full).option("mode", "PERMISSIVE").json(path)
    full = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    parsed = F.from_json(
        "text", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    )
    lines = numbered_lines(spark, path).withColumn("record", parsed)
    fields = [F.col(f"record.{f.name}").alias(f.name) for f in schema.fields]
    # An empty line gives a null record; it is no JSON object either.
    bad = F.when(F.col("record").isNull(), F.col("text")).otherwise(F.col("record._corrupt_record"))
    return lines.select("file", "pos", *fields, bad.alias("_corrupt_record"))


def split_rejects(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with every required field, and the rest. Both stay lazy."""
    ok: Column = F.lit(True)
    for name in required:
        ok = ok & F.col(name).isNotNull()
    if "_corrupt_record" not in df.columns:
        return df.filter(ok), df.filter(~ok)
    ok = ok & F.col("_corrupt_record").isNull()
    return df.filter(ok).drop("_corrupt_record"), df.filter(~ok)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object per line; null fields and non-ASCII text are kept as they are."""
    df.write.option("ignoreNullFields", "false").json(path)


def save_dataset(df: DataFrame, path: str) -> None:
    """Store token sequences; appending later adds files and rewrites nothing."""
    df.write.parquet(path)


def load_dataset(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Reopen a stored dataset; give the schema to skip reading footers for it."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)
