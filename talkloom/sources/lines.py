"""Numbered lines of text files of any size, and parsed binary files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom.functions.rows import exploded
from talkloom.functions.strings import split_lines
from talkloom.sources.schemas import PARSED_UNIT
from talkloom.sources.scratch import small_table


# At some 200 bytes per split the counts of this many splits take 400 MB; they cover 250 TB
# in splits of 128 MB.
MAX_BROADCAST_SPLITS = 2_000_000


def numbered_lines(
    spark: SparkSession, path: str, glob: str | None = None, keep_final_empty: bool = False
) -> DataFrame:
    r"""``(file, pos, text)`` with ``\r\n``, ``\n`` and ``\r`` all ending a line.

    Files are read in splits. Rows are numbered inside their split, and one count per
    split turns that into the line number, so a huge file is never one task.
    ``keep_final_empty`` adds the empty line behind a final terminator.
    """
    reader = spark.read.option("lineSep", "\n")
    listing = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
        listing = listing.option("pathGlobFilter", glob)
    raw = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
    )
    # A carriage return before the newline belongs to it; any other ends a line itself.
    parts = F.split(F.regexp_replace("value", r"\r\z", ""), "\r", -1)
    lines = raw.select("file", "block", F.explode(parts).alias("text")).withColumn(
        "row", F.monotonically_increasing_id()
    )
    per_split = lines.groupBy("file", "block").agg(
        F.count("*").alias("n"), F.min("row").alias("first_row")
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_split.select(
        "file",
        "block",
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first_row")).alias("shift"),
    )
    if most_splits(spark, listing.load(path)) <= MAX_BROADCAST_SPLITS:
        starts = F.broadcast(starts)
    numbered = lines.join(starts, ["file", "block"]).select(
        "file", (F.col("row") + F.col("shift")).alias("pos"), "text"
    )
    if not keep_final_empty:
        return numbered
    # The bytes not found in any line are the newlines: one per line, or one less.
    ends = raw.withColumn("row", F.monotonically_increasing_id()).groupBy("file").agg(
        F.first("bytes").alias("bytes"),
        F.sum(F.octet_length("value")).alias("body"),
        F.count("*").alias("n_raw"),
        F.max_by(F.col("value").endswith("\r"), F.struct("block", "row")).alias("cr"),
        F.sum(F.size(parts)).alias("n"),
    )
    closed = (F.col("bytes") - F.col("body") == F.col("n_raw")) | F.col("cr")
    final = ends.filter(closed).select("file", F.col("n").alias("pos"), F.lit("").alias("text"))
    # Scans pass over files without a byte; they are known from the listing the driver holds.
    files = listing.load(path)
    known = [re.sub(r"^file:/+", "file:/", f) for f in files.inputFiles()]
    read = files.select(F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("file"))
    hollow = small_table(spark, {"file": known}).join(read, "file", "left_anti")
    hollow = hollow.select("file", F.lit(0).cast("long").alias("pos"), F.lit("").alias("text"))
    return numbered.unionByName(final).unionByName(hollow)


def most_splits(spark: SparkSession, files: DataFrame) -> int:
    """An upper bound for the number of splits Spark reads the files in, from their sizes alone."""
    count, size = files.agg(F.count("*"), F.sum("length")).first()
    if not count:
        return 0
    per_core = size // spark.sparkContext.defaultParallelism
    largest = _setting(spark, "spark.sql.files.maxPartitionBytes")
    smallest = _setting(spark, "spark.sql.files.openCostInBytes")
    return count + size // max(1, min(largest, max(smallest, per_core)))


def _setting(spark: SparkSession, name: str) -> int:
    """A size setting in bytes, written like ``134217728b`` or ``128m``."""
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]?)b?", spark.conf.get(name).lower()).groups()
    return int(number) * 1024 ** " kmgt".index(unit or " ") if unit != "b" else int(number)


def read_text_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every ``.txt`` file right in ``folder``, blank lines included."""
    return numbered_lines(spark, folder, glob="*.txt")


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """A knowledge file as lines; the part behind the last newline counts, even if empty."""
    return numbered_lines(spark, path, keep_final_empty=True)


def knowledge_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """The same rule for knowledge texts already held in a column: ``(key, pos, text)``."""
    return exploded(df, key, split_lines(F.col(text)), "pos", "text")


Parser = Callable[[bytes], list[str]]


def read_binary_corpus(spark: SparkSession, folder: str, parsers: dict[str, Parser]) -> DataFrame:
    """``(file, kind, pos, text)`` units of binary files, one parser per suffix.

    A parser turns the bytes of one file into its paragraphs or pages.
    """
    frames = [
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*.{kind}")
        .load(folder)
        .select(F.col("path").alias("file"), "content")
        .mapInPandas(_parse_with(kind, parser), PARSED_UNIT)
        for kind, parser in sorted(parsers.items())
    ]
    if not frames:
        return spark.createDataFrame([], PARSED_UNIT)
    units = frames[0]
    for frame in frames[1:]:
        units = units.unionByName(frame)
    return units


def _parse_with(kind: str, parser: Parser):
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"]):
                units = parser(bytes(content))
                yield pd.DataFrame(
                    {"file": file, "kind": kind, "pos": range(len(units)), "text": units}
                ).astype({"pos": "int64"})

    return parse
