"""Shared folders, files written by tasks, and joins whose small side is measured first."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column of the input has that name."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def sent_if_small(small: DataFrame, most_rows: int) -> DataFrame:
    """Broadcast ``small`` if it has at most ``most_rows`` rows (counted); else leave the join to Spark."""
    return F.broadcast(small) if small.count() <= most_rows else small


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextmanager
def committed(uri: str) -> Iterator:
    """A binary stream whose file gets its name only once it is complete.

    A task that dies leaves a temporary file that no manifest names; a task that runs
    twice puts the same bytes under the same name.
    """
    system, path = filesystem(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(f"{folder}/_parts", recursive=True)
    part = f"{folder}/_parts/{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part, compression=None) as out:
        yield out
    system.move(part, path)


def removed(spark: SparkSession, uri: str) -> None:
    """Delete a folder of this package's own intermediate rows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
