"""Written tables in the shared folder of the cluster.

A step that must be computed once (a numbering that later steps join back to) is
written out and read again, so a lost executor never recomputes it differently.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = context.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="talkloom-")
    return _LOCAL_ROOTS[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new, unused path for one run of one step."""
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/talkloom/{app}/{tag}-{uuid.uuid4().hex}"


def small_table(spark: SparkSession, columns: dict[str, list], **types: pa.DataType) -> DataFrame:
    """A table given in the program; Spark knows its size and broadcasts it when joined.

    Columns are strings unless a type is given by name.
    """
    schema = pa.schema([(name, types.get(name, pa.string())) for name in columns])
    return spark.createDataFrame(pa.table(columns, schema=schema))


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet and go on from the stored rows."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
