"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, key: str | list[str], array: Column, pos: str, value: str) -> DataFrame:
    """``(key, pos, value)`` for each element of ``array``; null and empty arrays give none.

    The outer form with a filter behind it: for the inner form Spark adds a filter on the
    size of the array, which makes a costly array (a split, a parse, a UDF) twice.
    """
    keys = [key] if isinstance(key, str) else key
    rows = df.select(*keys, F.posexplode_outer(array).alias("_at", value))
    return rows.filter(F.col("_at").isNotNull()).select(
        *keys, F.col("_at").cast("long").alias(pos), value
    )
