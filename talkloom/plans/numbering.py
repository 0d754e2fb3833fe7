"""Numbering all rows of a table in order, without one task seeing them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.sources.scratch import written


def number_rows(df: DataFrame, order: list[str | Column], out: str = "number", keep_part: bool = False) -> DataFrame:
    """Add the position of each row, from 0, in the order of ``order``.

    ``order`` must be unique per row. Rows are range partitioned on it, so even a single
    hot key spreads over tasks, and numbered inside their partition. The result is
    written once: range bounds come from a sample and may not be computed twice. Taking
    the sample reads ``df`` an extra time, so store it first if it is costly to make. The
    counts that shift each partition are one row per partition, hence the broadcast.
    With ``keep_part`` the number of a row's partition stays as ``_part``.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = (
        df.repartitionByRange(*columns)
        .sortWithinPartitions(*columns)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    stored = written(placed, "numbered")
    # monotonically_increasing_id holds the partition above bit 33, the row below it.
    part = F.shiftright("_row", 33)
    counts = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    local = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = (
        stored.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(out, F.col("_start") + local)
        .drop("_row", "_start")
    )
    return numbered if keep_part else numbered.drop("_part")


def sum_before(df: DataFrame, order: list[str | Column], amount: str, out: str = "before") -> DataFrame:
    """Add the sum of the whole-number column ``amount`` over all rows that come earlier in ``order``.

    As in ``number_rows`` rows are range partitioned on the unique order, stored once, summed
    inside their partition and shifted by the sums of the partitions before it. Null counts as 0.
    """
    stored = number_rows(df, order, "_number", keep_part=True)
    value = F.coalesce(F.col(amount), F.lit(0))
    totals = stored.groupBy("_part").agg(F.sum(value).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy("_number").rowsBetween(Window.unboundedPreceding, -1)
    return (
        stored.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(starts), F.col("_part") == F.col("_of"))
        .withColumn(out, F.col("_start") + F.col("_inside"))
        .drop("_number", "_part", "_of", "_start", "_inside")
    )
