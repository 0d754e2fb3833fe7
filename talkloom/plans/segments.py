"""Looking at the neighbour row inside a group that may be far too large for one task.

If no order value reaches the segment length, every group is small and one plain window
does. This is checked first, by a filter on the order column that stored tables answer
from their statistics. Otherwise groups are cut into segments of the order column: each
window runs over one segment, and only its first or last row crosses to the neighbour, as a
row that is marked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 4096


def segment_of(order: str, segment: int):
    return F.expr(f"`{order}` div {int(segment)}")


def has_long_groups(df: DataFrame, order: str, segment: int = SEGMENT) -> bool:
    """Whether any group may hold more than ``segment`` rows, its order counting from 0."""
    return not df.select(order).filter(F.col(order) >= segment).isEmpty()


def next_row(
    df: DataFrame, key: list[str], order: str, columns: list[str], out: str, segment: int = SEGMENT
) -> DataFrame:
    """Add ``out``: a struct of ``columns`` of the next row of the group, null at its end.

    ``order`` must be a whole number from 0, unique within the group.
    """
    return _neighbour(df, key, order, columns, out, segment, ahead=True)


def previous_row(
    df: DataFrame, key: list[str], order: str, columns: list[str], out: str, segment: int = SEGMENT
) -> DataFrame:
    """Add ``out``: a struct of ``columns`` of the row before, null at the group's start."""
    return _neighbour(df, key, order, columns, out, segment, ahead=False)


def _neighbour(df, key, order, columns, out, segment, ahead):
    value = F.struct(*columns)
    if not has_long_groups(df, order, segment):
        whole = Window.partitionBy(*key).orderBy(order)
        shifted = F.lead(value).over(whole) if ahead else F.lag(value).over(whole)
        return df.withColumn(out, shifted)
    parts = [*key, "_seg"]
    late = df.filter(F.col(order) >= segment).withColumn("_seg", segment_of(order, segment))
    along = Window.partitionBy(*key).orderBy("_seg")
    if ahead:
        # The first row of a later segment belongs to the last row of the segment before.
        edge = late.groupBy(*parts).agg(F.min_by(value, order).alias("_edge"))
        carried = edge.select(
            *key, F.coalesce(F.lag("_seg").over(along), F.lit(0)).alias("_seg"), "_edge"
        )
    else:
        # Last rows are needed of every segment, but only in groups that have a later one.
        large = late.select(*key).distinct()
        edge = (
            null_safe_join(df, large, list(key), "left_semi")
            .withColumn("_seg", segment_of(order, segment))
            .groupBy(*parts)
            .agg(F.max_by(value, order).alias("_edge"))
        )
        carried = edge.select(
            *key, F.lead("_seg").over(along).alias("_seg"), "_edge"
        ).filter(F.col("_seg").isNotNull())
    # The edge stands as a row of its own before or behind its segment, so that one window, and
    # one shuffle of whole rows, gives every row its neighbour.
    rows = df.withColumns({"_seg": segment_of(order, segment), "_mark": F.lit(0)})
    values = [F.col("_edge")[c].alias(c) for c in columns if c not in key]
    marked = carried.select(*parts, F.lit(1 if ahead else -1).alias("_mark"), *values)
    inside = Window.partitionBy(*parts).orderBy("_mark", order)

    def shifted(column):
        return F.lead(column).over(inside) if ahead else F.lag(column).over(inside)

    # Column by column: a struct of them would be shuffled beside them.
    found = F.when(shifted("_mark").isNotNull(), F.struct(*[shifted(c).alias(c) for c in columns]))
    # Dealt out by segment here: by group alone, rows made from few groups would be few, large tasks.
    every = rows.unionByName(marked, allowMissingColumns=True).repartition(*parts).withColumn(out, found)
    return every.filter(F.col("_mark") == 0).select(*df.columns, out)


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join on equal names in which null equals null; the names come from ``left``."""
    renamed = right.select(*[F.col(c).alias(f"_on_{c}" if c in on else c) for c in right.columns])
    same = F.lit(True)
    for name in on:
        same = same & left[name].eqNullSafe(renamed[f"_on_{name}"])
    return left.join(renamed, same, how).drop(*[f"_on_{c}" for c in on])
