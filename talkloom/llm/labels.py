"""Labelled rows: which are held out, and one label per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; -1 for a null id, which has no label."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(divisor)), F.lit(-1))


def one_label(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """(labelled_id, label): the mean of a document's labels, rounded up from a half; nulls are left out."""
    rows = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    return rows.groupBy(F.col(doc_id).cast("long").alias("labelled_id")).agg(
        (F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label")
    )
