"""Instruction records to prompt records."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.functions.prompts import format_example
from talkloom.plans.numbering import number_rows
from talkloom.sources.records import split_rejects

#: So many keys a task may keep and one task merge.
FEW_KEYS = 10_000


def prompt_records(records: DataFrame) -> DataFrame:
    """Replace ``instruction, input, output`` by ``context, target``; other columns stay.

    Records without an instruction or an output are left out; see ``rejected_records``.
    """
    good, _ = split_rejects(records, ["instruction", "output"])
    context, target = format_example(F.col("instruction"), F.col("input"), F.col("output"))
    return good.select("*", context.alias("context"), target.alias("target")).drop(
        "instruction", "input", "output"
    )


def rejected_records(records: DataFrame) -> DataFrame:
    """The records ``prompt_records`` leaves out."""
    return split_rejects(records, ["instruction", "output"])[1]


def first_n(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of the given unique order, as a set.

    The keys of the first rows are found from the order columns alone, then the rows by
    their keys, so no task holds all ``n`` rows. Up to ``FEW_KEYS`` keys, every task keeps
    its lowest ``n`` and one task merges them; beyond that the keys are range partitioned
    and numbered. Both ways give the same rows. ``df`` is read more than once: store it
    first if it is costly to make.
    """
    # Names of their own: keys and rows come from one table, whose columns would be the same on both sides.
    names = [f"_key{i}" for i in range(len(order))]
    keys = df.select(*[F.col(c).alias(name) for c, name in zip(order, names)])
    if n <= FEW_KEYS:
        keys = keys.orderBy(*names).limit(n)
    else:
        keys = number_rows(keys, names, "_number").filter(F.col("_number") < n)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(name)) for c, name in zip(order, names)])
    return df.join(keys, same, "left_semi")
