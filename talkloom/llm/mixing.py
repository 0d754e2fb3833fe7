"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

A source may be repeated up to ``max_epochs`` times. Targets rise together, in
proportion to the weights, until a source reaches its cap; it is clamped there and what
it cannot take is shared by the others, until no source is above its cap. Each document
is then taken as many whole times as its source's target holds the source, and the
fraction that is left is filled with further documents in a seeded order.

That order is by a hash of id and text. Documents fall into 4096 hash ranges per source; sums of
the ranges tell in which one the fraction ends, and only the documents of that range are put in
order, rows that repeat id and text being counted, not listed. So neither a source that holds a
third of all rows nor a row that does is ever sorted or gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.llm.native import text_of, word_count
from talkloom.llm.stores import sent_if_small
from talkloom.plans.numbering import number_rows
from talkloom.sources.scratch import written

MAX_EPOCHS = 3
SEED = "mix"
#: One row per source is about 60 bytes.
MOST_SENT = 100_000


def _measured(doc_id: str, source: str, text: str, seed: str) -> Column:
    """Id, source, size in words, and 48 bits that order the documents of a source; the top 12 are the hash range."""
    key, words = F.col(doc_id).cast("long"), text_of(text)
    digest = F.md5(
        F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(words.cast("binary"))).cast("binary")
    )
    return F.struct(
        key.alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        word_count(words).alias("size"),
        F.conv(F.substring(digest, 1, 12), 16, 10).cast("long").alias("place"),
    )


def water_level(sources: DataFrame) -> tuple[float, int]:
    """The target per weight of sources below their cap, and how many sources are clamped.

    ``sources`` has size, cap and weight. A round clamps every source above its cap and
    shares the rest; clamped sources stay clamped, since the level only rises.
    """
    total, weight = sources.agg(F.sum("size"), F.sum("weight")).first()
    if not total:
        return 0.0, 0
    level, clamped = total / weight, 0
    while True:
        above = F.col("cap") < F.lit(level) * F.col("weight")
        count, held, free = sources.agg(
            F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if count == clamped or not free:
            return level, count
        level, clamped = (total - held) / free, count


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from rows (source, size); weights 1, 2, 3, 1, .. by code point, null last."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("size"))
    ranked = number_rows(sums, [F.col("source").isNull(), "source"], "rank")
    weighed = written(
        ranked.select("source", "size", (F.col("size") * max_epochs).alias("cap"), (F.pmod("rank", F.lit(3)) + 1).alias("weight")),
        "mix-sources",
    )
    level, _ = water_level(weighed)
    share = F.lit(level) * F.col("weight")
    return weighed.select(
        "source",
        F.col("size").alias("source_size"),
        F.when(F.col("cap") < share, F.col("cap").cast("double")).otherwise(share).alias("target"),
    )


def _ends(sizes: DataFrame, max_epochs: int) -> tuple[DataFrame, DataFrame]:
    """Per source its plan, and the places of the hash range in which its fraction ends.

    ``sizes`` has doc_id, source, size and place. A plan is source, source_size, target, whole, rest
    and end_range. A place is (source, place, doc_id, size) with its number of rows and
    how many of them are taken once more.
    """
    targets = source_targets(sizes, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plans = targets.withColumn("whole", F.least(whole.cast("long"), F.lit(max_epochs))).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")
    )
    ranged = sizes.withColumn("range", F.shiftright("place", 36))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    running = sums.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    s, p = running.alias("s"), plans.alias("p")
    last = (
        s.join(p, F.col("s.source").eqNullSafe(F.col("p.source")))
        .where(F.col("s.before") < F.col("p.rest"))
        .groupBy("p.source")
        .agg(F.max(F.struct("s.range", "s.before")).alias("end"))
    )
    e = last.alias("e")
    ready = written(
        p.join(e, F.col("p.source").eqNullSafe(F.col("e.source")), "left").select(
            F.col("p.source").alias("plan_source"),
            "p.source_size",
            "p.target",
            "p.whole",
            "p.rest",
            F.col("e.end.range").alias("end_range"),
            F.col("e.end.before").alias("end_before"),
        ),
        "mix-plan",
    )
    here = ranged.join(
        sent_if_small(ready.where("end_range is not null"), MOST_SENT),
        ranged["source"].eqNullSafe(ready["plan_source"]) & (F.col("range") == F.col("end_range")),
    )
    places = here.groupBy("source", "place", "doc_id", "size", "rest", "end_before").agg(F.count("*").alias("rows"))
    order = Window.partitionBy("source").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("end_before") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(order), F.lit(0))

    def fits(k: Column) -> Column:
        """Whether at least half of the k-th row is before the end of the fraction."""
        return F.lit(2) * (F.col("start") + k * F.col("size")) - F.col("size") <= F.lit(2) * F.col("rest")

    rough = F.floor((F.lit(2) * F.col("rest") + F.col("size") - F.lit(2) * F.col("start")) / (F.lit(2) * F.col("size"))).cast("long")
    near = F.when(fits(rough + 1), rough + 1).when(fits(rough), rough).otherwise(rough - 1)
    more = F.when(F.col("size") > 0, F.greatest(F.lit(0).cast("long"), F.least(F.col("rows"), near))).otherwise(
        F.when(F.col("start") <= F.col("rest"), F.col("rows")).otherwise(F.lit(0).cast("long"))
    )
    counted = places.withColumn("start", start).select(
        F.col("source").alias("at_source"), F.col("place").alias("at_place"), F.col("doc_id").alias("at_id"), F.col("size").alias("at_size"), "rows", more.alias("more")
    )
    return ready, written(counted, "mix-places")


def planned_copies(rows: DataFrame, at: str, sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``rows`` with ``plan_target``, ``plan_size`` of the source, and ``plan_copies`` of each row.

    ``at`` is the struct column of ``_measured``; ``sizes`` has its fields as a stored table. Of rows
    that repeat id, text and source, as many are taken once more as the fraction asks for.
    """
    ready, places = _ends(sizes, max_epochs)
    planned = rows.join(sent_if_small(ready, MOST_SENT), F.col(f"{at}.source").eqNullSafe(ready["plan_source"]))
    own = F.shiftright(F.col(f"{at}.place"), 36)
    others = planned.where("end_range is null").withColumn("_more", F.lit(False)).unionByName(
        planned.where(own != F.col("end_range")).withColumn("_more", own < F.col("end_range"))
    )
    last = planned.where(own == F.col("end_range")).join(
        sent_if_small(places, MOST_SENT),
        F.col(f"{at}.source").eqNullSafe(places["at_source"])
        & (F.col(f"{at}.place") == places["at_place"])
        & F.col(f"{at}.doc_id").eqNullSafe(places["at_id"])
        & (F.col(f"{at}.size") == places["at_size"]),
    )
    decided = last.where("more = 0 or more = rows").withColumn("_more", F.col("more") > 0)
    drop = ["at_source", "at_place", "at_id", "at_size", "rows", "more"]
    found = others.unionByName(decided.drop(*drop))
    if not places.where("more > 0 and more < rows").isEmpty():
        # One place a source at most: its rows are numbered, as many tasks as it takes.
        split = written(last.where("more > 0 and more < rows").withColumn("_row", F.monotonically_increasing_id()), "mix-split")
        numbered = number_rows(split, [F.col("at_source").isNull(), "at_source", "_row"], "_number")
        first = numbered.groupBy(F.col("at_source").alias("_of")).agg(F.min("_number").alias("_first"))
        placed = numbered.join(F.broadcast(first), F.col("at_source").eqNullSafe(F.col("_of")))
        found = found.unionByName(placed.withColumn("_more", F.col("_number") - F.col("_first") < F.col("more")).drop(*drop, "_row", "_number", "_of", "_first"))
    return found.select(
        *rows.columns,
        F.col("source_size").alias("plan_size"),
        F.col("target").alias("plan_target"),
        (F.col("whole") + F.col("_more").cast("long")).alias("plan_copies"),
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, copies.

    Size is the number of words, 0 for null. ``taken`` is size times copies, at most
    ``max_epochs`` times the size. A null source is a source of its own, last in order.
    Rows, not ids, are taken: rows that share an id, or have none, are apart. The same
    rows and seed give the same mix under any partitioning; among rows that repeat id, text
    and source it is open which are taken once more, but not how many. Other columns are
    not read. Without rows or words nothing is taken.
    """
    sizes = written(docs.select(_measured(doc_id, source, text, seed).alias("at")).select("at.*"), "mix-sizes")
    rows = sizes.select(F.struct("doc_id", "source", "size", "place").alias("at"))
    return planned_copies(rows, "at", sizes, max_epochs).select(
        "at.doc_id", "at.size", F.col("plan_size").alias("source_size"), F.col("plan_target").alias("target"),
        (F.col("at.size") * F.col("plan_copies")).alias("taken"), F.col("plan_copies").alias("copies"),
    )


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The rows that the mix takes, each as often as it is taken, with the columns of ``docs``."""
    sizes = written(docs.select(_measured(doc_id, source, text, seed).alias("at")).select("at.*"), "mix-sizes")
    # The columns of the input go along as one, so that their names meet no others.
    rows = docs.select(_measured(doc_id, source, text, seed).alias("at"), F.struct(*[docs[c] for c in docs.columns]).alias("own"))
    taken = planned_copies(rows, "at", sizes, max_epochs).where("plan_copies > 0")
    each = taken.withColumn("_number", F.explode(F.sequence(F.lit(1), F.col("plan_copies").cast("int"))))
    return each.select(*[F.col("own").getField(c).alias(c) for c in docs.columns])
