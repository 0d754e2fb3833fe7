"""Quality rules with thresholds learnt per language and source, with DataFrame functions only.

Fixed base rules give up on short and repetitive texts. For the rest, each measure has
a fence: the ``QUANTILE`` of its group plus ``REACH`` times its distance from the
median, but at least ``LEAST`` above the median. Groups are (language, source).

Quantiles come from sketches that merge by adding: counts over bins of thousandths of a
measure, one for each value below ``2 ** BITS`` and above that one for each value of the
leading ``BITS`` bits. A sketch has at most ``2 ** (BITS - 1) * (65 - BITS)`` bins however many
texts it stands for, and does not depend on how rows are partitioned. The median is
taken at the lower end of its bin and the quantile at the upper end, so that a fence is
never tighter than the exact one, and wider by at most ``(2 * REACH + 1) / 2 ** (BITS - 1)`` of
the quantile. Texts are compared with it by their exact measures.

A group of n texts weighs its own fence n to ``PRIOR`` against that of its language, and a
language its own against that of all texts, so verdicts do not jump with a group's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.llm.native import text_of, words
from talkloom.llm.stores import free_name, sent_if_small
from talkloom.sources.scratch import written

LEAST_WORDS = 50
MOST_REPEATED = 50
#: So many texts of a group weigh as much as the group above it.
PRIOR = 200
#: Leading bits that a bin of the sketch tells apart.
BITS = 8
QUANTILE = 0.9
REACH = 3
#: Name of a measure -> (count, of what), in thousandths, and the least width of its fence.
MEASURES = {
    "symbols": ("n_symbols", "n_words", 100),
    "dup_lines": ("n_dup_lines", "n_lines", 300),
    "repeats": ("n_repeat_words", "n_words", 200),
    "word_length": ("word_chars", "n_words", 3000),
}
#: A row of fences is about 60 bytes.
MOST_SENT = 200_000


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    value, tokens, lines, grams = (free_name(docs.columns, n) for n in ("_value", "_tokens", "_lines", "_grams"))
    first = docs.withColumn(value, text_of(text))
    rows = first.withColumns(
        {
            tokens: words(F.col(value)),
            lines: F.filter(F.split(F.col(value), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    # A window is the 64-bit hash of three words; with its position, sorted, equal windows are neighbours.
    at = F.col(tokens)
    windows = F.transform(at, lambda word, i: F.xxhash64(word, F.get(at, i + 1), F.get(at, i + 2)))
    rows = rows.withColumn(
        grams,
        F.when(F.size(at) < 4, F.array().cast("array<bigint>")).otherwise(F.slice(windows, F.lit(1), F.size(at) - 2)),
    )
    distinct = F.size(F.array_distinct(grams))
    placed = F.sort_array(F.transform(F.col(grams), lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    sorted_name = f"{grams}_sorted"
    rows = rows.withColumn(sorted_name, F.when(distinct < F.size(grams), placed))
    ordered = F.col(sorted_name)
    # get() gives null outside the array, and a null comparison does not pass the filter.
    repeated = F.filter(
        ordered,
        lambda x, k: (F.get(ordered, k - 1)["g"] == x["g"]) | (F.get(ordered, k + 1)["g"] == x["g"]),
    )
    places = F.sort_array(F.transform(repeated, lambda x: x["i"]))
    places_name = f"{grams}_places"
    rows = rows.withColumn(places_name, places)
    at = F.col(places_name)
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("p")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["p"])).alias("n"), p.alias("p")),
        lambda acc: acc["n"],
    )
    return rows.withColumns(
        {
            "n_words": F.size(tokens).cast("long"),
            "word_chars": F.length(F.array_join(tokens, "")).cast("long"),
            "n_symbols": F.regexp_count(F.col(value), F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    ).drop(value, tokens, lines, grams, sorted_name, places_name)


MEASURE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _thousandths(name: str) -> Column:
    part, of, _ = MEASURES[name]
    share = F.floor(F.col(part) * 1000 / F.col(of))
    return F.when(F.col(of) > 0, share).otherwise(F.lit(0)).cast("long")


def _lost_bits(value: Column) -> Column:
    return F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))


def bin_low(value: Column) -> Column:
    """The lowest value of the bin that holds ``value``."""
    lost = _lost_bits(value)
    return F.call_function("shiftleft", F.call_function("shiftright", value, lost), lost)


def bin_high(value: Column) -> Column:
    """The highest value of the bin that holds ``value``."""
    return bin_low(value) + F.call_function("shiftleft", F.lit(1).cast("long"), _lost_bits(value)) - 1


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n) of the rows that pass the base rules; partial counts merge by adding."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bin_low(_thousandths(m)).alias("bin")) for m in MEASURES]))
    passed = rows.where(~base_failed()).select("lang", "source", values.alias("v"))
    return passed.groupBy("lang", "source", "v.measure", "v.bin").agg(F.count("*").alias("n"))


def fences(counts: DataFrame) -> DataFrame:
    """(lang, source, one fence per measure) for every group of ``counts``."""
    none = F.lit(None).cast("string")
    merged = (
        counts.select(F.lit(0).alias("level"), "lang", "source", "measure", "bin", "n")
        .unionByName(
            counts.groupBy("lang", "measure", "bin").agg(F.sum("n").alias("n")).select(F.lit(1).alias("level"), "lang", none.alias("source"), "measure", "bin", "n")
        )
        .unionByName(
            counts.groupBy("measure", "bin").agg(F.sum("n").alias("n")).select(F.lit(2).alias("level"), none.alias("lang"), none.alias("source"), "measure", "bin", "n")
        )
    )
    # A group of the window is one sketch, so its rows are bounded.
    group = Window.partitionBy("level", "lang", "source", "measure")
    ranked = merged.withColumns(
        {"upto": F.sum("n").over(group.orderBy("bin")), "total": F.sum("n").over(group)}
    )
    least = F.create_map(*[F.lit(x) for m, (_, _, width) in MEASURES.items() for x in (m, width)])
    quantiles = (
        ranked.groupBy("level", "lang", "source", "measure", "total")
        .agg(
            F.min(F.when(2 * F.col("upto") >= F.col("total"), F.col("bin"))).alias("median"),
            F.min(F.when(100 * F.col("upto") >= int(100 * QUANTILE) * F.col("total"), bin_high(F.col("bin")))).alias("high"),
        )
        .withColumn(
            "fence",
            F.greatest(
                F.col("high") + REACH * (F.col("high") - F.col("median")), F.col("median") + F.element_at(least, F.col("measure"))
            ).cast("double"),
        )
    )
    wide = written(
        quantiles.groupBy("level", "lang", "source", "total").agg(
            *[F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(m) for m in MEASURES]
        ),
        "rule-fences",
    )
    own, by_lang, overall = (wide.where(F.col("level") == k) for k in range(3))

    def blended(above: str, m: str) -> Column:
        return ((F.col("total") * F.col(m) + PRIOR * F.col(f"{above}_{m}")) / (F.col("total") + PRIOR)).alias(m)

    # One row in all.
    top = overall.select(*[F.col(m).alias(f"all_{m}") for m in MEASURES])
    languages = by_lang.join(F.broadcast(top), F.lit(True)).select("lang", "total", *[blended("all", m) for m in MEASURES])
    above = languages.select(F.col("lang").alias("_of"), *[F.col(m).alias(f"lang_{m}") for m in MEASURES])
    return own.join(sent_if_small(written(above, "rule-languages"), MOST_SENT), F.col("lang").eqNullSafe(F.col("_of"))).select(
        F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[blended("lang", m).alias(f"_{m}") for m in MEASURES]
    )


def _with_verdict(rows: DataFrame, limits: DataFrame) -> DataFrame:
    same = rows["lang"].eqNullSafe(limits["_lang"]) & rows["source"].eqNullSafe(limits["_source"])
    inside = [F.coalesce(_thousandths(m) <= F.col(f"_{m}"), F.lit(True)) for m in MEASURES]
    verdict = ~F.col("base_failed")
    for ok in inside:
        verdict = verdict & ok
    return rows.withColumn("base_failed", base_failed()).join(limits, same, "left").withColumn("kept", verdict)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, kept.

    Null and empty texts have no words and fail the base rules. Null languages and
    sources are groups of their own. Repeated rows are judged alike, each giving a row.
    Other columns are not read. An empty table gives no rows.
    """
    named = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source")
    )
    rows = written(measured(named).drop("text"), "rule-measures")
    limits = written(fences(written(sketches(rows), "rule-sketches")), "rule-limits")
    return _with_verdict(rows, sent_if_small(limits, MOST_SENT)).select("doc_id", *MEASURE_COLUMNS, "base_failed", "kept")
