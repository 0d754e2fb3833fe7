"""How the words of each source differ from those of the other sources, and of its language.

A term's share in a group is p = 1 + floor(10^9 * (count + PRIOR) / (total + PRIOR * terms)), all in
whole numbers. The divergence of two groups is the sum of the differences of their shares over
all terms that their language keeps.

These sums are made in a cube. Groups and terms fall into blocks by hash; a task owns cells
(group block, group block, term block), to which the slices (group block, term block) are
copied. In a cell the shares stand in a matrix, and each pair of its groups gets a partial sum
over the cell's terms; partial sums meet along the term axis. A cell names only terms that
one of its groups has: every cell starts from the difference of the two shares of an
absent term, which is known for each group, and corrects it, so absent terms need no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.llm.stores import sent_if_small
from talkloom.llm.text import text_bytes
from talkloom.sources.scratch import written

LEAST_DOCS = 30
PRIOR = 5
TOP_TERMS = 50
SCALE = 1_000_000_000
#: The sides of a cell: its matrices have at most about 2 * 64 rows of 2,048 shares, 2 MB.
GROUPS_A_BLOCK, TERMS_A_BLOCK = 64, 2048
#: Groups whose totals are sent to the tasks: some 100 bytes each.
MOST_SENT = 500_000
#: Term counts that a task holds before it gives them out.
_HELD = 300_000
_LONG = 1 << 20
#: Letters A-Z and a-z and all characters beyond ASCII, as bytes of UTF-8.
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")

COUNTS = "lang string, source string, term binary, n long, docs long"


def terms(text: bytes) -> Iterator[bytes]:
    """The terms of a text in order; A-Z are lower-cased. The list of a long text is never made."""
    text = text.lower()
    return iter(_TERM.findall(text)) if len(text) < _LONG else (m.group() for m in _TERM.finditer(text))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of terms and of the documents that have them, summed up to a bound; and a row without term for each group."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    named: set[tuple[str, str]] = set()

    def batch_of(group: tuple[str, str], columns: list) -> pa.RecordBatch:
        size = len(columns[0])
        arrays = [pa.array([g] * size, pa.string()) for g in group]
        arrays += [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64()), strict=True)]
        return pa.record_batch(arrays, ["lang", "source", "term", "n", "docs"])

    def flushed() -> Iterator[pa.RecordBatch]:
        for group, (counts, docs) in seen.items():
            yield batch_of(group, [list(counts), list(counts.values()), [docs[t] for t in counts]])
        seen.clear()

    held = 0
    for batch in batches:
        groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        for group, text in zip(groups, text_bytes(batch.column("text")), strict=True):
            if group not in named:
                if len(named) >= _HELD:
                    named.clear()
                named.add(group)
                yield batch_of(group, [[None], [0], [0]])
            own = Counter(terms(text))
            counts, docs = seen.setdefault(group, (Counter(), Counter()))
            before = len(counts)
            counts.update(own)
            docs.update(own.keys())
            held += len(counts) - before
            if held > _HELD:
                yield from flushed()
                held = 0
    yield from flushed()


def share(count: str | Column, total: str, kinds: str, prior: int = PRIOR) -> Column:
    """1 + floor(10^9 * (count + prior) / (total + prior * kinds)), exact; null without kept terms."""
    n = count if isinstance(count, Column) else F.col(count)
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + F.lit(prior).cast("long")).cast("decimal(20,0)")
    below = F.nullif((F.col(total) + F.lit(prior) * F.col(kinds)).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return F.call_function("div", above, below) + F.lit(1).cast("long")


PARTIAL = "lang string, source string, item string, value long"
_PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _cell(key: tuple, rows: pa.Table) -> pa.Table:
    """Partial divergences of the group pairs of one cell, both ways.

    Rows are (source, block, term, p, absent, kinds); a row without term stands for its group.
    """
    lang, one, other, number = (k.as_py() for k in key)
    rows = rows.combine_chunks()
    marks = rows.filter(pc.is_null(rows["term"]))
    names = marks["source"].to_pylist()
    absent, blocks = marks["absent"].to_numpy(), marks["block"].to_numpy()
    kinds = marks["kinds"][0].as_py()
    shares = rows.filter(pc.is_valid(rows["term"]))
    at = pc.index_in(shares["source"], marks["source"].combine_chunks()).to_numpy()
    places = shares["term"].combine_chunks().dictionary_encode()
    width = len(places.dictionary)
    matrix = np.repeat(absent[:, None], width, axis=1)
    matrix[at, places.indices.to_numpy()] = shares["p"].to_numpy()
    left, right = np.flatnonzero(blocks == one), np.flatnonzero(blocks == other)
    sources, items, values = [], [], []
    # The first term block also brings the difference over all terms as if absent from both.
    base = (kinds if number == 0 else 0) - width
    for a in left:
        of = right[right != a]
        value = np.abs(matrix[of] - matrix[a]).sum(axis=1) + base * np.abs(absent[of] - absent[a])
        if one == other:
            sources += [names[a]] * len(of)
            items += [names[b] for b in of]
            values += value.tolist()
        else:
            for b, v in zip(of, value.tolist(), strict=True):
                sources += [names[a], names[b]]
                items += [names[b], names[a]]
                values += [v, v]
    return pa.table([pa.array([lang] * len(values), pa.string()), pa.array(sources, pa.string()), pa.array(items, pa.string()), pa.array(values, pa.int64())], schema=_PARTIAL)


def _pair_divergences(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two groups of a language, by the cube.

    ``groups`` has lang, source, absent, kinds, group_blocks and term_blocks; ``shares`` has these and term and p.
    """
    long = F.lit(0).cast("long")
    block = F.pmod(F.xxhash64("source"), F.col("group_blocks")).alias("block")
    columns = ["lang", "source", block, "absent", "kinds", "group_blocks"]
    slices = shares.select(*columns, "term", "p", F.pmod(F.xxhash64("term"), F.col("term_blocks")).alias("number"))
    # A group stands in every cell of its block, also where it has no term.
    numbers = F.explode(F.sequence(long, F.col("term_blocks") - 1)).alias("number")
    marks = groups.select(*columns, F.lit(None).cast("string").alias("term"), long.alias("p"), numbers)
    dealt = slices.unionByName(marks).withColumn("with", F.explode(F.sequence(long, F.col("group_blocks") - 1)))
    cells = dealt.withColumns({"one": F.least("block", "with"), "other": F.greatest("block", "with")}).drop("with", "group_blocks")
    partial = cells.groupBy("lang", "one", "other", "number").applyInArrow(_cell, PARTIAL)
    return partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit_sources(
    docs: DataFrame,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    least_docs: int = LEAST_DOCS,
    prior: int = PRIOR,
    top_terms: int = TOP_TERMS,
    groups_a_block: int = GROUPS_A_BLOCK,
    terms_a_block: int = TERMS_A_BLOCK,
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for each group (lang, source).

    Part ``pair`` has a row for every other source of the language: their divergence. Part
    ``term`` has the ``top_terms`` terms that the group uses more than its language, by the
    excess of the share. Both rank from 1, highest value first, ties by the item's bytes.
    A language keeps the terms of at least ``least_docs`` of its documents; without any,
    its sources differ by 0 and have no terms. Null lang, source and text are the empty
    string; repeated rows and ids count as rows. Other columns are not read.
    """
    clean = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = clean.mapInArrow(_term_counts, COUNTS).withColumn("term", F.col("term").cast("string"))
    counts = written(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "audit-counts")
    occurring = counts.where("term is null").select("lang", "source")
    by_lang = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = written(by_lang.where(F.col("docs") >= least_docs).drop("docs"), "audit-terms")
    # Both sides are dealt by (lang, term): no key has more rows than the language has sources.
    present = written(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "audit-present")
    totals = present.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("lang_n").alias("lang_total"))
    sizes = occurring.groupBy("lang").agg(F.count("*").alias("groups")).join(langs, "lang", "left").withColumn("kinds", F.coalesce("kinds", F.lit(0).cast("long")))
    blocks = {
        "group_blocks": F.greatest(F.lit(1).cast("long"), F.ceil(F.col("groups") / groups_a_block)),
        "term_blocks": F.greatest(F.lit(1).cast("long"), F.ceil(F.col("kinds") / terms_a_block)),
    }
    full = occurring.join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
    groups = written(
        full.join(sent_if_small(written(sizes, "audit-langs"), MOST_SENT), "lang").withColumns(blocks)
        .withColumn("absent", F.coalesce(share(F.lit(0).cast("long"), "total", "kinds", prior), F.lit(0).cast("long"))),
        "audit-groups",
    )
    shares = present.join(sent_if_small(groups, MOST_SENT), ["lang", "source"]).withColumn("p", share("n", "total", "kinds", prior))
    pairs = _pair_divergences(shares, groups).withColumn("part", F.lit("pair"))
    above = shares.withColumn("value", F.col("p") - share("lang_n", "lang_total", "kinds", prior)).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(order)
    terms_ = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", ranked).where(F.col("rank") <= top_terms)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", ranked).select(*columns).unionAll(terms_.select(*columns))
