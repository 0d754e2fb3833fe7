"""Passages from paragraphs, pages and lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions.rows import exploded
from talkloom.functions.strings import split_lines
from talkloom.plans.segments import has_long_groups, null_safe_join, segment_of
from talkloom.sources.scratch import written


def packed(
    paragraphs: Column,
    keep_tail: bool = False,
    min_len: int = 1,
    flush: int = 150,
    separator: str = "\n",
) -> Column:
    """Passages of one document held as an array of paragraphs.

    Paragraphs of up to ``min_len`` characters are skipped; the others are joined until a
    passage is longer than ``flush``. The passage still open at the end is not given out,
    unless ``keep_tail`` is set.

    One linear regular expression pass: ``flush + 1`` characters, then the rest of the
    paragraph reached, then proof that another one follows. ``\\G`` ties each match to the
    end of the last. Paragraphs that hold the separator themselves take the fold instead.
    """
    sep = "\\x{%x}" % ord(separator)
    body = rf"(?:{sep}?+[^{sep}]){{{flush + 1}}}[^{sep}]*+(?={sep})"
    pattern = rf"\G{body}" if not keep_tail else rf"\G(?:{body}|(?s:.+)\z)"

    def passages(kept: Column) -> Column:
        found = F.regexp_extract_all(F.array_join(kept, separator), F.lit(pattern), F.lit(0))
        by_match = F.transform(found, lambda t: F.replace(t, F.lit(separator), F.lit("")))
        holds = F.contains(F.array_join(kept, ""), F.lit(separator))
        return F.when(holds, _folded(kept, keep_tail, flush)).otherwise(by_match)

    # The outer one-element array makes the filtered paragraphs once for all their uses.
    kept = F.filter(paragraphs, lambda p: F.length(p) > min_len)
    return F.get(F.transform(F.array(kept), passages), 0)


def _folded(kept: Column, keep_tail: bool, flush: int) -> Column:
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, paragraph: Column) -> Column:
        full = F.length(state["open"]) > flush
        done = F.when(full, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])
        left = F.when(full, paragraph).otherwise(F.concat(state["open"], paragraph))
        return F.struct(done.alias("done"), left.alias("open"))

    def finish(state: Column) -> Column:
        if not keep_tail:
            return state["done"]
        tail = F.when(state["open"] == "", F.array().cast("array<string>")).otherwise(
            F.array(state["open"])
        )
        return F.concat(state["done"], tail)

    return F.aggregate(kept, start, step, finish)


def pack_paragraphs(
    docs: DataFrame, key: str, paragraphs: Column, keep_tail: bool = False, **limits
) -> DataFrame:
    """``(key, chunk_pos, text)`` of documents that hold their paragraphs in one row. No shuffle."""
    passages = packed(paragraphs, keep_tail, **limits)
    return exploded(docs, key, passages, "chunk_pos", "text")


def pack_paragraph_rows(
    rows: DataFrame,
    key: str,
    pos: str = "pos",
    text: str = "text",
    keep_tail: bool = False,
    min_len: int = 1,
    flush: int = 150,
    segment: int = 1024,
    run: int = 1024,
) -> DataFrame:
    """The same passages from one row per paragraph, for documents of any length.

    How a stretch of paragraphs is packed depends on what came before only through the
    length of the open passage, which has ``flush + 2`` cases. So each segment of a long
    document is reduced to a small table, case in to case out; chaining these tables
    gives the case each segment starts with, and the segments are packed side by side.
    Documents within the first segment need no table. If all are, each is packed as one row.
    """
    kept = rows.select(
        F.col(key).alias("_key"), F.col(pos).alias("_pos"), F.col(text).alias("_text")
    ).filter(F.length("_text") > min_len)
    kept = kept.withColumn("_seg", segment_of("_pos", segment))

    gathered = F.sort_array(F.collect_list(F.struct("_pos", "_text"))).alias("paragraphs")
    if not has_long_groups(rows, pos, segment):
        docs = kept.groupBy("_key").agg(gathered).withColumnRenamed("_key", key)
        return pack_paragraphs(
            docs, key, F.col("paragraphs._text"), keep_tail, min_len=min_len, flush=flush
        )
    starts = _segment_starts(rows, kept, key, pos, flush, segment, run)
    opened = null_safe_join(kept.groupBy("_key", "_seg").agg(gathered), starts, ["_key", "_seg"], "left")
    opened = opened.withColumns(
        {
            "_size": F.coalesce("_size", F.lit(0)),
            "_given": F.coalesce("_given", F.lit(0).cast("long")),
        }
    )
    sizes = F.transform("paragraphs", lambda p: F.length(p["_text"]))
    chunks = _chunk_numbers(flush)(sizes, F.col("_size"), F.col("_given"))
    placed = opened.select("_key", "_given", "paragraphs", chunks.alias("chunks"))
    # A paragraph that opens passage c proves that passage c - 1 is complete.
    pieces = placed.select(
        "_key",
        F.explode(
            F.flatten(
                F.transform(
                    "paragraphs",
                    lambda p, i: F.when(
                        F.get("chunks", i) > F.coalesce(F.get("chunks", i - 1), F.col("_given")),
                        F.array(
                            _piece(F.get("chunks", i), p["_pos"], p["_text"], False),
                            _piece(F.get("chunks", i) - 1, F.lit(None), F.lit(None), True),
                        ),
                    ).otherwise(F.array(_piece(F.get("chunks", i), p["_pos"], p["_text"], False))),
                )
            )
        ).alias("piece"),
    ).select("_key", "piece.*")
    merged = pieces.groupBy("_key", "chunk_pos").agg(
        F.sort_array(
            F.collect_list(F.when(~F.col("closed"), F.struct("pos", "text")))
        ).alias("parts"),
        F.max("closed").alias("closed"),
    )
    if not keep_tail:
        merged = merged.filter("closed")
    return merged.select(
        F.col("_key").alias(key),
        "chunk_pos",
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"),
    )


def _segment_starts(rows, kept, key, pos, flush, segment, run) -> DataFrame:
    """``(_key, _seg, _size, _given)``: what is open where each segment of a long document starts."""
    # Reads no text: a document is long by its positions.
    large = rows.filter(F.col(pos) >= segment).select(F.col(key).alias("_key")).distinct()
    sizes = kept.select("_key", "_seg", "_pos", F.length("_text").alias("n"))
    lengths = (
        null_safe_join(sizes, large, ["_key"], "left_semi")
        .groupBy("_key", "_seg")
        .agg(F.sort_array(F.collect_list(F.struct("_pos", "n"))).alias("ns"))
    )
    tables = lengths.select("_key", "_seg", _case_table(flush)(F.col("ns.n")).alias("table"))
    tables = tables.select("_key", "_seg", "table.size", "table.given")
    # Chained in two levels, so that no task holds more than a short run of tables.
    grouped = tables.withColumn("_run", segment_of("_seg", run))
    key_type = kept.schema["_key"].dataType.simpleString()
    runs = grouped.groupBy("_key", "_run").applyInPandas(
        _compose, f"_key {key_type}, _run long, size array<int>, given array<long>"
    )
    run_starts = runs.groupBy("_key").applyInPandas(
        _chain("_run"), f"_key {key_type}, _run long, _size int, _given long"
    )
    return (
        null_safe_join(grouped, run_starts, ["_key", "_run"], "inner")
        .groupBy("_key", "_run")
        .applyInPandas(_chain("_seg"), f"_key {key_type}, _seg long, _size int, _given long")
    )


def _piece(chunk: Column, pos: Column, text: Column, closed: bool) -> Column:
    return F.struct(
        chunk.alias("chunk_pos"),
        pos.cast("long").alias("pos"),
        text.cast("string").alias("text"),
        F.lit(closed).alias("closed"),
    )


def _case_table(flush: int):
    """For one segment: from each length of the open passage, the length and passages after it."""

    @F.pandas_udf("size array<int>, given array<long>")
    def table(segments: pd.Series) -> pd.DataFrame:
        sizes, givens = [], []
        for lengths in segments:
            size = np.arange(flush + 2)
            given = np.zeros(flush + 2, "int64")
            for n in np.minimum(lengths, flush + 1):
                full = size > flush
                given += full
                size = np.where(full, n, np.minimum(size + n, flush + 1))
            sizes.append(size)
            givens.append(given)
        return pd.DataFrame({"size": sizes, "given": givens})

    return table


def _chunk_numbers(flush: int):
    """The passage each paragraph of a segment goes to, given what is open at its start."""

    @F.pandas_udf("array<long>")
    def number(segments: pd.Series, size: pd.Series, given: pd.Series) -> pd.Series:
        out = []
        for lengths, length, chunk in zip(segments, size, given):
            chunks = []
            for n in lengths:
                if length > flush:
                    length, chunk = 0, chunk + 1
                length += n
                chunks.append(chunk)
            out.append(chunks)
        return pd.Series(out, dtype="object")

    return number


def _compose(tables: pd.DataFrame) -> pd.DataFrame:
    """One table for a run of segments."""
    tables = tables.sort_values("_seg")
    size, given = np.arange(len(tables["size"].iloc[0])), 0
    for out_size, out_given in zip(tables["size"], tables["given"]):
        given = given + out_given[size]
        size = out_size[size]
    first = tables.iloc[0]
    return pd.DataFrame(
        {"_key": [first["_key"]], "_run": [first["_run"]], "size": [size], "given": [given]}
    )


def _chain(order: str):
    """Walk tables in order, from the start given with them or from an empty passage."""

    def walk(tables: pd.DataFrame) -> pd.DataFrame:
        tables = tables.sort_values(order)
        size, given = 0, 0
        if "_size" in tables:
            size, given = int(tables["_size"].iloc[0]), int(tables["_given"].iloc[0])
        sizes, givens = [], []
        for out_size, out_given in zip(tables["size"], tables["given"]):
            sizes.append(size)
            givens.append(given)
            size, given = int(out_size[size]), given + int(out_given[size])
        return pd.DataFrame(
            {"_key": tables["_key"], order: tables[order], "_size": sizes, "_given": givens}
        )

    return walk


def page_passages(pages: DataFrame, key: str, page_no: str, text: str) -> DataFrame:
    """One passage per page, empty pages included."""
    return pages.select(key, F.col(page_no).cast("long").alias("chunk_pos"), F.col(text).alias("text"))


def line_passages(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One passage per line of texts held in a column; a final newline opens no line."""
    body = F.col(text)
    cut = (
        F.when(F.endswith(body, F.lit("\r\n")), 2)
        .when(F.endswith(body, F.lit("\n")) | F.endswith(body, F.lit("\r")), 1)
        .otherwise(0)
    )
    lines = F.when(F.length(body) > 0, split_lines(F.left(body, F.length(body) - cut)))
    return exploded(docs, key, lines, "chunk_pos", "text")


def build_corpus(units: DataFrame, lines: DataFrame, keep_tail: bool = False) -> DataFrame:
    """One corpus ``(file, kind, chunk_pos, text)`` of packed paragraphs, pages and lines.

    ``units`` are parsed files: kind ``docx`` rows are paragraphs, ``pdf`` rows are pages.
    They are stored first, so that no file is parsed twice. Other kinds have no rule and
    are an error.
    """
    units = written(units, "units")
    other = units.filter(~F.coalesce(F.col("kind").isin("docx", "pdf"), F.lit(False))).select("kind").first()
    if other is not None:
        raise ValueError(f"no rule for files of kind {other.kind!r}")
    packed_rows = pack_paragraph_rows(
        units.filter(F.col("kind") == "docx"), "file", keep_tail=keep_tail
    )
    pages = page_passages(units.filter(F.col("kind") == "pdf"), "file", "pos", "text")
    text_lines = lines.select("file", F.col("pos").alias("chunk_pos"), "text")
    return (
        packed_rows.withColumn("kind", F.lit("docx"))
        .unionByName(pages.withColumn("kind", F.lit("pdf")))
        .unionByName(text_lines.withColumn("kind", F.lit("txt")))
        .select("file", "kind", "chunk_pos", "text")
    )
