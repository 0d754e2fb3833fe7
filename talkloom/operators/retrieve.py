"""Exact vector retrieval: queries against passages, by cosine or squared distance.

Queries are ``(query_id, embedding)``, passages ``(pos, text, embedding)``. Scores are made
from ``pos`` and the vector alone; texts are joined to the survivors only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom.functions.plugins import Encoder, embedding
from talkloom.functions.prompts import query_instruction
from talkloom.functions.strings import route_by_length
from talkloom.plans.gathering import Join, Texts, bytes_per_query, scored_texts_per_query, texts_per_query, with_rows
from talkloom.plans.numbering import number_rows
from talkloom.plans.pivots import PivotIndex
from talkloom.plans.ranking import ranked_pairs
from talkloom.plans.scoring import score_pairs
from talkloom.sources.scratch import written


# Rows of ids and scores that are sent to all tasks: some 100 MB.
SENT_ROWS = 1_000_000


def embed_passages(passages: DataFrame, encoder: Callable[[], Encoder]) -> DataFrame:
    """Add ``embedding``; store the result once instead of encoding per query."""
    return passages.withColumn("embedding", embedding(F.col("text"), encoder))


def embed_queries(queries: DataFrame, encoder: Callable[[], Encoder]) -> DataFrame:
    """Add ``embedding`` of ``query`` behind the retrieval instruction."""
    return queries.withColumn("embedding", embedding(query_instruction(F.col("query")), encoder))


def build_flat_index(passages: DataFrame, path: str, append: bool = False) -> None:
    """Store ``(pos, text, embedding)``; appending adds files."""
    passages.select("pos", "text", "embedding").write.mode(
        "append" if append else "errorifexists"
    ).parquet(path)


def load_flat_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("pos long, text string, embedding array<float>").parquet(path)


def _scores(
    queries: DataFrame, passages: DataFrame, metric: str, cut: float, top_k: int | None = None, index: PivotIndex | None = None
) -> DataFrame:
    """Pairs inside the cut; an index of the passages leaves out cells that cannot hold any."""
    if index is None:
        return score_pairs(queries, passages, metric, cut=cut, top_k=top_k)
    if index.metric != metric:
        raise ValueError(f"the index is for {index.metric}, not for {metric}")
    return index.search(queries, cut, top_k)


def cosine_scores(
    queries: DataFrame,
    passages: DataFrame,
    at_least: float,
    index: PivotIndex | None = None,
    top_k: int | None = None,
    ranked: bool = False,
) -> DataFrame:
    """``(query_id, pos, sim)`` of every pair with at least that similarity.

    With ``top_k``, for ``rank_desc`` with the same, every pair is scored, but a task gives only its best k of a query.
    With ``ranked``, for ``rank_desc`` without a ``top_k``, the task that scores a query against all passages adds ``rank``.
    """
    if ranked:
        if index is not None or top_k is not None:
            raise ValueError("ranked scores are of all passages: no index, no top_k")
        return ranked_pairs(queries, passages, "cosine", at_least).withColumnRenamed("score", "sim")
    return _scores(queries, passages, "cosine", at_least, top_k, index).withColumnRenamed("score", "sim")


def rank_desc(scores: DataFrame, top_k: int | None = None) -> DataFrame:
    """Add ``rank`` from 1 per query, best first, ties by ``pos``.

    With ``top_k`` Spark prunes to k rows per query before the shuffle. A ``rank`` that ``cosine_scores`` made is kept. Any other
    full ranking
    numbers all rows at once in (query, rank) order, so a query that matches much of
    the corpus is spread over tasks.
    """
    if "rank" in scores.columns:
        return scores if top_k is None else scores.filter(F.col("rank") <= top_k)
    return _ranked(scores, [F.desc("sim"), "pos"], top_k)


def _ranked(scores: DataFrame, order: list[str | Column], top_k: int | None) -> DataFrame:
    """Add ``rank`` from 1 per query in the given order."""
    if top_k is not None:
        best = Window.partitionBy("query_id").orderBy(*order)
        ranked = scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k)
        return ranked.withColumn("rank", F.col("rank").cast("long"))
    # Stored first: the sampling of the range bounds would make the scores a second time.
    stored = written(scores, "scores")
    numbered = number_rows(stored, ["query_id", *order], "_number")
    starts = numbered.groupBy("query_id").agg(F.min("_number").alias("_first"))
    return (
        numbered.join(starts, "query_id")
        .withColumn("rank", F.col("_number") - F.col("_first") + 1)
        .drop("_number", "_first")
    )


def best_match(
    queries: DataFrame, passages: DataFrame, threshold: float = 0.6, index: PivotIndex | None = None
) -> DataFrame:
    """``(query_id, knowledge)``: the closest passage if its similarity reaches the threshold."""
    scored = _scores(queries, passages, "cosine", threshold, 1, index)
    best = scored.groupBy("query_id").agg(
        F.max_by("pos", F.struct("score", (-F.col("pos")).alias("early"))).alias("pos")
    )
    found = _with_texts(best, passages).withColumnRenamed("text", "knowledge")
    return _per_query(queries.select("query_id"), found)


def threshold_matches(
    queries: DataFrame,
    passages: DataFrame,
    threshold: float = 0.7,
    index: PivotIndex | None = None,
    asked: DataFrame | None = None,
    texts: Texts | None = None,
) -> DataFrame:
    """``(query_id, knowledge)``: all passages above the threshold, best first, numbered.

    The result of a query is one string, so its matches meet in one row by definition;
    ``rank_desc`` over ``cosine_scores`` gives them as rows. With ``asked(query_id, ...)`` its rows come out with
    ``knowledge``, as a join would give them, but no knowledge is shuffled. ``texts`` are those of the passages, if there already.
    """
    if index is None:
        return _scored_knowledge(queries, passages, "cosine", threshold, numbered_texts, asked, texts)
    scored = _scores(queries, passages, "cosine", threshold, index=index)
    above = scored.filter(F.col("score") > threshold).select("query_id", "pos", (-F.col("score")).alias("far"))
    return _knowledge(queries, above, passages, numbered_texts, asked, texts)


MODES = {"single": best_match, "multi": threshold_matches}


def retrieve_by_cosine(queries: DataFrame, passages: DataFrame, mode: str, **options) -> DataFrame:
    """``single`` or ``multi`` retrieval; any other mode is an error when the plan is made."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; use one of {sorted(MODES)}")
    return MODES[mode](queries, passages, **options)


def l2_range_matches(
    queries: DataFrame, passages: DataFrame, radius: float, k: int | None = None, index: PivotIndex | None = None
) -> DataFrame:
    """``(query_id, pos, distance, rank)``: the passages nearer than ``radius``, from rank 1.

    The distance is the squared L2 distance. All of them come out unless ``k`` is given.
    """
    if k is None and index is None:
        return ranked_pairs(queries, passages, "l2", radius).withColumnRenamed("score", "distance")
    scored = _scores(queries, passages, "l2", radius, k, index)
    return _ranked(scored.withColumnRenamed("score", "distance"), ["distance", "pos"], k)


def l2_range_context(
    queries: DataFrame,
    passages: DataFrame,
    radius: float,
    k: int | None = None,
    index: PivotIndex | None = None,
    asked: DataFrame | None = None,
    texts: Texts | None = None,
) -> DataFrame:
    """``(query_id, knowledge)``: texts nearer than ``radius``, nearest first, without a separator.

    A query's texts meet in one row by definition; ``k`` keeps the nearest only, and
    ``l2_range_matches`` gives them as rows. ``asked`` and ``texts`` are as for ``threshold_matches``.
    """
    if k is None and index is None:
        return _scored_knowledge(queries, passages, "l2", radius, plain_texts, asked, texts)
    scored = _scores(queries, passages, "l2", radius, k, index)
    if k is None:
        return _knowledge(queries, scored.withColumnRenamed("score", "far"), passages, plain_texts, asked, texts)
    scored = _ranked(scored, ["score", "pos"], k).drop("rank")
    matched = _with_texts(scored, passages)
    ordered = F.transform(
        F.sort_array(F.collect_list(F.struct("score", "pos", "text"))), lambda m: m["text"]
    )
    found = matched.groupBy("query_id").agg(F.array_join(ordered, "").alias("knowledge"))
    return _per_query(queries.select("query_id") if asked is None else asked, found)


def route_retrieval(
    queries: DataFrame,
    long_passages: DataFrame,
    short_passages: DataFrame,
    limit: int = 512,
    threshold: float = 0.6,
    *,
    radius: float,
    k: int | None = None,
    asked: DataFrame | None = None,
    texts: Texts | None = None,
) -> DataFrame:
    """``(query_id, route, knowledge)``: long queries by distance, the others by cosine.

    ``asked(query_id, ...)``, stored, and ``texts``, of the long passages, are as for ``threshold_matches``.
    """
    # Both branches read the queries several times, but never their texts.
    routed = written(
        queries.select(
            "query_id", route_by_length(F.col("query"), limit).alias("route"), "embedding"
        ),
        "queries",
    )
    by_distance = routed.filter(F.col("route") == "l2").select("query_id", "embedding")
    by_cosine = routed.filter(F.col("route") == "cosine").select("query_id", "embedding")
    far = None if asked is None else written(asked.join(by_distance.select("query_id"), "query_id"), "asked")
    near = l2_range_context(by_distance, long_passages, radius, k, asked=far, texts=texts)
    best = best_match(by_cosine, short_passages, threshold)
    if asked is not None:
        best = asked.join(best, "query_id")
    routes = near.withColumn("route", F.lit("l2")).unionByName(best.withColumn("route", F.lit("cosine")))
    return routes.select(*(["query_id"] if asked is None else asked.columns), "route", "knowledge")


def with_fallback(asked: DataFrame, fallback: DataFrame) -> DataFrame:
    """``asked(query_id, ...)`` with ``_spare`` from ``fallback(query_id, text)``, for ``knowledge_or_fallback``."""
    return asked.join(fallback.select("query_id", F.col("text").alias("_spare")), "query_id", "left")


def knowledge_or_fallback(knowledge: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Fill empty ``knowledge`` from ``fallback(query_id, text)``, made by a generator outside.

    Without ``fallback``, ``knowledge`` was asked for with the rows of ``with_fallback``.
    """
    found: Column = F.nullif(F.col("knowledge"), F.lit(""))
    spared = knowledge if fallback is None else with_fallback(knowledge, fallback)
    return spared.withColumn("knowledge", F.coalesce(found, F.col("_spare"), F.lit(""))).drop("_spare")


def _with_texts(found: DataFrame, passages: DataFrame) -> DataFrame:
    """Join the passages' texts; other passages' texts are not shuffled where ``found`` is small."""
    stored = written(found, "found")
    if stored.count() <= SENT_ROWS:
        stored = F.broadcast(stored)
    return passages.select("pos", "text").join(stored, "pos")


def numbered_texts() -> Join:
    """A query's texts numbered by rank, a line each; a null text has a number but no line."""

    def join(texts: list[bytes | None], ranks: list[int]) -> Iterator[tuple[bytes]]:
        yield (b"\n".join(f"背景知识{n}:".encode() + t for t, n in zip(texts, ranks) if t is not None),)

    return join


def plain_texts() -> Join:
    """A query's texts without a separator."""

    def join(texts: list[bytes | None], ranks: list[int]) -> Iterator[tuple[bytes]]:
        yield (b"".join(t for t in texts if t is not None),)

    return join


def _knowledge(
    queries: DataFrame,
    found: DataFrame,
    passages: DataFrame,
    join: Callable[[], Join],
    asked: DataFrame | None = None,
    texts: Texts | None = None,
) -> DataFrame:
    """``asked`` with ``knowledge`` of ``found(query_id, pos, far)``: nothing found is the empty string. Without it, the ids of ``queries``."""
    asked = queries.select("query_id") if asked is None else asked
    texts = texts or Texts(passages)
    placed = texts.placed(written(found, "found"))
    sizes = bytes_per_query(placed)
    known = texts_per_query(placed, with_rows(sizes, asked), asked, texts, join, "knowledge string")
    nothing = asked.join(sizes.select("query_id"), "query_id", "left_anti")
    return known.unionByName(nothing.withColumn("knowledge", F.lit("")))


def _scored_knowledge(
    queries: DataFrame, passages: DataFrame, metric: str, cut: float, join: Callable[[], Join], asked: DataFrame | None, texts: Texts | None
) -> DataFrame:
    """As ``_knowledge`` of the passages above a cosine of ``cut``, or nearer than it, which are scored where their texts are put together."""
    asked = queries.select("query_id") if asked is None else asked
    texts = texts or Texts(passages, scored=True)
    known, found = scored_texts_per_query(queries, asked, texts, metric, cut, join, "knowledge string")
    nothing = asked.join(found.select("query_id"), "query_id", "left_anti")
    return known.unionByName(nothing.withColumn("knowledge", F.lit("")))


def _per_query(asked: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``asked``; nothing found is the empty string."""
    return asked.join(found.select("query_id", "knowledge"), "query_id", "left").withColumn(
        "knowledge", F.coalesce("knowledge", F.lit(""))
    )
