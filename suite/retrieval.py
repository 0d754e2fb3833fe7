"""Vectors, scores, and retrieval of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import inputs as I
from suite.sql import DISTANCES, DISTANCES_ONLY, PASSAGES, QUESTIONS, SIMS
from talkloom.functions import vectors as V
from talkloom.operators import contexts as C
from talkloom.operators import retrieve as R
from talkloom.operators.stores import EmbeddingStore, FlatIndex
from talkloom.plans.pivots import pivot_index
from talkloom.sources.scratch import scratch_path, written

NEAR = 0.3
CHUNK = 10_000


def letter_encoder():
    """A stand-in encoder: how often each residue of the code points modulo 16 occurs."""
    import numpy as np

    def encode(texts):
        return [
            np.bincount([ord(c) % 16 for c in t], minlength=16).tolist() if t else [0] * 16
            for t in texts
        ]

    return encode


def r1_embed(spark, sf_dir):
    queries = I.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    return R.embed_queries(queries, letter_encoder).select(
        "item_id", F.posexplode("embedding").alias("dim", "value")
    ).select("item_id", F.col("dim").cast("long").alias("dim"), F.col("value").cast("long").alias("n"))


def r1_embed_store(spark, sf_dir):
    """Every turn's text from a store that already holds half of them; each text is encoded once."""
    turns = I.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    store = EmbeddingStore(spark, scratch_path(spark, "embeddings"), "letters of 16 kinds")
    store.fill(turns.where("turn % 2 = 0"), letter_encoder)
    dims = store.embed(turns, letter_encoder).select("conv_id", "turn", F.posexplode("embedding").alias("dim", "value"))
    return dims.select("conv_id", "turn", F.col("dim").cast("long").alias("dim"), F.col("value").cast("long").alias("n"))


def r2_normalize(spark, sf_dir):
    unit = I.question_vectors(spark, sf_dir).select(
        "query_id", F.posexplode(V.l2_normalize(F.col("embedding"))).alias("dim", "value")
    )
    return unit.select(
        "query_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value")
    )


def r3_cosine_scores(spark, sf_dir):
    scores = R.cosine_scores(I.question_vectors(spark, sf_dir), I.passage_vectors(spark, sf_dir), NEAR)
    return scores.select("query_id", "pos", F.round("sim", 6).alias("sim"))


def r3_cosine_scores_blocks(spark, sf_dir):
    """The form for two large sides: a small block size forces the grid of blocks."""
    from talkloom.plans.scoring import score_pairs

    scores = score_pairs(
        I.question_vectors(spark, sf_dir),
        I.passage_vectors(spark, sf_dir),
        cut=NEAR,
        block_bytes=1 << 17,
    )
    return scores.select("query_id", "pos", F.round("score", 6).alias("sim"))


def r4_rank(spark, sf_dir):
    scores = R.cosine_scores(I.question_vectors(spark, sf_dir), I.passage_vectors(spark, sf_dir), NEAR, ranked=True)
    return R.rank_desc(scores).select("query_id", "pos", "rank")


def r4_top_k(spark, sf_dir):
    scores = R.cosine_scores(I.question_vectors(spark, sf_dir), I.passage_vectors(spark, sf_dir), NEAR, top_k=3)
    return R.rank_desc(scores, top_k=3).select("query_id", "pos", "rank")


def r5_best_match(spark, sf_dir):
    return R.retrieve_by_cosine(
        I.question_vectors(spark, sf_dir), I.passages(spark, sf_dir), "single"
    )


def _index(spark, sf_dir, metric):
    stored = written(I.passages(spark, sf_dir), "passages")
    return stored, pivot_index(stored.select("pos", "embedding"), metric)


def r5_best_match_pivots(spark, sf_dir):
    """Cells of passages that cannot hold a match are not read."""
    passages, index = _index(spark, sf_dir, "cosine")
    return R.retrieve_by_cosine(I.question_vectors(spark, sf_dir), passages, "single", index=index)


def r6_threshold_matches_pivots(spark, sf_dir):
    passages, index = _index(spark, sf_dir, "cosine")
    return R.retrieve_by_cosine(
        I.question_vectors(spark, sf_dir), passages, "multi", threshold=NEAR, index=index
    )


def r8_l2_range_pivots(spark, sf_dir):
    passages, index = _index(spark, sf_dir, "l2")
    return R.l2_range_context(
        I.question_vectors(spark, sf_dir), passages, radius=2.2, k=5, index=index
    )


def r6_threshold_matches(spark, sf_dir):
    return R.retrieve_by_cosine(
        I.question_vectors(spark, sf_dir), I.passages(spark, sf_dir), "multi", threshold=NEAR
    )


def r6_threshold_chunks(spark, sf_dir):
    """The knowledge of r6_threshold_matches in chunks."""
    return C.threshold_chunks(
        I.question_vectors(spark, sf_dir), I.passages(spark, sf_dir), threshold=NEAR, size=CHUNK
    )


def r8_l2_range_chunks(spark, sf_dir):
    """All that lies in the radius, in chunks."""
    return C.l2_range_chunks(I.question_vectors(spark, sf_dir), I.passages(spark, sf_dir), radius=2.0, size=CHUNK)


def r8_l2_range(spark, sf_dir):
    """Every passage is measured; all that lie in the radius are joined."""
    return R.l2_range_context(I.question_vectors(spark, sf_dir), I.passages(spark, sf_dir), radius=2.2)


def r8_l2_range_rows(spark, sf_dir):
    """The row form, all that lies in the radius."""
    near = R.l2_range_matches(I.question_vectors(spark, sf_dir), I.passages(spark, sf_dir), radius=2.2)
    return near.select("query_id", "pos", "rank")


def r9_index_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "index")
    R.build_flat_index(I.passages(spark, sf_dir), path)
    stored = R.load_flat_index(spark, path)
    return stored.select("pos", "text", F.round(V.norm(F.col("embedding")), 5).alias("norm"))


def r9_index_versions(spark, sf_dir):
    """An index built by commits, one of them repeated; the version before the last is read too."""
    passages = written(I.passages(spark, sf_dir), "passages")
    middle = passages.agg(F.floor((F.min("pos") + F.max("pos")) / 2)).first()[0] or 0
    index = FlatIndex(spark, scratch_path(spark, "versions"))
    first = index.append(passages.where(F.col("pos") <= middle), "first half")
    last = index.append(passages.where(F.col("pos") > middle), "second half")
    index.append(passages.where(F.col("pos") > middle), "second half")
    found = [index.passages(v).withColumn("version", F.lit(v)) for v in (first, last)]
    return found[0].unionByName(found[1]).select(
        "version", "pos", "text", F.round(V.norm(F.col("embedding")), 5).alias("norm")
    )


def _document_queries(spark, sf_dir):
    """Every document as a query, with the question vectors dealt out by id."""
    place, _ = I.vector_place(spark, sf_dir, "doc_id")
    docs = I.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("query_id"), F.col("text").alias("query"), place.alias("place")
    )
    questions = I.question_vectors(spark, sf_dir).withColumnRenamed("query_id", "place")
    return docs.join(questions, "place", "left").drop("place")


def r10_route_retrieval(spark, sf_dir):
    passages = I.passages(spark, sf_dir)
    return R.route_retrieval(
        _document_queries(spark, sf_dir), passages, passages, threshold=0.6, radius=2.0
    )


def r11_fallback(spark, sf_dir):
    found = R.threshold_matches(
        I.question_vectors(spark, sf_dir), I.passages(spark, sf_dir), threshold=0.7
    )
    spare = I.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.knowledge_or_fallback(found, spare)


QUERIES = {
    f.__name__: f
    for f in [
        r1_embed,
        r1_embed_store,
        r2_normalize,
        r3_cosine_scores,
        r3_cosine_scores_blocks,
        r4_rank,
        r4_top_k,
        r5_best_match,
        r5_best_match_pivots,
        r6_threshold_matches,
        r6_threshold_matches_pivots,
        r6_threshold_chunks,
        r8_l2_range,
        r8_l2_range_chunks,
        r8_l2_range_pivots,
        r8_l2_range_rows,
        r9_index_roundtrip,
        r9_index_versions,
        r10_route_retrieval,
        r11_fallback,
    ]
}

TEXT_SIMS = QUESTIONS + "," + PASSAGES + """,
passage_sims AS (
  SELECT query_id, pos, text, list_cosine_similarity(q, v::DOUBLE[]) AS sim FROM questions CROSS JOIN passages
)"""

_NEAR_PAIRS = f"""
WITH {SIMS} SELECT query_id, pos, round(sim, 6) AS sim FROM sims WHERE sim >= 0.3"""


def numbered(threshold: float) -> str:
    return f"""
matches AS (
  SELECT query_id, string_agg('背景知识' || n || ':' || text, chr(10) ORDER BY n) AS knowledge
  FROM (SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, pos) AS n
        FROM passage_sims WHERE sim > {threshold})
  GROUP BY query_id
)"""


BEST = """
best AS (
  SELECT query_id, text AS knowledge FROM (
    SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, pos) AS n
    FROM passage_sims WHERE sim >= 0.6
  ) WHERE n = 1
)"""


def nearest(radius: float, k: int | None = None) -> str:
    limit = f"WHERE n <= {k}" if k else ""
    return f"""
nearest AS (
  SELECT query_id, string_agg(text, '' ORDER BY n) AS knowledge FROM (
    SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY d, pos) AS n
    FROM distances JOIN (SELECT pos, text FROM passages) USING (pos) WHERE d < {radius}
  ) {limit} GROUP BY query_id
)"""


ORACLES = {
    "r1_embed": """
WITH q AS (SELECT item_id, '为这个句子生成表示，用于检索相关文章：' || text AS query FROM benchmark),
marks AS (
  SELECT item_id, unnest(list_transform(range(1, length(query) + 1),
    lambda i: unicode(substring(query, i, 1)) % 16)) AS dim FROM q
),
dims AS (SELECT item_id, unnest(range(0, 16)) AS dim FROM q)
SELECT item_id, dim, (SELECT count(*) FROM marks m WHERE m.item_id = d.item_id AND m.dim = d.dim) AS n
FROM dims d""",
    "r2_normalize": f"""
WITH {QUESTIONS},
normed AS (SELECT query_id, q, sqrt(list_sum(list_transform(q, lambda x: x * x))) AS n FROM questions)
SELECT query_id, unnest(range(0, len(q))) AS dim,
  unnest(list_transform(q, lambda x: round(x / n, 6))) AS value FROM normed""",
    "r3_cosine_scores": _NEAR_PAIRS,
    "r3_cosine_scores_blocks": _NEAR_PAIRS,
    "r4_rank": f"""
WITH {SIMS}
SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, pos) AS rank
FROM sims WHERE sim >= 0.3""",
    "r4_top_k": f"""
WITH {SIMS}
SELECT query_id, pos, rank FROM (
  SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, pos) AS rank
  FROM sims WHERE sim >= 0.3) WHERE rank <= 3""",
    "r5_best_match": f"""
WITH {TEXT_SIMS}, {BEST}
SELECT query_id, coalesce(knowledge, '') AS knowledge FROM questions LEFT JOIN best USING (query_id)""",
    "r6_threshold_matches": f"""
WITH {TEXT_SIMS}, {numbered(0.3)}
SELECT query_id, coalesce(knowledge, '') AS knowledge
FROM questions LEFT JOIN matches USING (query_id)""",
    "r8_l2_range": f"""
WITH {DISTANCES}, {nearest(2.2)}
SELECT query_id, coalesce(knowledge, '') AS knowledge
FROM questions LEFT JOIN nearest USING (query_id)""",
    "r8_l2_range_rows": f"""
WITH {DISTANCES}
SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY d, pos) AS rank
FROM distances WHERE d < 2.2""",
    "r9_index_roundtrip": f"""
WITH {PASSAGES}
SELECT pos, text, round(sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm
FROM passages""",
    "r10_route_retrieval": f"""
WITH {TEXT_SIMS}, {BEST}, {DISTANCES_ONLY}, {nearest(2.0)}
SELECT pos AS query_id, CASE WHEN length(text) > 512 THEN 'l2' ELSE 'cosine' END AS route,
  coalesce(CASE WHEN length(text) > 512 THEN nearest.knowledge ELSE best.knowledge END, '') AS knowledge
FROM placed_docs LEFT JOIN best ON best.query_id = place LEFT JOIN nearest ON nearest.query_id = place""",
    "r11_fallback": f"""
WITH {TEXT_SIMS}, {numbered(0.7)}
SELECT query_id, coalesce(knowledge, text, '') AS knowledge
FROM questions LEFT JOIN matches USING (query_id) LEFT JOIN benchmark ON item_id = query_id""",
}
_CHUNKS = f"""
SELECT query_id, chunk, {CHUNK} * chunk AS "offset", substring(knowledge, {CHUNK} * chunk + 1, {CHUNK}) AS text
FROM (SELECT query_id, knowledge, unnest(range(0, (length(knowledge) + {CHUNK - 1}) // {CHUNK})) AS chunk FROM {{found}})"""

ORACLES |= {
    "r6_threshold_chunks": f"WITH {TEXT_SIMS}, {numbered(NEAR)}" + _CHUNKS.format(found="matches"),
    "r8_l2_range_chunks": f"WITH {DISTANCES}, {nearest(2.0)}" + _CHUNKS.format(found="nearest"),
    "r1_embed_store": """
WITH marks AS (
  SELECT conv_id, turn, unnest(list_transform(string_split(text, ''), lambda c: unicode(c) % 16)) AS dim FROM conversations
),
counts AS (SELECT conv_id, turn, dim, count(*) AS n FROM marks GROUP BY ALL)
SELECT conv_id, turn, dim, coalesce(n, 0) AS n
FROM (SELECT conv_id, turn, unnest(range(0, 16)) AS dim FROM conversations WHERE text IS NOT NULL)
LEFT JOIN counts USING (conv_id, turn, dim)""",
    "r5_best_match_pivots": ORACLES["r5_best_match"],
    "r6_threshold_matches_pivots": ORACLES["r6_threshold_matches"],
    "r8_l2_range_pivots": f"""
WITH {DISTANCES}, {nearest(2.2, 5)}
SELECT query_id, coalesce(knowledge, '') AS knowledge
FROM questions LEFT JOIN nearest USING (query_id)""",
    "r9_index_versions": f"""
WITH {PASSAGES},
ends AS (SELECT (min(pos) + max(pos)) // 2 AS middle FROM passages)
SELECT version, pos, text, round(sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm
FROM passages, ends, (SELECT unnest([1, 2])::INTEGER AS version) WHERE version = 2 OR pos <= middle""",
}
