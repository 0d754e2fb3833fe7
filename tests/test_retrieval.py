"""Scores and retrieved texts against brute force, at the thresholds and with ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkloom.functions import vectors as V
from talkloom.operators import retrieve as R
from talkloom.plans.scoring import score_pairs

BLOCKS = [64 << 20, 400]  # one broadcast block, or a grid of blocks


def tables(spark, seed=0, n_q=37, n_p=151, dim=8, copies=50):
    """Random vectors; a third of the passages are copies of one, and one of each side is zero."""
    rng = np.random.default_rng(seed)
    q = rng.integers(-3, 4, (n_q, dim)).astype(float)
    p = rng.integers(-3, 4, (n_p, dim)).astype(float)
    p[:copies] = p[0]
    q[1] = 0
    p[copies + 1] = 0
    queries = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<float>")
    passages = spark.createDataFrame(
        [(i, f"t{i}", v.tolist()) for i, v in enumerate(p)],
        "pos long, text string, embedding array<float>").repartition(3)
    return q, p, queries, passages


def cosines(q, p):
    with np.errstate(all="ignore"):
        unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
        return unit(q) @ unit(p).T


@pytest.mark.parametrize("block_bytes", BLOCKS)
def test_pairs_above_a_cut(spark, block_bytes):
    q, p, queries, passages = tables(spark)
    got = score_pairs(queries, passages, cut=0.35, block_bytes=block_bytes)
    rows = {(r.query_id, r.pos): r.score for r in got.collect()}
    sims = cosines(q, p)
    expected = {(i, j): sims[i, j] for i, j in zip(*np.nonzero(sims >= 0.35))}
    assert rows.keys() == expected.keys()
    assert all(abs(rows[k] - expected[k]) < 1e-12 for k in rows)


@pytest.mark.parametrize("block_bytes", BLOCKS)
@pytest.mark.parametrize("k", [1, 4, 60])
def test_top_k_keeps_ties_by_position(spark, block_bytes, k):
    q, p, queries, passages = tables(spark)
    scored = score_pairs(queries, passages, "l2", top_k=k, block_bytes=block_bytes)
    rows = scored.orderBy("query_id", "score", "pos").collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r.score, r.pos))
    d = ((q[:, None] - p[None]) ** 2).sum(-1)
    for i in range(len(q)):
        expected = sorted(zip(d[i], range(len(p))))[:k]
        assert got[i][:k] == expected


def test_a_small_block_drops_no_top_k(spark):
    _, _, queries, passages = tables(spark)
    whole = score_pairs(queries, passages, "l2", cut=1e9, top_k=5)
    blocks = score_pairs(queries, passages, "l2", cut=1e9, top_k=5, block_bytes=40_000)

    def best(scored):
        ranked = {}
        for r in scored.orderBy("query_id", "score", "pos").collect():
            ranked.setdefault(r.query_id, []).append((r.pos, r.score))
        return {query: rows[:5] for query, rows in ranked.items()}

    assert best(whole) == best(blocks)
    # A task or cell gives out no more than top_k rows for a query; 150 passages make few cells here.
    assert blocks.count() < queries.count() * 75


def test_column_form_agrees(spark):
    _, _, queries, passages = tables(spark)
    pairs = score_pairs(queries, passages, cut=-1.0)
    joined = (
        pairs.join(queries.withColumnRenamed("embedding", "a"), "query_id")
        .join(passages.withColumnRenamed("embedding", "b"), "pos")
    )
    off = joined.filter(F.abs(V.cosine(F.col("a"), F.col("b")) - F.col("score")) > 1e-12)
    assert off.count() == 0 and joined.count() == 36 * 150
    unit = queries.select(V.l2_normalize(F.col("embedding")).alias("u"))
    assert unit.filter("u is null").count() == 1
    assert unit.filter(F.abs(V.norm(F.col("u")) - 1) > 1e-12).count() == 0


def test_needs_a_cut_or_k(spark):
    _, _, queries, passages = tables(spark)
    with pytest.raises(ValueError):
        score_pairs(queries, passages)
    with pytest.raises(ValueError):
        score_pairs(queries, passages, "dot", cut=0.1)


@pytest.mark.parametrize("top_k", [None, 5])
def test_rank(spark, top_k):
    q, p, queries, passages = tables(spark)
    ranked = R.rank_desc(R.cosine_scores(queries, passages, 0.2), top_k).collect()
    got = {}
    for r in ranked:
        got.setdefault(r.query_id, {})[r.rank] = (-r.sim, r.pos)
    for ranks in got.values():
        assert sorted(ranks) == list(range(1, len(ranks) + 1))
        assert [ranks[i] for i in sorted(ranks)] == sorted(ranks.values())


def exact(spark):
    """Similarities of exactly 0.6, 0.7 and 0.8 with the query (1, 0, 0)."""
    query = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 1.0]), (3, None)],
                                  "query_id long, embedding array<double>")
    rows = [(0, "six", [3.0, 4.0, 0.0]), (1, "seven", [7.0, float(np.sqrt(51)), 0.0]),
            (2, "eight", [4.0, -3.0, 0.0]), (3, "eight again", [8.0, -6.0, 0.0])]
    return query, spark.createDataFrame(rows, "pos long, text string, embedding array<double>")


def test_single_mode_is_inclusive_and_breaks_ties(spark):
    query, passages = exact(spark)
    best = lambda df, t: {r.query_id: r.knowledge for r in
                          R.retrieve_by_cosine(query, df, "single", threshold=t).collect()}
    assert best(passages, 0.6) == {1: "eight", 2: "", 3: ""}
    assert best(passages.filter("pos = 0"), 0.6) == {1: "six", 2: "", 3: ""}
    assert best(passages, 0.81) == {1: "", 2: "", 3: ""}


def test_multi_mode_is_exclusive_and_numbered(spark):
    query, passages = exact(spark)
    got = {r.query_id: r.knowledge for r in
           R.retrieve_by_cosine(query, passages, "multi", threshold=0.6).collect()}
    assert got == {1: "背景知识1:eight\n背景知识2:eight again\n背景知识3:seven", 2: "", 3: ""}
    with pytest.raises(ValueError):
        R.retrieve_by_cosine(query, passages, "other")


def test_range_context(spark):
    query = spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, embedding array<double>")
    rows = [(0, "c", [3.0, 0.0]), (1, "b", [0.0, 2.0]), (2, "a", [1.0, 0.0]), (3, "b2", [2.0, 0.0])]
    passages = spark.createDataFrame(rows, "pos long, text string, embedding array<double>")
    text = lambda **o: R.l2_range_context(query, passages, **o).first().knowledge
    assert text(radius=1e7) == "abb2c"
    assert text(radius=9.0) == "abb2"
    assert text(radius=9.5, k=2) == "ab"
    assert text(radius=1.0) == ""
    near = R.l2_range_matches(query, passages, radius=9.0).collect()
    assert sorted((r.rank, r.pos, r.distance) for r in near) == [(1, 2, 1.0), (2, 1, 4.0), (3, 3, 4.0)]


def test_range_query_joins_all_in_the_radius(spark, monkeypatch):
    from suite import retrieval as Q

    query = spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, embedding array<double>")
    rows = [(i, f"t{i}", [0.1 * i, 0.0]) for i in range(1, 16)]
    passages = spark.createDataFrame(rows, "pos long, text string, embedding array<double>")
    monkeypatch.setattr(Q.I, "question_vectors", lambda *_: query)
    monkeypatch.setattr(Q.I, "passages", lambda *_: passages)
    # The squared distance of the fifteenth is 2.25. Only the nearest five were joined before.
    assert Q.r8_l2_range(spark, "").first().knowledge == "".join(f"t{i}" for i in range(1, 15))


def test_routes_and_fallback(spark):
    query, passages = exact(spark)
    asked = query.withColumn("query", F.when(F.col("query_id") == 1, "x" * 513).otherwise("x" * 512))
    got = {r.query_id: (r.route, r.knowledge) for r in
           R.route_retrieval(asked, passages, passages, radius=30.0).collect()}
    assert got == {1: ("l2", "eightsix"), 2: ("cosine", ""), 3: ("cosine", "")}
    found = R.threshold_matches(query, passages, 0.75)
    spare = spark.createDataFrame([(1, "unused"), (2, "made up")], "query_id long, text string")
    filled = {r.query_id: r.knowledge for r in R.knowledge_or_fallback(found, spare).collect()}
    assert filled == {1: "背景知识1:eight\n背景知识2:eight again", 2: "made up", 3: ""}


def test_encoders_and_stored_index(spark, tmp_path):
    def sizes():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(0, "ab"), (1, None)], "pos long, text string")
    R.build_flat_index(R.embed_passages(df, sizes), str(tmp_path / "i"))
    R.build_flat_index(R.embed_passages(df.withColumn("pos", F.col("pos") + 2), sizes),
                       str(tmp_path / "i"), append=True)
    rows = R.load_flat_index(spark, str(tmp_path / "i")).orderBy("pos").collect()
    assert [(r.pos, r.embedding) for r in rows] == [(0, [2.0, 1.0]), (1, None), (2, [2.0, 1.0]), (3, None)]
    asked = R.embed_queries(spark.createDataFrame([("ab",)], "query string"), sizes).first()
    assert asked.embedding[0] == 2 + len("为这个句子生成表示，用于检索相关文章：")
