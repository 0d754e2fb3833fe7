"""How scoring is dealt out: over all cores, in a bounded number of blocks, with one keeper a task."""

import numpy as np
import pytest

from talkloom.operators import retrieve as R
from talkloom.plans import scoring as S
from talkloom.plans.pivots import pivot_index


def frames(spark, q, p):
    rows = lambda vs: [(i, [float(x) for x in v]) for i, v in enumerate(vs)]
    queries = spark.createDataFrame(rows(q), "query_id long, embedding array<double>")
    return queries, spark.createDataFrame(rows(p), "pos long, embedding array<float>").coalesce(1)


def sides(n_q=60, n_p=200, dim=5, seed=2):
    rng = np.random.default_rng(seed)
    return rng.integers(-3, 4, (n_q, dim)) + 0.5, rng.integers(-3, 4, (n_p, dim)).astype(float)


def test_one_file_of_passages_keeps_all_cores_busy(spark):
    queries, passages = frames(spark, *sides())
    assert S.score_pairs(queries, passages, "l2", cut=9.0).rdd.getNumPartitions() >= 4


def test_small_blocks_do_not_multiply_the_passages(spark):
    q, p = sides()
    queries, passages = frames(spark, q, p)
    scored = S.score_pairs(queries, passages, "l2", cut=9.0, block_bytes=40)
    # One query fits a block: sixty blocks, each with a copy of the passages, before.
    assert scored.rdd.getNumPartitions() <= 2 * S.Q_BLOCKS
    d = ((q[:, None] - p[None]) ** 2).sum(-1)
    assert sorted((r.query_id, r.pos, r.score) for r in scored.collect()) == sorted((i, j, d[i, j]) for i, j in zip(*np.nonzero(d < 9.0)))


def test_selection_only_where_more_than_k_may_count(monkeypatch):
    q, p = (np.asarray(x, float) for x in sides(n_q=600, n_p=1500))
    calls, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda *a, **k: calls.append(1) or partition(*a, **k))
    keeper = S.Keeper(np.arange(len(q)), q, "l2", 0.5, 5)
    found = [*keeper.add(np.arange(len(p)), p), *keeper.rest()]
    assert not calls and not sum(b.num_rows for b in found)


@pytest.mark.parametrize("scale", [1e-25, 1e-3, 1.0, 1e9, 1e17, 1e18, 1e60])
@pytest.mark.parametrize("top_k", [None, 3])
def test_rough_distances_lose_no_pair(scale, top_k):
    """The cut is a distance that occurs, so that pairs lie on it and a hair below it."""
    rng = np.random.default_rng(4)
    q, p = rng.normal(size=(40, 16)) * scale, rng.normal(size=(700, 16)) * scale
    q[:20] += 1000 * scale
    p[:350] += 1000 * scale
    d = np.array([[np.einsum("i,i->", a - b, a - b) for b in p] for a in q])
    cut = float(np.partition(d.ravel(), 2000)[2000])
    keeper = S.Keeper(np.arange(len(q)), q, "l2", cut, top_k)
    got = sorted((r["query_id"], r["pos"]) for b in [*keeper.add(np.arange(len(p)), p), *keeper.rest()] for r in b.to_pylist())
    near = [sorted((d[i, j], j) for j in np.flatnonzero(d[i] < cut))[:top_k] for i in range(len(q))]
    assert got == sorted((i, int(j)) for i, pairs in enumerate(near) for _, j in pairs)


def test_vectors_that_are_not_finite_match_nothing_and_hide_nothing():
    q, p = np.array([[0.0, 0.0], [np.inf, 0.0]]), np.array([[1.0, 0.0], [np.nan, 0.0], [np.inf, 1.0], [0.0, 2.0]])
    keeper = S.Keeper(np.arange(2), q, "l2", 9.0, None)
    with np.errstate(invalid="ignore"):
        got = [r for b in keeper.add(np.arange(4), p) for r in b.to_pylist()]
    assert [(r["query_id"], r["pos"], r["score"]) for r in got] == [(0, 0, 1.0), (0, 3, 4.0)]


def test_a_task_gives_k_rows_whatever_the_number_of_cells(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 4)) * 5
    p = np.concatenate([c + rng.normal(size=(30, 4)) for c in centres])
    q = np.concatenate([c + rng.normal(size=(2, 4)) for c in centres])
    queries, passages = frames(spark, q, p)
    index = pivot_index(passages, "l2", cells=20)
    index.passages = index.passages.coalesce(1)
    # Each of the cells that a query reaches gave its own two rows before.
    found = index.search(queries, 100.0, top_k=2)
    assert found.groupBy("query_id").count().where("count > 2").count() == 0
    assert R._ranked(found, ["score", "pos"], 2).count() == found.count()


def test_best_k_scores_are_those_of_all(spark):
    queries, passages = frames(spark, *sides())
    whole = R.rank_desc(R.cosine_scores(queries, passages, 0.2), top_k=3)
    few = R.cosine_scores(queries, passages, 0.2, top_k=3)
    assert sorted(R.rank_desc(few, top_k=3).collect()) == sorted(whole.collect())
    assert few.count() < R.cosine_scores(queries, passages, 0.2).count()
