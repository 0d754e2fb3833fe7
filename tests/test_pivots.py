"""Search by pivots against the scores of every pair, and that it skips cells."""

import numpy as np
import pytest

from talkloom.operators import retrieve as R
from talkloom.plans.pivots import pivot_index
from talkloom.plans.scoring import score_pairs


def frames(spark, q, p):
    queries = spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(q)], "query_id long, embedding array<float>")
    passages = spark.createDataFrame(
        [(i, f"t{i}", None if v is None else [float(x) for x in v]) for i, v in enumerate(p)], "pos long, text string, embedding array<float>"
    ).repartition(3)
    return queries, passages


def clustered(seed=3, clusters=12, size=25, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim)) * 10
    p = np.concatenate([c + rng.normal(size=(size, dim)) * 0.3 for c in centres])
    q = np.concatenate([c + rng.normal(size=(3, dim)) * 0.3 for c in centres])
    return [*q, np.zeros(dim), None], [*p, p[0], p[0], np.zeros(dim), None]


def pairs(df):
    return sorted((r.query_id, r.pos, r.score) for r in df.collect())


@pytest.mark.parametrize(("metric", "cut"), [("cosine", 0.97), ("cosine", -1.0), ("cosine", 1.0), ("l2", 2.0), ("l2", 1e9), ("l2", 0.0)])
@pytest.mark.parametrize("block_bytes", [64 << 20, 1000])
def test_same_pairs(spark, metric, cut, block_bytes):
    queries, passages = frames(spark, *clustered())
    index = pivot_index(passages, metric, cells=12)
    assert pairs(index.search(queries, cut, block_bytes=block_bytes)) == pairs(score_pairs(queries, passages, metric, cut=cut))


def test_cells_are_skipped_and_no_match_is_lost(spark):
    queries, passages = frames(spark, *clustered())
    index = pivot_index(passages, "l2", cells=40)
    reached = index.reached(queries, 4.0)
    # Unpruned, every query with a vector would reach every cell.
    assert reached.selectExpr("sum(cells)").first()[0] < 0.2 * 37 * len(index.pivots)
    # Nor is a query copied to a block more often than once.
    blocks = np.arange(len(index.pivots)) // 10
    assert index.reached(queries, 1e9, blocks).count() == 37 * 4
    found = pairs(index.search(queries, 4.0))
    assert found == pairs(score_pairs(queries, passages, "l2", cut=4.0)) and len(found) > 300
    assert index.rows.sum() == 303


def test_random_data_loses_nothing(spark):
    rng = np.random.default_rng(5)
    q, p = rng.normal(size=(40, 16)) * 1e5, rng.normal(size=(200, 16)) * 1e5
    queries, passages = frames(spark, q, np.concatenate([p, q]))
    for metric, cut in (("cosine", 0.3), ("l2", 3e11), ("l2", 1e-3)):
        index = pivot_index(passages, metric, cells=30)
        assert pairs(index.search(queries, cut)) == pairs(score_pairs(queries, passages, metric, cut=cut))


def test_operators_give_the_same_rows(spark):
    queries, passages = frames(spark, *clustered())
    cosine, l2 = (pivot_index(passages, m, cells=15) for m in ("cosine", "l2"))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(R.best_match(queries, passages, 0.6, cosine)) == rows(R.best_match(queries, passages, 0.6))
    assert rows(R.threshold_matches(queries, passages, 0.99, cosine)) == rows(R.threshold_matches(queries, passages, 0.99))
    assert rows(R.l2_range_context(queries, passages, 3.0, 4, l2)) == rows(R.l2_range_context(queries, passages, 3.0, 4))
    assert rows(R.l2_range_matches(queries, passages, 3.0, index=l2)) == rows(R.l2_range_matches(queries, passages, 3.0))
    with pytest.raises(ValueError):
        R.best_match(queries, passages, 0.6, l2)


def test_empty_sides(spark):
    queries, passages = frames(spark, *clustered())
    none = pivot_index(passages.where("false"), "l2")
    assert none.search(queries, 1e9).collect() == []
    assert pivot_index(passages, "l2").search(queries.where("false"), 1e9).collect() == []
    with pytest.raises(ValueError):
        pivot_index(passages, "dot")
