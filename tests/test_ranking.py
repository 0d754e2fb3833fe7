"""Ranks made in the task that scores a query against all passages."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from talkloom.operators import retrieve as R
from talkloom.plans import ranking
from talkloom.plans.scoring import score_pairs


@pytest.fixture
def sides(spark):
    random = np.random.default_rng(5)
    vectors = random.integers(-2, 3, (60, 3)).astype(float).tolist()
    # Copies tie; an id that comes twice is ranked as one query; a null vector matches nothing.
    queries = [(i // 2 if i < 8 else i, v) for i, v in enumerate(vectors[:20])] + [(99, None)]
    passages = [*enumerate(vectors), *((100 + i, v) for i, v in enumerate(vectors)), (300, None)]
    return (
        spark.createDataFrame(queries, "query_id long, embedding array<double>"),
        spark.createDataFrame(passages, "pos long, embedding array<double>").repartition(3),
    )


@pytest.mark.parametrize("metric, cut", [("cosine", 0.4), ("l2", 6.0), ("l2", 1e9)])
def test_ranks_are_those_of_a_window(sides, metric, cut):
    best = F.desc("score") if metric == "cosine" else F.asc("score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(best, "pos"))
    want = score_pairs(*sides, metric, cut=cut).withColumn("rank", rank.cast("long"))
    got = ranking.ranked_pairs(*sides, metric, cut)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_no_pair_is_shuffled_to_be_ranked(sides):
    for df in (R.l2_range_matches(*sides, radius=6.0), R.rank_desc(R.cosine_scores(*sides, 0.4, ranked=True))):
        lines = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0].split("\n")
        join = next((i for i, line in enumerate(lines) if "CartesianProduct" in line), None)
        assert join is not None and not any("Exchange" in line or "numbered" in line for line in lines[:join])


@pytest.mark.parametrize("held", [0, 200, 1 << 20])
def test_runs_in_a_file_lose_nothing(monkeypatch, held):
    monkeypatch.setattr(ranking, "HELD_BYTES", held)
    random = np.random.default_rng(6)
    runs, rows = ranking.Runs(np.array([5, 3, 9, 3])), []
    for _ in range(7):
        ids, cost, pos = random.choice([3, 9], 30), random.integers(0, 4, 30) / 2.0, random.integers(0, 1000, 30)
        runs.add(ids, cost, pos)
        rows += zip(ids.tolist(), cost.tolist(), pos.tolist())
    got = pa.Table.from_batches(list(runs.ranked(1.0))).to_pylist()
    assert [(r["query_id"], r["score"], r["pos"]) for r in got] == sorted(rows)
    assert [r["rank"] for r in got if r["query_id"] == 9] == list(range(1, 1 + sum(i == 9 for i, _, _ in rows)))
