"""Exact scores between query vectors and passage vectors, in matrix blocks.

Only survivors leave a task: pairs that pass the cut, the best ``top_k`` per query, or both.
If the query side is proven small it is sent to every task and the passages are dealt out
evenly. Otherwise queries are cut into blocks of bounded size and passages into parts, and each
block meets each part in one task, where the part passes by: neither side needs to fit
anywhere as a whole, and what is found leaves the task at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.sources.scratch import written

SCORED = "query_id long, pos long, score double"
ARROW = pa.schema(
    [("query_id", pa.int64()), ("pos", pa.int64()), ("score", pa.float64())]
)
_TILE = 512
_HELD_BYTES = 24
# Numbers gathered at a time for the exact scores.
_GATHERED = 1 << 22
#: A block of queries that a task of the grid holds.
BLOCK_BYTES = 64 << 20
#: Passages are copied to each block of queries: blocks below BLOCK_BYTES are no more than these.
Q_BLOCKS = 16
#: Pairs that a task of the grid scores, some minutes of work.
CELL_PAIRS = 40_000_000_000
#: Vectors shorter than this have squared distances that single precision can hold.
_FLOAT32 = 1e18


def score_pairs(
    queries: DataFrame,
    passages: DataFrame,
    metric: str = "cosine",
    cut: float | None = None,
    top_k: int | None = None,
    block_bytes: int = 64 << 20,
) -> DataFrame:
    """``(query_id, pos, score)`` of ``queries(query_id, embedding)`` and ``passages(pos, embedding)``.

    ``cosine`` keeps scores of at least ``cut``, ``l2`` (squared distance) keeps scores
    below it. With ``top_k`` each task gives its own best; rank them to finish. Queries of up to
    ``block_bytes``, with the rows held for them, are sent to every task. Beyond that they are cut into
    blocks of that size, or larger ones of up to BLOCK_BYTES if there would be more than Q_BLOCKS. Ties go to
    the lower ``pos``. Zero and null
    vectors have no cosine and match nothing.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(f"unknown metric {metric!r}")
    if cut is None and top_k is None:
        raise ValueError("give a cut, a top_k, or both: all pairs are never kept")
    q = queries.select(F.col("query_id").cast("long").alias("id"), "embedding")
    p = passages.select(F.col("pos").cast("long").alias("id"), "embedding")
    q, p = q.filter(F.col("embedding").isNotNull()), p.filter(F.col("embedding").isNotNull())
    # Measured and then used: stored in between, an encoder behind the queries runs once.
    q = written(q, "queries")
    count, width = q.agg(F.count("*"), F.max(F.size("embedding"))).first()
    row_bytes = 8 * (width or 1)
    block_rows = max(1, block_bytes // (row_bytes + _HELD_BYTES * (top_k or 0)))
    cores = q.sparkSession.sparkContext.defaultParallelism
    if count <= block_rows:
        # Bounded by the check just made.
        ids, vectors = matrix(q.toArrow(), metric)
        shared = q.sparkSession.sparkContext.broadcast((ids, vectors))
        # Dealt out evenly: the files of a table may be few, or one row group each.
        return p.repartition(2 * cores).mapInArrow(_against(shared, metric, cut, top_k), SCORED)

    most_rows = max(1, BLOCK_BYTES // (row_bytes + _HELD_BYTES * (top_k or 0)))
    q_blocks = -(-count // max(block_rows, min(most_rows, -(-count // Q_BLOCKS))))
    p_parts = max(1, -(-2 * cores // q_blocks), -(-count * p.count() // (q_blocks * CELL_PAIRS)))
    parts = F.sequence(F.lit(0).cast("long"), F.lit(p_parts - 1).cast("long"))
    blocks = F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))
    q_kind, p_kind = (side.schema["embedding"].dataType for side in (q, p))
    left = q.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(q_blocks))).withColumn("pb", F.explode(parts))
    right = p.withColumn("pb", F.pmod(F.xxhash64("id"), F.lit(p_parts))).withColumn("qb", F.explode(blocks))
    cell = (F.col("qb") * p_parts + F.col("pb")).cast("int").alias("cell")
    asked = left.select("id", F.col("embedding").alias("query"), F.lit(None).cast(p_kind).alias("passage"), F.lit(False).alias("stored"), cell)
    stored = right.select("id", F.lit(None).cast(q_kind).alias("query"), F.col("embedding").alias("passage"), F.lit(True).alias("stored"), cell)
    cells = asked.unionByName(stored).repartitionById(q_blocks * p_parts, F.col("cell")).sortWithinPartitions("stored").drop("cell")
    return cells.mapInArrow(_cell(metric, cut, top_k), SCORED)


def matrix(table: pa.Table | pa.RecordBatch, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors as arrays; for cosine at unit length, without zero vectors."""
    ids = table.column(0).to_numpy()
    lists = table.column(1)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    if len(ids) == 0:
        return ids.astype("int64"), np.zeros((0, 0))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype("float64")
    vectors = flat.reshape(len(ids), -1)
    if metric == "cosine":
        length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        whole = length > 0
        ids, vectors = ids[whole], vectors[whole] / length[whole, None]
    return ids, vectors


def _against(shared, metric, cut, top_k):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        keeper = Keeper(ids, vectors, metric, cut, top_k)
        for batch in batches:
            yield from keeper.add(*matrix(batch, metric))
        yield from keeper.rest()

    return run


def _cell(metric, cut, top_k):
    """One block of queries, which come first and are held, against passages, which pass by batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, keeper = [], None
        for batch in batches:
            first = int(np.searchsorted(batch.column("stored").to_numpy(zero_copy_only=False), True))
            if first:
                asked.append(batch.slice(0, first).select(["id", "query"]))
            if first == batch.num_rows or not (asked or keeper):
                continue
            if keeper is None:
                keeper = Keeper(*matrix(pa.Table.from_batches(asked), metric), metric, cut, top_k)
                asked = []
            yield from keeper.add(*matrix(batch.slice(first).select(["id", "passage"]), metric))
        if keeper is not None:
            yield from keeper.rest()

    return run


def _rough(vectors: np.ndarray, lengths: np.ndarray, metric: str, queries: bool) -> np.ndarray:
    """Single-precision rows whose products are the negated cosines, or the squared distances, in one multiplication."""
    if metric == "cosine":
        return (-vectors if queries else vectors).astype("float32")
    ones, squares = np.ones((len(vectors), 1)), (lengths**2)[:, None]
    with np.errstate(over="ignore"):  # Such rows are multiplied in double precision.
        return np.hstack([-2 * vectors, squares, ones] if queries else [vectors, ones, squares]).astype("float32")


def _near(cost: np.ndarray, slack, bounds: np.ndarray) -> np.ndarray:
    """Which costs may be within the bounds, one a query."""
    if np.ndim(slack) == 2 and slack.shape[1] > 1:
        return cost - slack <= bounds[:, None]
    # Twice the slack also covers the rounding of the bound itself.
    with np.errstate(over="ignore"):
        return cost <= (bounds[:, None] + 2 * slack).astype(cost.dtype)


class Keeper:
    """Scores passages tile by tile; holds ``top_k`` rows per query, or passes survivors on.

    A matrix product finds the pairs that may count, with a slack for its rounding; those
    alone are scored again one by one in double precision. So a score depends on its two
    vectors only, not on where they stood, and copies tie exactly.
    """

    def __init__(self, ids, vectors, metric, cut, top_k):
        self.ids, self.vectors = ids, vectors
        self.metric, self.cut, self.top_k = metric, cut, top_k
        self.lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        self.rough = _rough(vectors, self.lengths, metric, True)
        # Best first is smallest first: cosine is held negated.
        self.limit = np.full(len(ids), np.inf)
        self.held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, pos: np.ndarray, passages: np.ndarray, wanted: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """Score passages against all queries, or those that ``wanted`` marks; what is held is the same for all."""
        if not len(self.ids) or not len(pos):
            return
        for p0 in range(0, len(pos), _TILE):
            block, block_pos = passages[p0 : p0 + _TILE], pos[p0 : p0 + _TILE]
            lengths = np.sqrt(np.einsum("ij,ij->i", block, block))
            rough = _rough(block, lengths, self.metric, False).T
            for q0 in range(0, len(self.ids), _TILE):
                chosen = slice(q0, min(q0 + _TILE, len(self.ids)))
                if wanted is not None and not wanted[chosen].all():
                    chosen = q0 + np.flatnonzero(wanted[chosen])
                    if not len(chosen):
                        continue
                rows, cols, cost = self._survivors(chosen, block, lengths, rough)
                if not len(rows):
                    continue
                rows = rows + q0 if isinstance(chosen, slice) else chosen[rows]
                if self.top_k is None:
                    yield self._batch(rows, block_pos[cols], cost)
                else:
                    self._hold(q0, rows, block_pos[cols], cost)

    def rest(self) -> Iterator[pa.RecordBatch]:
        for held in self.held.values():
            yield self._batch(*held)

    def _survivors(self, chosen, block, lengths, rough):
        """Rows (counted within ``chosen``), columns and costs of the pairs of a tile that count."""
        mine, limit = self.vectors[chosen], self.limit[chosen]
        cost, slack = self._rough_cost(chosen, block, lengths, rough)
        bound = np.inf if self.cut is None else -self.cut if self.metric == "cosine" else self.cut
        bounds = np.minimum(bound, limit)
        near = _near(cost, slack, bounds)
        flat = np.flatnonzero(near)
        if self.top_k is not None and len(flat) > self.top_k:
            # Only queries with more candidates than can be held are worth a selection.
            full = np.flatnonzero(np.bincount(flat // cost.shape[1], minlength=len(mine)) > self.top_k)
            if len(full):
                part, give = cost[full], slack[full] if np.ndim(slack) else slack
                kth = np.partition(part + give, self.top_k - 1, axis=1)[:, self.top_k - 1]
                near[full] = _near(part, give, np.minimum(bounds[full], kth))
                flat = np.flatnonzero(near)
        rows, cols = np.divmod(flat, cost.shape[1])
        exact = self._exact_cost(mine, block, rows, cols)
        keep = exact <= limit[rows]
        if self.cut is not None:
            keep &= exact <= -self.cut if self.metric == "cosine" else exact < self.cut
        return rows[keep], cols[keep], exact[keep]

    def _rough_cost(self, chosen, block, lengths, rough):
        """All costs of a tile, and how far rounding may have moved them: one number, one a query, or one a pair."""
        terms = block.shape[1] + 8
        if self.metric == "cosine":
            return self.rough[chosen] @ rough, np.float32(terms * 2.0**-23)
        own = self.lengths[chosen]
        if own.max() + lengths.max() < _FLOAT32:
            slack = (own[:, None] + lengths.max()) ** 2 * (terms * 2.0**-22) + 1e-35
            return self.rough[chosen] @ rough, slack.astype("float32")
        own = own[:, None]
        cost = own**2 + lengths**2 - 2 * (self.vectors[chosen] @ block.T)
        return cost, (own + lengths) ** 2 * (terms * 2.0**-52)

    def _exact_cost(self, mine, block, rows, cols):
        cost = np.empty(len(rows))
        step = max(1, _GATHERED // block.shape[1])
        for start in range(0, len(rows), step):
            part = slice(start, start + step)
            a, b = mine[rows[part]], block[cols[part]]
            if self.metric == "cosine":
                cost[part] = -np.einsum("ij,ij->i", a, b)
            else:
                a -= b
                cost[part] = np.einsum("ij,ij->i", a, a)
        return cost

    def _hold(self, q0, rows, pos, cost):
        if q0 in self.held:
            held = self.held[q0]
            rows, pos, cost = (np.concatenate(pair) for pair in zip(held, (rows, pos, cost)))
        order = np.lexsort((pos, cost, rows))
        rows, pos, cost = rows[order], pos[order], cost[order]
        first = np.searchsorted(rows, rows, side="left")
        rank = np.arange(len(rows)) - first
        top = rank < self.top_k
        self.held[q0] = (rows[top], pos[top], cost[top])
        last = rank == self.top_k - 1
        self.limit[rows[last]] = cost[last]

    def _batch(self, rows, pos, cost) -> pa.RecordBatch:
        score = -cost if self.metric == "cosine" else cost
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[rows], pa.int64()), pa.array(pos, pa.int64()), pa.array(score)],
            schema=ARROW,
        )
