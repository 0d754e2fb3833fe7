import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkloom.llm.hard_negatives import mine_hard_negatives, products, whole_components, windowed

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, positives=5, negatives=5, low=80):
    """(vec_id, vector or None, label) rows, in plain Python; vectors are whole numbers."""
    rows = [r for r in rows if None not in r]
    out = []
    for anchor, mine, label in (r for r in rows if r[0] % 100 == 0):
        scored = sorted((-sum(map(int.__mul__, mine, v)), i, kind == label) for i, v, kind in rows if i != anchor)
        for score, positive, _ in [s for s in scored if s[2]][:positives]:
            inside = [(s, i) for s, i, same in scored if not same and low * -score <= 100 * -s <= 100 * -score][:negatives]
            out += [(anchor, positive, k + 1, i, -score, -s) for k, (s, i) in enumerate(inside)]
    return sorted(out)


def mined(spark, rows, **options):
    made = spark.createDataFrame(rows, "vec_id long, vector array<long>, label int").repartition(3)
    made = made.withColumn("id", F.lit("x")).withColumn("score", F.lit(1)).withColumn("anchor", F.lit(False))
    return sorted(tuple(r) for r in mine_hard_negatives(made, F.col("vec_id") % 100 == 0, **options).collect())


def made_rows(seed, count, width=4, spread=6, labels=3):
    random.seed(seed)
    return [(10 * k, [random.randint(-spread, spread) for _ in range(width)], random.randrange(labels)) for k in range(count)]


@pytest.mark.parametrize("block_bytes", [64 << 20, 600])
def test_equals_plain(spark, block_bytes):
    # Small whole numbers: many equal scores.
    for seed, spread in ((1, 2), (2, 9)):
        rows = made_rows(seed, 120, spread=spread)
        assert mined(spark, rows, block_bytes=block_bytes) == plain(rows)


def test_copies_ties_and_one_label(spark):
    copies = [(k, [3, 4], k % 2) for k in range(300)]
    assert mined(spark, copies) == plain(copies)
    alone = [(k, [1, k], 7) for k in range(200)]
    assert mined(spark, alone) == []


def test_nulls_repeats_and_odd_vectors(spark):
    rows = [(0, [1, 2], 1), (0, [1, 2], 1), (5, [1, 2], 1), (5, [1, 2], 1), (6, [1, 2], 2), (7, [1], 2), (8, [], 2), (9, [0, 0], 1)]
    nulls = [(None, [1, 2], 1), (11, None, 2), (12, [9, 9], None), (100, [-1, -1], 3)]
    expected = plain(rows)
    assert mined(spark, rows + nulls) == expected and len(expected) == 2 * 3


def test_empty(spark):
    assert mined(spark, [(None, None, None)]) == []


def test_components(spark):
    rows = [(1, [0.5, -0.001], 0), (2, [math.nan], 0), (3, [math.inf], 0), (4, [None, 1.0], 0), (5, None, 0), (6, [], 0), (7, [1e300], 0)]
    got = {r.vec_id: r.v for r in spark.createDataFrame(rows, SCHEMA).select("vec_id", whole_components("embedding").alias("v")).collect()}
    assert got == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: [], 7: None}


def test_large_products_are_exact():
    for size in (3, 2**12, 2**26, 2**31 - 1):
        a = np.array([[size, size - 1, -size]], np.int64)
        b = np.array([[size, size, 1], [-size, 1, size]], np.int64)
        exact = [[sum(int(x) * int(y) for x, y in zip(v, w, strict=True)) for w in b] for v in a]
        assert products(a, b).tolist() == np.clip(np.array(exact, object), -(2**63), 2**63 - 1).tolist()


def test_windows_hold_few_rows():
    from talkloom.llm.hard_negatives import _KEY, _SIGN

    def key(score, row, positive):
        return _KEY.pack(_SIGN, _SIGN, ~(score + _SIGN) & (1 << 64) - 1, row + _SIGN, positive)

    def stream():
        yield key(1000, 3, 0)
        yield key(1000, 4, 1)
        yield from (key(900, k, 0) for k in range(100_000))
        raise AssertionError("a full window must have left its rows by now")

    got = windowed(stream())
    assert [next(got) for _ in range(5)] == [(0, 4, 1, 3, 1000, 1000), *((0, 4, k + 2, k, 1000, 900) for k in range(4))]
