from __future__ import annotations

import math
from collections import defaultdict

import numpy as np

from seatwise.llm import bit_sliced as B

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank int"


def brute(rows, mod, k):
    q = [(i, [math.floor(256.0 * float(np.float32(x))) for x in v]) for i, v in rows
         if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked, out = {}, {}
    for i, v in q:
        if i % mod == 0:
            asked[i] = min(asked.get(i, v), v)
    for i, v in asked.items():
        scores = [(-sum(a * b for a, b in zip(v, w)), j) for j, w in q if j != i]
        out[i] = [(j, -s) for s, j in sorted(scores)[:k]]
    return {i: x for i, x in out.items() if x}


def run(spark, rows, mod=5, **options):
    df = spark.createDataFrame([(i, v, 1, 7, 8) for i, v in rows], SCHEMA)
    out = defaultdict(list)
    for r in B.top_k(df, f"vec_id % {mod} = 0", **options).orderBy("query_id", "rank").collect():
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def test_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 0.3, (300, 7)))]
    rows += [(1000 + i, rows[10][1]) for i in range(12)]  # ties
    assert run(spark, rows, block_rows=70, chunk_queries=13) == brute(rows, 5, 5)
    assert run(spark, rows, k=20, block_rows=1000) == brute(rows, 5, 20)


def test_odd_vectors(spark):
    rows = [(0, [1.0, -2.0]), (5, [0.5, 0.5]), (5, [0.5, 0.25]), (7, None), (8, [None, 1.0]), (9, [math.nan, 1.0]),
            (10, [math.inf, 0.0]), (11, [1.0]), (12, []), (None, [1.0, 1.0]), (15, [0.0, 0.0]), (20, [-3.0, 2.0, 9.0])]
    assert run(spark, rows) == brute(rows, 5, 5)
    assert run(spark, []) == {}
    assert run(spark, [(0, [1.0])]) == {}


def test_bitmap_sums_and_selection():
    rng = np.random.default_rng(1)
    x, q = rng.integers(0, 500, (130, 9)), rng.integers(-300, 300, 9)
    score, moved = B.add(q, B.slices(x, 9))
    assert (B._scores(score, np.arange(130), moved) == x @ q).all()


def test_large_components(spark):
    """Finite vectors beyond the index's bound are queries and candidates like all others."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 0.3, (80, 3)))]
    rows += [(101, [300000.0, 1.0, 0.0]), (105, [-float(2**40), 2.0**40, 1.0]), (110, [float(2**52), 0.5, -0.25]),
             (111, [-float(2**52), 0.5, -0.25]), (112, [float(2**20), -1.0]), (115, [float(2**52), 0.5, -0.25])]
    got, want = run(spark, rows, block_rows=30, chunk_queries=7), brute(rows, 5, 5)
    exact = lambda x: [(i, min(max(s, -2**63), 2**63 - 1)) for i, s in x]
    assert got == {i: exact(x) for i, x in want.items()}
    assert any(i in (101, 105, 112) for x in got.values() for i, _ in x)


def test_the_bound_keeps_sums_within_64_bits():
    for width in (1, 2, 63, 64, 65, 5000):
        assert width * (B.safe_bound(width) - 1) ** 2 < 1 << 62 and B.safe_bound(width) > 1 << 20
