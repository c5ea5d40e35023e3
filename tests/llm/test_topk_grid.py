"""Exact top-k over a grid of small shards and batches, and with components beyond 64 bits, against brute force."""

import math
import random

from fluxtone.llm import topk


def brute(rows, k, step):
    whole = lambda v: [int(x) * 256 if abs(x) >= 2**53 else math.floor(x * 256) for x in v]
    ok = [(i, whole(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % step == 0:
            scored = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False)))), i) for i, b in ok if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_grid_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_SHARD", 20)
    monkeypatch.setattr(topk, "SHARDS", 6)
    monkeypatch.setattr(topk, "BATCH", 9)
    monkeypatch.setattr(topk, "BLOCK", 4)
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(centres)]) for i in range(200)]
    rows += [(1000 + i, centres[0]) for i in range(60)]  # a large group of equal vectors
    rows += [(2000, []), (2005, None), (2010, [1.0, None]), (2015, [float("nan")]), (None, [1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), 5, 5)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 5)


def test_large_components_are_exact(spark):
    rows = [(0, [1e306, 1.0]), (1, [1e306, -1.0]), (2, [-1e306, 3.5]), (3, [2.0**60, 2.0**60 + 512]), (4, [0.0, -(2.0**44)]), (5, [0.25, 7.0]), (6, [0.0, 2.0**49 + 0.5]), (8, [3.0, -0.004]), (10, [2.0**-900, 1e-300])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 4, 2)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 2)
