import math

import numpy as np

from fluxtone.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, v int, score string"


def brute(rows, k, step):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e, *_ in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, a in good:
        if q % step == 0:
            found = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def test_matches_brute_force_with_ties_and_bad_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.2, 8).astype(np.float32).tolist(), 0, 0, "") for i in range(700)]
    rows += [(700 + i, [0.5] * 8, 0, 0, "") for i in range(300)] + [(1000, [0.25], 0, 0, ""), (1050, None, 0, 0, ""), (1100, [float("nan")] * 8, 0, 0, ""), (1150, [None, 1.0], 0, 0, ""), (1200, [float("inf")] * 8, 0, 0, ""), (None, [1.0] * 8, 0, 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    for shard in (100, 5000):
        monkeypatch.setattr(topk, "SHARD", shard)
        monkeypatch.setattr(topk, "BLOCK", 16)
        got = sorted(map(tuple, topk.top_k(df.repartition(3), 5, 50).collect()))
        assert got == brute(rows, 5, 50)


def test_blocks_are_left_out():
    rng = np.random.default_rng(3)
    centres = np.eye(8) * 300
    vectors = np.floor(centres[np.arange(4096) % 8] + rng.normal(0, 3, (4096, 8)))
    shard, read = topk.Shard(np.arange(4096), vectors), []
    plain = topk._dot
    topk._dot = lambda a, b: read.append(len(a) * len(b)) or plain(a, b)
    try:
        shard.search(np.arange(0, 4096, 50), vectors[::50], 5)
    finally:
        topk._dot = plain
    assert sum(read) < 0.5 * 4096 * len(vectors[::50])


def test_few_and_large(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).collect() == []
    two = [(0, [1.0, 2.0], 0, 0, ""), (50, [3.0e30, -1.0], 0, 0, ""), (3, [3.0e30, 1.0], 0, 0, "")]
    got = {tuple(r) for r in topk.top_k(spark.createDataFrame(two, SCHEMA)).collect()}
    most = 2**63 - 1  # all of these scores are beyond 64 bits
    assert got == {(0, 1, 3, most), (0, 2, 50, most), (50, 1, 0, most), (50, 2, 3, most)}
