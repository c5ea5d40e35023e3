"""The whole scheduling rule, with bundles, in plain Python."""

import hashlib
import heapq
import random

import xxhash

from fluxtone.llm import sharding


def brute(rows, shards):
    sizes = [(i, len((t or "").encode()) + 16, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    bundles, total, groups = shards * sharding.FINE, sum(s for _, s, _ in sizes), {}
    for _, s, g in sizes:
        groups[g] = groups.get(g, 0) + s
    bundle = lambda g: f"bundle {(xxhash.xxh64(g.encode(), seed=42).intdigest() + 2**63) % 2**64 - 2**63}"
    named = {g: g if s * bundles > total else f"bundle {int(bundle(g).split()[1]) % bundles}" for g, s in groups.items()}
    items = {}
    for g, s in groups.items():
        items[named[g]] = items.get(named[g], 0) + s
    heap, placed = [(0, k) for k in range(shards)], {}
    for s, item in sorted(((s, i) for i, s in items.items()), key=lambda x: (-x[0], x[1])):
        load, k = heapq.heappop(heap)
        placed[item] = k
        heapq.heappush(heap, (load + s, k))
    return sorted((i, s, placed[named[g]]) for i, s, g in sizes)


def test_every_document_goes_where_the_rule_says(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "", "copy " * 200, "é" * rng.randint(1, 400), f"own {rng.random()} " * rng.randint(1, 90)])) for i in range(700)]
    for shards, fine in ((7, 256), (5, 2), (40, 1)):
        monkeypatch.setattr(sharding, "FINE", fine)
        got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shards)
        assert sorted((r.doc_id, r.size, r.shard) for r in got.collect()) == brute(rows, shards)
