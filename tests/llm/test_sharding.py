import random
import zlib

from fluxtone.llm.sharding import longest_first, shard

SCHEMA = "doc_id long, text string, size int, shard string"


def test_heap_by_hand():
    assert longest_first([(3, "c"), (5, "a"), (4, "b"), (3, "d"), (1, "e")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def test_law_groups_slots(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["same text é", None, "", "x" * rng.randint(0, 3000), f"t{rng.randint(0, 50)}"]), 1, "a") for i in range(1500)] + [(7, "repeat", 1, "b")] * 3 + [(None, "x", 1, "c"), (5000, "long " * 4000, 1, "c")]
    for shards in (3, 8):
        got = shard(spark.createDataFrame(rows, SCHEMA).repartition(5), shards).collect()
        assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i if i is not None else -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
        where, load, slots, groups = {}, [0] * shards, {}, {}
        for r in got:
            assert where.setdefault((r.text_crc32, r.size), r.shard) == r.shard
            load[r.shard] += r.size
            groups[r.text_crc32, r.size] = groups.get((r.text_crc32, r.size), 0) + r.size
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        # the bound of list scheduling
        assert max(load) <= sum(load) / shards + max(groups.values())
        assert sorted(map(str, got)) == sorted(map(str, shard(spark.createDataFrame(rows, SCHEMA), shards).collect()))


def test_empty(spark):
    assert shard(spark.createDataFrame([], SCHEMA)).collect() == []
    assert shard(spark.createDataFrame([(1, None, 0, "")], SCHEMA)).select("size", "slot").collect() == [(16, 0)]
