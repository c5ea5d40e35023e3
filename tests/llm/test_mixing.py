import random

import pytest
from pyspark.sql import functions as F

from fluxtone.llm.mixing import copies, mix, mixed, targets

SCHEMA = "doc_id long, text string, source string, copies int, size string"


def fill(sizes, weights, share, most):
    """Reshares the excess by weight until none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal = {s: share * sum(sizes.values()) * w[s] / sum(w.values()) for s in names}
    capped = set()
    while over := {s for s in names if s not in capped and goal[s] > most * sizes[s]}:
        excess = sum(goal[s] - most * sizes[s] for s in over)
        goal |= {s: most * sizes[s] for s in over}
        capped |= over
        free = [s for s in names if s not in capped]
        for s in free:
            goal[s] += excess * w[s] / sum(w[x] for x in free)
    return goal


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 30, None: 5}, {"z": 7}, {"a": 0, "b": 0}, {"a": 5, "é": 5, "B": 500, "zz": 1, "c": 90}])
def test_targets(spark, sizes):
    got = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (3, 1, 2), 1.5, 2.0)
    want = fill(sizes, (3, 1, 2), 1.5, 2.0)
    assert {r.source: pytest.approx(r.target) for r in got.collect()} == want


def test_mix_is_near_its_targets_and_repeats_itself(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 40, rng.randint(0, 900)])), rng.choice(["a"] * 6 + ["b", "c", None]), 1, "") for i in range(900)]
    rows += [(5, "again and again", "a", 1, "")] * 3 + [(None, "x y", "b", 1, ""), (901, None, "b", 1, ""), (902, "", "c", 1, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, mix(df).collect()), key=str)
    assert got == sorted(map(tuple, mix(df.repartition(7)).collect()), key=str)
    for r in copies(df).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest"), F.first("source_size").alias("all"), F.sum("size").alias("own"), F.max("copies").alias("most")).collect():
        assert abs(r.taken - r.target) <= r.largest and r["all"] == r.own and r.most <= 2
    out = mixed(df)
    assert out.columns == df.columns
    words = out.select(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit("\\w+")))).first()[0]
    assert words == sum(x[4] for x in got)


def test_empty(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mixed(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [r.taken for r in mix(spark.createDataFrame([(1, None, None, 0, ""), (2, "", "a", 0, "")], SCHEMA)).collect()] == [0, 0]
