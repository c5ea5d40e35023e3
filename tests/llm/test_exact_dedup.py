import hashlib
import re

import pytest
from pyspark.sql import functions as F

from fluxtone.llm.exact_dedup import drop_copies, exact_dedup

ROWS = [(4, "a b\tc", 1), (2, "abc", 1), (3, "a b\tc", 1), (9, "a\n\x0bb \x0cc\r", 1), (5, None, 1), (6, "", 1), (7, " \t\n", 1), (1, "ABC", 1), (8, "a\u00a0bc", 1), (3, "a b\tc", 1), (10, "é " * 50000, 2), (11, "é" * 50000, 2)]
SCHEMA = "doc_id long, text string, digest int"


def brute(rows):
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    out, seen = [], set()
    for i, t, _ in rows:
        group = [(j, u) for j, u, _ in rows if norm(u) == norm(t)]
        best = min(group, key=lambda g: (-len(g[1] or ""), g[0]))
        kept = (i, t) == best and (i, t) not in seen
        if kept:
            seen.add((i, t))
        out.append((i, best[0], len(group), kept, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("digest", [None, lambda c: F.length(c).cast("string")])
def test_matches_brute_force_also_when_digests_collide(spark, digest):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    got = exact_dedup(df, digest) if digest else exact_dedup(df)
    assert sorted(map(tuple, got.collect())) == brute(ROWS)


def test_empty_null_ids_and_kept_rows(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    got = sorted(map(tuple, exact_dedup(spark.createDataFrame([(None, "x", 0), (3, "x", 0), (None, "y", 0), (None, "y", 0)], SCHEMA)).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    assert got == sorted([(None, 3, 2, False), (3, 3, 2, True), (None, None, 2, False), (None, None, 2, True)], key=str)
    kept = drop_copies(spark.createDataFrame(ROWS, SCHEMA))
    assert kept.columns == ["doc_id", "text", "digest"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 7, 8, 9, 10]
