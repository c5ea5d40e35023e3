import re
from itertools import permutations

import pytest

from fluxtone.llm.filter_audit import audit, block_hash, blocks

LONG = "Abcd efg " * 400
VARIED = " ".join(f"w{i}" for i in range(130))
TEXTS = ["", None, "a b c", LONG, LONG[:-1] + "x", VARIED, VARIED + " $", "SHOUT " * 120, VARIED.upper(), "é " * 200, "x y"]
ROWS = [(i, TEXTS[i % len(TEXTS)], ["en", "de", None, ""][i % 4], i * 1.0, "x") for i in range(60)]
ROWS += [(None, LONG, "en", 0.0, "x"), (None, LONG, "en", 0.0, "x"), (3, LONG, "de", 0.0, "x"), (3, LONG, "en", 0.0, "x"), (3, "a b c", "en", 0.0, "x"), (70, LONG[:-1] + "y", "en", 0.0, "x"), (71, LONG[:-1] + "z", "en", 0.0, "x"), (-5, VARIED, "fr", 0.0, "x")]
SCHEMA = "doc_id long, text string, lang string, mask double, good string"
LABELS = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 3)] + [(3, 0, 1), (4, None, None), (None, 1, 1)]


def brute(rows, labels):
    good, toxic = ({d for d, *x in labels if x[j] == 1 and d is not None} for j in (0, 1))
    seen = []
    for doc, text, lang, *_ in rows:
        t = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        copy = doc is not None and any((u or "") == t and d is not None and d < doc for d, u, *_ in rows)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy}
        seen.append((lang or "", {x for x in fails if fails[x]}, doc in good, doc in toxic))
    out = []
    for part in {s[0] for s in seen}:
        own = [s for s in seen if s[0] == part]
        gone = {}
        for order in permutations("ABCDE"):
            for i, x in enumerate(order):
                gone[order, i] = [s for s in own if x in s[1] and not s[1] & set(order[:i])]
        for order in permutations("ABCDE"):
            for i, x in enumerate(order):
                now = gone[order, i]
                shapley = sum(len(v) for (o, j), v in gone.items() if o[j] == x)
                out.append((part, "".join(order), i + 1, sum(not s[1] & set(order[: i + 1]) for s in own), len(now), sum(x in s[1] for s in own) - len(now), sum(s[1] == {x} for s in own), sum(s[2] for s in now), sum(s[3] for s in now), shapley))
    return sorted(out)


@pytest.mark.parametrize("hasher", [block_hash, lambda piece: 7])
def test_matches_brute_force_also_when_block_hashes_collide(spark, hasher):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, audit(docs, labels, hasher).collect())) == brute(ROWS, LABELS)


def test_one_large_group_of_copies(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('same words ', 60), concat(repeat('same words ', 60), id)) as text", "'en' as lang")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {(r.filter_order, r.step): r for r in audit(docs, labels).collect()}
    assert got["EABCD", 1].removed == 999 and got["EABCD", 1].kept == 2001 and got["BEACD", 2].redundant == 999


def test_empty_tables(spark):
    empty, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(empty, labels).collect() == []


def test_blocks_of_texts():
    assert blocks("") == [] and len(blocks("x" * 128)) == 1 and len(blocks("x" * 129)) == 2
    assert blocks("a" * 200)[0] == blocks("a" * 300)[0] and blocks("a" * 200)[1] != blocks("a" * 300)[1]
    assert len(blocks("é" * 1_000_000)) == 6
