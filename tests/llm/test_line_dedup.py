import random
import re

import pytest

from fluxtone.llm.line_dedup import line_dedup

SCHEMA = "doc_id long, text string, lines int, mark string"


def brute(rows, run, least, long):
    norm = lambda line: " ".join(re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)))
    docs = sorted({(i, t) for i, t, *_ in rows})
    seen, out = set(), {}
    for i, t in docs:
        lines = (t or "").split("\n")
        own = [(k, norm(x)) for k, x in enumerate(lines) if norm(x)]
        gone = set()
        for s in range(len(own) - run + 1):
            window = tuple(x for _, x in own[s : s + run])
            if sum(len(x.split()) for x in window) >= least:
                if window in seen:
                    gone |= {k for k, _ in own[s : s + run]}
                seen.add(window)
        for k, x in own:
            if len(x.split()) >= long:
                gone |= {k} if (1, x) in seen else set()
                seen.add((1, x))
        out[i, t] = (None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(own), len(gone))
    return sorted(((i, *out[i, t]) for i, t, *_ in rows), key=str)


@pytest.mark.parametrize(("run", "least", "long"), [(1, 0, 99), (2, 4, 4), (2, 0, 99999), (3, 9, 5), (4, 0, 5)])
def test_matches_brute_force(spark, run, least, long):
    rng = random.Random(run)
    pool = [" ".join(rng.choice(["a", "B", "c", "été", "x1"]) for _ in range(rng.randint(1, 5))) for _ in range(14)]
    rows = [(i, rng.choice(["\n", "\n\n", " \n"]).join(rng.choice(pool) for _ in range(rng.randint(0, 12))), 1, "") for i in range(90)]
    rows += [(100, None, 1, ""), (101, "", 1, ""), (102, "\n \n", 1, ""), (103, "\n".join(["same line again"] * 40), 1, ""), rows[5], rows[5], (104, "long word list\n" * 3 + "w " * 50000, 1, "")]
    got = line_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4), run, least, long)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str) == brute(rows, run, least, long)


def test_empty_and_ranges(spark):
    assert line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "a b\nc d\ne f\ng", 0, ""), (2, "x\nA  b\nc d\ne f\ny", 0, "")]
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, SCHEMA), 3, 0).collect()}
    assert [tuple(x) for x in got[2].removed] == [(1, 3)] and got[2].text == "x\ny" and got[1].n_removed == 0
    assert line_dedup(spark.createDataFrame([(None, "p\nq\nr", 0, ""), (4, "p\nq\nr", 0, "")], SCHEMA), 3, 0).where("doc_id is null").first().n_removed == 3
