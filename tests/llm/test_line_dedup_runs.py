"""least_words asked of whole repeated runs, held against a brute force that measures maximal runs."""

import random
import re

import pytest

from fluxtone.llm.line_dedup import line_dedup

SCHEMA = "doc_id long, text string"


def brute(rows, run, least, long):
    docs = sorted({(i, t) for i, t in rows})
    own = {d: [(k, tuple(re.findall("[^\x20\x09-\x0d]+", x.lower()))) for k, x in enumerate(d[1].split("\n")) if x.split()] for d in docs}
    out = {}
    for n, d in enumerate(docs):
        gone, lines = set(), [w for _, w in own[d]]
        for e in docs[: n + 1]:
            other = [w for _, w in own[e]]
            for a in range(len(lines)):
                for b in range(a if e == d else len(other)):
                    if a and b and lines[a - 1] == other[b - 1]:
                        continue  # not where a maximal run starts
                    size = 0
                    while a + size < len(lines) and b + size < len(other) and lines[a + size] == other[b + size]:
                        size += 1
                    if size >= run and sum(map(len, lines[a : a + size])) >= least:
                        gone |= set(range(a, a + size))
                    gone |= {a + j for j in range(size) if len(lines[a + j]) >= long}
        drop = {own[d][j][0] for j in gone}
        out[d] = ("\n".join(x for k, x in enumerate(d[1].split("\n")) if k not in drop), len(drop))
    return sorted((i, *out[i, t]) for i, t in rows)


@pytest.mark.parametrize(("run", "least", "long"), [(2, 9, 5), (1, 7, 99), (3, 12, 6), (2, 0, 99), (4, 25, 99)])
def test_matches_brute_force_over_maximal_runs(spark, run, least, long):
    rng = random.Random(least)
    pool = [" ".join(rng.choice(["a", "B", "c", "x1"]) for _ in range(rng.choice([1, 1, 2, 3, 6]))) for _ in range(12)]
    rows = [(i, rng.choice(["\n", "\n\n"]).join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(50)]
    for i in range(50, 70):  # passages of others, end to end
        cuts = [rng.choice(rows)[1].split("\n") for _ in range(3)]
        rows.append((i, "\n".join("\n".join(c[(s := rng.randint(0, len(c))) : s + rng.randint(1, 9)]) for c in cuts)))
    rows += [(80, "same line again\n" * 30), (81, ""), rows[5], rows[5]]
    got = line_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4), run, least, long, by_run=True)
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got.collect()) == brute(rows, run, least, long)


def test_long_passages_of_short_lines_go_whole(spark):
    verse = "\n".join(" ".join(f"w{i}x{j}" for j in range(9)) for i in range(40))
    mixed = "\n".join(" ".join(f"v{i}y{j}" for j in range(n)) for i, n in enumerate([3, 30, 2, 1, 6, 40, 1]))
    rows = [(1, verse), (2, f"own head\n{verse}\nown tail"), (3, mixed), (4, f"other head\n{mixed}\nother tail"), (5, "few words\nonly here"), (6, "few words\nonly here")]
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, SCHEMA), 2, 20, 50, by_run=True).collect()}
    assert [got[i].n_removed for i in range(1, 7)] == [0, 40, 0, 7, 0, 0]
    assert got[2].text == "own head\nown tail" and got[4].text == "other head\nother tail"
