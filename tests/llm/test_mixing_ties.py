"""Rows that share doc_id, source and size but not text: which of them is taken is a function of the rows alone."""

from collections import Counter

from fluxtone.llm import mixing


def test_ties_do_not_depend_on_the_order_of_rows(spark):
    rows = [(1, f"{w} x y", "s0", f"extra {w}") for w in "abcdefghij"] + [(2, "p q r", "s1", None), (None, "k l m", None, "n"), (None, "m l k", None, "n"), (3, "u v w x", "s1", "e")]
    make = lambda r, n: spark.createDataFrame(r, "doc_id long, text string, source string, size string").repartition(n)
    results = [Counter(map(tuple, mixing.mixed(make(r, n)).collect())) for r, n in ((rows, 1), (rows[::-1], 3), (rows[5:] + rows[:5], 4))]
    assert results[0] == results[1] == results[2]
    taken = {}
    for r in mixing.copies(make(rows, 2)).collect():
        taken[r.doc_id, r.source] = taken.get((r.doc_id, r.source), 0) + r.copies
    counts = Counter()
    for (i, _, s, _), n in results[0].items():
        counts[i, s] += n
    assert {k: v for k, v in taken.items() if v} == dict(counts)
