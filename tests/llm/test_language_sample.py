"""The hashes up to which a language's texts teach, over many tasks."""

import random

from fluxtone.llm import language_id


def test_limits_are_those_of_the_least_hashes(spark, monkeypatch):
    monkeypatch.setattr(language_id, "ROWS_EACH", 7)
    rng = random.Random(1)
    rows = [(lang, rng.randrange(-(2**63), 2**63)) for lang, n in (("a", 2000), ("b", 5), ("c", 8)) for _ in range(n)]
    rows += [("d", m) for m in (-(2**63), 2**63 - 1, 0, -1, 5)] + [("a", m) for _, m in rows[:300]]
    got = {r.lang: r.limit for r in language_id._chosen(spark.createDataFrame(rows, "lang string, mark long").repartition(16))}
    assert got == {lang: sorted({m for x, m in rows if x == lang})[:7][-1] for lang in "abcd"}
