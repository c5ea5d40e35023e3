import random
import re
from collections import Counter
from fractions import Fraction

import pytest

from fluxtone.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, g int"


def brute(rows, most=200):
    docs = [(lang or "", source or "", re.findall("[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        with_it = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t in with_it if with_it[t] >= 3)
        v = len(kept)
        group = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in set(kept)) for s in {d[1] for d in own}}
        whole = sum(group.values(), Counter())
        p = lambda c, t: 1 + Fraction(10**9 * (c[t] + 1), sum(c.values()) + v).__floor__()
        f = lambda x, y: (x - y) ** 2 // y
        for s, c in group.items():
            pairs = [(o, sum(f(p(c, t), p(e, t)) for t in kept)) for o, e in group.items() if o != s]
            terms = [(t, f(p(c, t), p(whole, t))) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, found, limit in (("pair", pairs, None), ("term", terms, most)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:limit])]
    return sorted(out)


def made(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["Été", "été", "ÉTÉ", "日本", "The", "THE", "the"]
    rows = []
    for i in range(n):
        source = rng.choice(["s0"] * 6 + [f"s{j}" for j in range(9)] + ["é", "~"])
        text = " ".join(rng.choice(words[: 20 + 10 * (i % 11)] if source == "s0" else words) + rng.choice(["", "1", "-", " ", "\x00"]) for _ in range(rng.randrange(60)))
        rows.append((i, text, rng.choice(["en", "en", "de", None]), source, "x", 1))
    return [*rows, (None, None, None, None, "x", 1), (1, "the the", "", None, "x", 1), (1, "the the", "", None, "x", 1), (5, "", "xx", "lone", "x", 1), (6, "once", "xx", "other", "x", 1), (7, "a" * 100_000 + " the", "de", "s1", "x", 1)]


@pytest.mark.parametrize(("light", "block"), [(8, 512), (2, 3), (0, 2)])
def test_matches_brute_force_at_any_split_of_heavy_and_light(spark, monkeypatch, light, block):
    monkeypatch.setattr(divergence, "LIGHT", light)
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "TILE", 64 if light < 8 else 1 << 16)
    rows = made(light)
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(4), most=30)
    assert sorted(map(tuple, got.collect())) == brute(rows, 30)


def test_tasks_hand_counts_on_before_they_hold_too_many(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 10)
    rows = made(9, 60)
    batches = spark.createDataFrame(rows, SCHEMA).selectExpr("coalesce(lang, '') lang", "coalesce(source, '') source", "coalesce(text, '') text").toArrow().to_batches()
    total = Counter()
    for b in divergence._count(iter(batches)):
        for r in b.to_pylist():
            total[r["lang"], r["source"], r["term"]] += r["count"]
    want = Counter((lang or "", s or "", t) for _, text, lang, s, *_ in rows for t in re.findall("[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
    assert total == want


def test_long_division_is_exact_for_large_counts(spark):
    pairs = [(10**9, 10**9 + 5), (9 * 10**15 - 2, 9 * 10**15), (0, 9 * 10**15), (123_456_789_012_345, 987_654_321_098_765), (0, 1)]
    df = spark.createDataFrame(pairs, "count long, whole long")
    got = [r[0] for r in df.select(divergence.share(df["count"], df["whole"])).collect()]
    assert got == [1 + 10**9 * (c + 1) // w for c, w in pairs]


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
