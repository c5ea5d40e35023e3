import random
import re

from fluxtone.llm.ngram_join import ngram_jaccard_join

SCHEMA = "doc_id long, text string, n string"


def brute(rows, k, percent):
    def grams(text):
        words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())

    sets = [(i, grams(t)) for i, t, *_ in rows]
    least = {i: i for i, _ in sets}
    links = [(a, b) for a, x in sets for b, y in sets if x and y and 100 * len(x & y) >= percent * len(x | y)]
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return sorted((i, len(s), least[i]) for i, s in sets)


def test_families_with_edits_match_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["Über", "été"]
    rows, at = [], 0
    for size in (1, 1, 1, 30, 12, 40, 2, 5):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((at, "  ".join(text).upper() if rng.random() < 0.2 else "\n".join(text), "x"))
            at += 1
    rng.shuffle(rows)
    for k, percent in ((4, 85), (5, 80)):
        got = ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA).repartition(5), k, percent)
        assert sorted(map(tuple, got.collect())) == brute(rows, k, percent)


def test_defined_cases(spark):
    rows = [(5, "a b", "x"), (3, "A  b", "x"), (7, None, None), (8, "", "x"), (9, " \n\t", "x"), (1, "one two three four five " * 3000, "y"), (2, "one two three four five " * 2999, "y"), (3, "A  b", "x")]
    got = sorted(map(tuple, ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA), 4, 85).collect()))
    assert got == sorted(brute(rows, 4, 85))
    assert [x[2] for x in got] == [1, 1, 3, 3, 3, 7, 8, 9]
    assert ngram_jaccard_join(spark.createDataFrame([], SCHEMA), 4, 85).collect() == []
    null_id = sorted(map(tuple, ngram_jaccard_join(spark.createDataFrame([(None, "a b c d e", ""), (4, "a b c d e", ""), (None, "z", "")], SCHEMA), 4, 85).collect()), key=str)
    assert null_id == sorted([(None, 2, 4), (4, 2, 4), (None, 1, None)], key=str)
