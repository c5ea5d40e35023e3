"""The join with many small blocks and squares, so that every path for large groups runs, against brute force."""

import random

import numpy as np
from test_ngram_join import SCHEMA, brute

from fluxtone.llm import ngram_join
from fluxtone.llm.common import stored


def families(seed):
    """Texts around a shared passage; families of edits whose centre is missing; words that most rows have."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for size, edits in ((40, 3), (25, 5), (1, 0), (15, 1)):
        base = [rng.choice(vocabulary) for _ in range(80)]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randint(1, edits + 1)):
                text[rng.randrange(len(text))] = f"own{rng.random()}"
            rows.append((len(rows), " ".join(text if rng.random() < 0.5 else text + passage), ""))
    for _ in range(40):  # a passage with a few words of their own
        rows.append((len(rows), " ".join([*passage, *(f"own{rng.random()}" for _ in range(rng.randint(2, 8)))]), ""))
    rng.shuffle(rows)
    return rows


def test_many_blocks_and_squares_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 5000)
    monkeypatch.setattr(ngram_join, "SQUARE", 7)
    rows = families(9)
    for k, percent in ((4, 85), (5, 80)):
        got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA).repartition(3), k, percent)
        assert sorted(map(tuple, got.collect())) == brute(rows, k, percent)


def test_texts_that_share_a_doc_id_are_judged_apart(spark):
    words = [f"w{i}" for i in range(60)]
    near, other = " ".join([*words[:-1], "x"]), " ".join(f"v{i}" for i in range(40))
    rows = [(1, " ".join(words), "a"), (2, near, "b"), (2, other, "c"), (None, other.upper(), "d"), (None, "z " + " ".join(words), "e"), (2, near, "b"), (7, None, "f"), (7, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    got = sorted(map(tuple, ngram_join.ngram_jaccard_join(docs, 5, 80).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (2, 2), (None, 2), (None, 1), (2, 1), (7, 7), (7, 7)], key=str)
    kept = sorted(r.mark for r in ngram_join.drop_near_copies(docs, 5, 80).collect())
    assert kept == ["a", "c", "f", "g"]
    assert ngram_join.drop_near_copies(docs, 5, 80).columns == docs.columns


def test_counts_are_exact_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 4000)
    docs = spark.createDataFrame(families(3), SCHEMA).select("doc_id", "text")
    dealt, bits, range_bits = ngram_join._dealt(docs)
    dealt = stored(dealt, "dealt")
    got, want = {}, {}
    for row in ngram_join._common(dealt, 4, bits, range_bits).collect():
        for p, v in zip(ngram_join.unpack(row.prints), ngram_join._counts(row.levels), strict=True):
            assert got.setdefault(int(p), int(v)) == v
    for row in dealt.collect():
        for h in ngram_join.batch_shingles([row.text.encode()], 4)[0]:
            short = int(h >> np.uint64(64 - bits))
            want[short] = want.get(short, 0) + 1
    assert len({r.block for r in dealt.collect()}) > 3
    assert got == {p: n for p, n in want.items() if n > 1}


def test_packing_of_numbers():
    rng = np.random.default_rng(1)
    for x in ([], [0], [2**64 - 1], [0, 0, 5], sorted(rng.integers(0, 2**40, 1000)), [1, 2**63, 2**64 - 1]):
        assert ngram_join.unpack(ngram_join.pack(np.array(x, np.uint64))).tolist() == list(map(int, x))
    assert ngram_join._level(np.array([1, 2, 32767, 32768, 65536, 10**12])).tolist()[:5] == [1, 2, 32767, 32768, 33280]
