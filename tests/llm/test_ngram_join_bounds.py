"""How much work the join makes: verification passes, repeated rows, pairs verified again."""

import random
from collections import Counter

import pytest
from test_ngram_join import SCHEMA, brute

from fluxtone.llm import ngram_join


def behind_common(groups, seed=4):
    """Pairs of near copies whose only shared prefix n-grams are those that all groups have."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(12)]
    rows = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(30)]
        for c in range(2):
            own = [f"o{g}x{c}y{rng.random()}"] * 1
            rows.append((len(rows), " ".join([*own, *common, *base]), ""))
    return rows


@pytest.mark.parametrize("groups", [6, 60])
def test_passes_do_not_grow_with_groups_behind_a_common_ngram(spark, monkeypatch, groups):
    passes, pairs = [], Counter()
    verified = ngram_join._verified

    def counted(*args):
        found = verified(*args)
        passes.append(found.count())
        pairs.update((str(r.a), str(r.b)) for r in found.collect())
        return found

    monkeypatch.setattr(ngram_join, "_verified", counted)
    rows = behind_common(groups)
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA).repartition(3), 4, 85)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 85)
    assert len(passes) == ngram_join.HUB_ROUNDS + 1
    assert max(pairs.values()) == 1  # once per pair


def test_many_rows_without_doc_id_and_text_are_one_row_a_task(spark):
    rows = spark.range(10_000).selectExpr("cast(null as long) as doc_id", "if(id % 2 = 0, '', cast(null as string)) as text").repartition(8)
    some = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (6, "a b c d e f")], "doc_id long, text string")
    docs = rows.union(some)
    dealt, *_ = ngram_join._dealt(docs)
    assert dealt.groupBy("block").count().selectExpr("max(count)").first()[0] <= 60
    assert dealt.selectExpr("sum(copies)").first()[0] == 10_003
    got = Counter(map(tuple, ngram_join.ngram_jaccard_join(docs, 4, 85).collect()))
    assert got == {(None, 0, None): 10_000, (5, 3, 5): 2, (6, 3, 5): 1}


def test_a_task_forgets_and_hands_on_what_it_holds(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "KNOWN", 3)
    monkeypatch.setattr(ngram_join, "HELD", 40)
    docs = spark.range(600).selectExpr("id % 7 as doc_id", "repeat(cast(id % 5 as string), 20) as text").coalesce(1)
    batches = docs.toArrow().to_batches(max_chunksize=50)
    got, want = Counter(), Counter((r.doc_id, r.text) for r in docs.collect())
    for b in ngram_join._together(iter(batches)):
        for r in b.to_pylist():
            got[r["doc_id"], r["text"]] += r["copies"]
    assert got == want
