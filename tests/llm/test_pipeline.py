"""Each stage of the pipeline on all that its predecessor kept, held against plain Python."""

import importlib
import re
import zlib

import numpy as np
import pytest

from fluxtone.llm.common import stored

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def grams(text, k=5):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, None, None, 0), (10_002, "123 !?", "en", "src0", 6), (10_003, "", "en", "src0", 0)], docs.schema)
    docs = docs.unionByName(extra)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "packing"]
    assert len({f for _, f in corpus_pipeline.STAGES}) == 5
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], SF)
        assert out.columns == COLUMNS, name
        kept.append(stored(out, "test"))
    rows = [{(r.doc_id, r.text) for r in d.collect()} for d in kept]
    counts = [d.count() for d in kept]
    # language: texts without a letter go, clean ones stay
    assert {i for i, _ in rows[0] - rows[1]} >= {10_001, 10_002, 10_003} and len(rows[1]) >= 0.98 * (len(rows[0]) - 3)
    # exact: one of each normalised text, the longest, then the smallest id
    groups = {}
    for i, t in rows[1]:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t), []).append((-len(t), i))
    assert {i for i, _ in rows[2]} == {min(g)[1] for g in groups.values()}
    # near: the smallest id of each group stays
    sets, least = {i: grams(t) for i, t in rows[2]}, {i: i for i, _ in rows[2]}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in links:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert {i for i, _ in rows[3]} == {i for i, x in least.items() if x == i}
    # mix: only rows of the input, none more than twice
    assert rows[4] <= rows[3] and all(r["count"] <= 2 for r in kept[4].groupBy("doc_id").count().collect()) and counts[4] > 0
    # packing: every token of every row once
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept[4], SF).collect()
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
    assert sum(r.start == 0 for r in pieces) == counts[4]


def test_run_and_registration(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(rows[0].asDict())
    again = corpus_pipeline.run(spark, SF).collect()
    assert zlib.crc32(np.sort([r.ids_crc32 for r in rows]).tobytes()) == zlib.crc32(np.sort([r.ids_crc32 for r in again]).tobytes())


def test_every_operator_is_registered():
    entry = importlib.import_module("__spark_entry__")
    names = {re.match(r"op(\d+)_", q)[1] for q in entry.queries() if re.match(r"op\d+_", q)}
    assert names == {str(n) for n in range(1, 14)}


def test_clashing_columns_and_repeated_rows_go_through_all_stages(spark):
    texts = [f"In the {w} of the year the people of the town read about {w} and other things, and then they went home again to sleep for {i} hours." for i, w in enumerate(("spring", "summer", "autumn", "winter") * 5)]
    rows = [(i % 15, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += rows[:4] * 3 + [(None, texts[0], None, None, 1), (None, texts[0], None, None, 1), (3, "", "en", "s1", 0), (4, None, "en", "s1", 0)]
    names = ["row", "key", "mark", "copies", "digest", "content", "points", "size", "turn", "block", "_id", "node", "label", "lang_pred"]
    docs = spark.createDataFrame([(*r, *[f"x{i}"] * len(names)) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, kept, SF), "test")
        assert kept.columns == docs.columns, name
        assert kept.exceptAll(docs).where("false").count() == 0 and kept.join(docs, docs.columns, "left_anti").where("doc_id is not null").count() == 0
    left = kept.select("text").distinct().count()
    assert 0 < left <= len(set(texts))
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert sum(r.start == 0 for r in pieces) == kept.count()
