"""Many languages, large groups of copies, and no labels at all."""

import random

from fluxtone.llm import language_id as lid

SCHEMA = "doc_id long, text string, lang string"


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(lid, "STEPS", 40)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["abc", "bcd", "cab"]) for _ in range(20)), f"l{i % 70:02d}") for i in range(700)]
    rows += [(700 + i, " ".join(rng.choice(["žžž", "žž", "žžžž"]) for _ in range(20)), "rare") for i in range(8)]
    net = lid.fit(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert net.languages == sorted({r[2] for r in rows})
    assert lid._predict(net, __import__("pyarrow").array(["žžž žž žžžž žž žžž"]))[0] == ["rare"]


def test_copies_take_no_room_from_others(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(lid, "train", lambda cuts, langs: seen.update(cuts=cuts, langs=langs) or lid.Network.start(sorted(set(langs))))
    monkeypatch.setattr(lid, "ROWS_EACH", 20)
    rows = [(i, "the one copy", "en") for i in range(3000)] + [(5000 + i, f"text number {i}", "en") for i in range(100)] + [(9000 + i, f"der text {i}", "de") for i in range(12)]
    lid.fit(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert len(seen["cuts"]) == len(set(seen["cuts"])) and seen["langs"].count("en") == 20 and 5 <= seen["langs"].count("de") <= 12


def test_without_labels_texts_with_letters_stay(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, "12 !?", None), (3, None, None), (4, "été", None)], SCHEMA)
    assert sorted(r.doc_id for r in lid.keep_known(docs, 0.4).collect()) == [1, 4]
