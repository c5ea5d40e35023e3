import numpy as np
import pytest

from fluxtone.llm import quality

SCHEMA = "doc_id long, text string, quality int, score string"


def test_prior_and_risk_on_known_mixture():
    rng = np.random.default_rng(2)
    pos, neg = rng.normal(1.5, 1, (3000, 4)), rng.normal(-1.5, 1, (3000, 4))
    unl = np.concatenate([pos[:1200], neg[:1800]])  # 40 percent are positive
    model = quality.train(pos[1500:].astype(np.float32), rng.permutation(unl).astype(np.float32))
    assert model.prior == pytest.approx(0.4, abs=0.08)
    test_pos, test_neg = rng.normal(1.5, 1, (500, 4)), rng.normal(-1.5, 1, (500, 4))
    assert (model.scores(test_pos) >= 0.5).mean() > 0.95 and (model.scores(test_neg) < 0.5).mean() > 0.95


def test_features_do_not_depend_on_the_batch():
    texts = [b"One two THREE! | x", None, b"", "été 12\n".encode() * 500, b"a a a b"]
    alone = np.concatenate([quality.features([t]) for t in texts])
    assert np.allclose(alone, quality.features(texts), atol=1e-6)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").repartition(4), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.score_quality(docs, labels).join(labels, "doc_id").where("held_out and quality is not null").collect()
    assert len(rows) > 500
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.96
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_defined_cases(spark):
    docs = [(i, t, 0, "x") for i, t in enumerate([None, "", " ", "some words here.", "w " * 60000] * 6)] + [(3, "some words here.", 1, "x"), (None, "no id", 1, "x")]
    df = spark.createDataFrame(docs, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(3, None, 0), (None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(df, labels).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[3]) == 1 and by[0] == by[1]
    none = quality.score_quality(df, labels.where("quality = 0")).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {0}
    assert quality.score_quality(df.limit(0), labels).collect() == []
    assert quality.score_quality(df, labels.limit(0)).count() == len(docs)


def test_a_label_on_many_texts_teaches_no_more_than_the_bound(spark, monkeypatch):
    monkeypatch.setattr(quality, "MOST", 40)
    sizes = []
    train = quality.train
    monkeypatch.setattr(quality, "train", lambda pos, unl: sizes.append((len(pos), len(unl))) or train(pos, unl))
    collected = []
    to_pandas = type(spark.range(1)).toPandas
    monkeypatch.setattr(type(spark.range(1)), "toPandas", lambda self: (lambda found: collected.append(len(found)) or found)(to_pandas(self)))
    docs = spark.range(4000).selectExpr("if(id % 2 = 0, 1, id) as doc_id", "concat('some text of words number ', id) as text")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    quality.fit(docs, labels)
    assert collected and max(collected) < 4 * 40 and sizes[0][0] <= 40 and sizes[0][1] <= 40
