import numpy as np

from fluxtone.llm import language_id as lid

SCHEMA = "doc_id long, text string, lang string, score string, n int"


def test_gradients_by_differences():
    net = lid.Network.start(["a", "b", "c"], 3)
    for name in ("table", "hidden", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    rng = np.random.default_rng(0)
    x = rng.integers(97, 103, (7, 5)).astype(np.uint8)
    goal, weight = rng.integers(0, 3, 5), (rng.random((7, 5)) < 0.8).astype(np.float64)

    def loss():
        p = net.probabilities(net.states(x).astype(np.float64))
        return -(np.log(p[:, goal, np.arange(5)]) * weight).sum() / weight.sum()

    for w, g in zip(net.weights(), net.gradients(x, goal, weight), strict=True):
        for at in list(zip(*np.nonzero(np.abs(g) > np.abs(g).max() / 3), strict=True))[:6]:
            old, eps = w[at], 1e-2
            w[at] = old + eps
            up = loss()
            w[at] = old - eps
            down = loss()
            w[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 2e-3 + 0.05 * abs(g[at])


def test_held_out_accuracy_and_schema(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)
    net = lid.fit(docs)
    rows = lid.identify(docs, net).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    # whole texts: a long text of two languages is scored by both parts, however texts are batched
    en, de = (docs.where(f"lang = '{x}' and n_chars > 3000").orderBy("doc_id").first().text[:3000] for x in ("en", "de"))
    one, many = lid.score_texts(net, [(en + " " + de).encode()])[0], lid.score_texts(net, [b"x", (en + " " + de).encode(), None, en.encode(), b""])
    assert np.allclose(one, many[1], atol=1e-4) and 0.3 < one[net.languages.index("en")] < 0.7
    assert not many[2].any() and not many[4].any()


def test_defined_cases(spark):
    rows = [(i, t, l, "s", 1) for i, (t, l) in enumerate([("the and of that with " * 9, "en"), ("der und die nicht " * 9, "de"), (None, "en"), ("", "de"), ("12 !? ...\n", "en"), ("été", None), ("der und " * 40000, "de"), ("the", "en")] * 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in lid.identify(df).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in text or "")), i
        assert got[i].lang_pred != "und" or got[i].score == 0
    assert got[6].lang_pred == "de" and got[7].lang_pred == "en"
    kept = lid.keep_known(df, 0.4)
    assert kept.columns == df.columns and kept.count() == 4 * 5
    assert lid.identify(spark.createDataFrame([], SCHEMA)).collect() == []
    assert {r.lang_pred for r in lid.identify(spark.createDataFrame([(1, "abc", None, "", 1)], SCHEMA)).collect()} == {"und"}
