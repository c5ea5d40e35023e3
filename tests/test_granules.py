"""Hybrid synthesis against a plain decoder that keeps its state from granule to granule."""

import numpy as np

from fluxtone.operators import granules


def plain(stream):
    """Samples of (kind, lines) in order; None is a granule that is missing, after which all begins anew."""
    i36, out, after, past = np.arange(36), [], np.zeros((32, 18)), np.zeros((15, 64))
    long, short = np.sin(np.pi / 36 * (i36 + 0.5)), np.sin(np.pi / 12 * (np.arange(12) + 0.5))
    start = np.concatenate([long[:18], np.ones(6), short[6:], np.zeros(6)])
    for item in stream:
        if item is None:
            after, past = np.zeros((32, 18)), np.zeros((15, 64))
            continue
        kind, lines = item
        z = np.zeros((32, 36))
        for band, x in enumerate(lines.reshape(32, 18)):
            if kind == 2:
                for w in range(3):
                    for i in range(12):
                        z[band, 6 + 6 * w + i] += sum(x[3 * k + w] * np.cos(np.pi / 24 * (2 * i + 7) * (2 * k + 1)) for k in range(6)) * short[i]
            else:
                z[band] = [sum(x[k] * np.cos(np.pi / 72 * (2 * i + 19) * (2 * k + 1)) for k in range(18)) for i in range(36)]
                z[band] *= start if kind == 1 else start[::-1] if kind == 3 else long
        s, after = z[:, :18] + after, z[:, 18:]
        s[1::2, 1::2] *= -1
        y = []
        for slot in s.T:
            v = [sum(slot[k] * np.cos(np.pi / 64 * (n + 16) * (2 * k + 1)) for k in range(32)) for n in range(64)]
            past = np.concatenate([past[-15:], [v]])
            y += [sum(past[-1 - i][j + 32 * (i % 2)] * np.sin(np.pi / 512 * (j + 32 * i + 0.5)) for i in range(16)) for j in range(32)]
        out.append(y)
    return np.array(out)


def test_streams_of_granules(spark):
    rng = np.random.default_rng(8)
    one = [(k, rng.normal(size=576)) for k in (0, 1, 2, 3)]
    two = [(2, rng.normal(size=576)), None, (0, rng.normal(size=576))]
    rows = [(s, g, item[0], item[1].tolist()) for s, stream in ((1, one), (2, two)) for g, item in enumerate(stream) if item]
    df = spark.createDataFrame(rows, "stream long, granule long, kind int, lines array<double>").repartition(3)
    got = granules.synthesis(granules.subbands(df)).orderBy("stream", "granule").collect()
    assert np.allclose(np.array([r.y for r in got]), np.concatenate([plain(one), plain(two)]))
