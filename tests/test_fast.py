"""Fast transforms against their sum forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxtone.functions import fast
from fluxtone.operators import blocks


def rows_of(spark, lists):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(lists)], "id long, x array<double>")


@pytest.mark.parametrize("size", [1, 2, 3, 8, 60, 77, 480])
def test_transform_and_back(spark, size):
    x = np.random.default_rng(size).normal(size=(3, size))
    df = rows_of(spark, x).withColumn("x", fast.complex_of(F.col("x")))
    there = fast.fft(df, "x", size)
    got = np.array([[complex(v.re, v.im) for v in r.x] for r in there.orderBy("id").collect()])
    assert np.allclose(got, np.fft.fft(x, axis=1))
    back = fast.fft(there, "x", size, inverse=True)
    assert np.allclose([[v.re for v in r.x] for r in back.orderBy("id").collect()], x)


@pytest.mark.parametrize("half", [4, 12, 36, 960])
def test_mdct_is_its_sum_form(spark, half):
    x = np.random.default_rng(half).normal(size=(2, 2 * half))
    n, k = np.arange(2 * half), np.arange(half)
    basis = np.cos(np.pi / half * (n[:, None] + 0.5 + half / 2) * (k[None, :] + 0.5))
    got = fast.mdct(rows_of(spark, x), "x", half).orderBy("id").collect()
    assert np.allclose([r.x for r in got], x @ basis)
    c = x[:, :half]
    got = fast.imdct(rows_of(spark, c), "x", half).orderBy("id").collect()
    assert np.allclose([r.x for r in got], c @ basis.T)


def test_streams_come_back_from_their_spectra(spark):
    rng = np.random.default_rng(5)
    streams = {1: rng.normal(size=100), 2: rng.normal(size=24), 3: rng.normal(size=1)}
    df = spark.createDataFrame([(s, n, float(v)) for s, x in streams.items() for n, v in enumerate(x)], "stream long, n long, x double").repartition(3)
    c = blocks.spectra(df, 24)
    assert {r.stream: r["count"] for r in c.groupBy("stream").count().collect()} == {1: 6, 2: 2, 3: 2}
    back = {(r.stream, r.n): r.x for r in blocks.samples(c, 24).collect()}
    assert all(abs(back[s, n] - v) < 1e-9 for s, x in streams.items() for n, v in enumerate(x))
    assert all(abs(v) < 1e-9 for (s, n), v in back.items() if n >= len(streams[s]))


def test_a_gap_counts_as_silence(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 20, 2.0)], "stream long, n long, x double")
    back = {r.n: round(r.x, 9) for r in blocks.samples(blocks.spectra(df, 8), 8).collect()}
    assert back.pop(0) == 1.0 and back.pop(20) == 2.0 and not any(back.values())


def test_factors():
    assert fast.factors(480) == [4, 4, 2, 3, 5] and fast.factors(1) == [] and fast.factors(121 * 13) == [11, 11, 13]
