"""A stream cut anywhere decodes as the whole."""

import random

import pytest
from pyspark.sql import functions as F

from fluxtone.functions import adaptive
from fluxtone.operators import packet_codecs


@pytest.mark.parametrize(("codec", "bits"), [("ima", 4), ("g726", 2), ("g726", 3), ("g726", 4), ("g726", 5)])
def test_any_cuts_decode_alike(spark, codec, bits):
    rng = random.Random(bits)
    data = bytes(rng.randrange(256) for _ in range(300))
    whole = spark.createDataFrame([(bytearray(data),)], "b binary")
    codes = adaptive.unpack_codes(F.col("b"), bits)
    want = whole.select((adaptive.ima_decode(codes) if codec == "ima" else adaptive.g726_decode(codes, bits)).alias("v")).first().v
    rows = []
    for stream in range(4):
        cuts = sorted(rng.sample(range(1, 300), [0, 5, 60, 299][stream]))
        pieces = [data[a:b] for a, b in zip([0, *cuts], [*cuts, 300], strict=True)]
        rows += [(stream, n, bytearray(p)) for n, p in enumerate([b"", *pieces])]
    rows += [(9, 0, None)]
    got = {}
    for r in packet_codecs.decode(spark.createDataFrame(rows, "stream long, frame long, b binary").repartition(5), codec, bits).orderBy("stream", "frame").collect():
        got.setdefault(r.stream, []).extend(r.v)
    assert got == {**dict.fromkeys(range(4), want), 9: []}
