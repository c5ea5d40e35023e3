"""Long payloads and arrays: results stay right, and time in proportion to the size."""

import time

import numpy as np
from pyspark.sql import functions as F

from fluxtone.functions import adaptive, bits, filters, headers
from fluxtone.operators import containers, packets, speech


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_fold_over_a_long_array_keeps_every_value(spark):
    x = F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda i: (i % 7).cast("double"))
    began = time.monotonic()
    got = np.array(spark.range(1).select(filters.envelope(x).alias("y")).first().y)
    assert time.monotonic() - began < 60
    want, e = [], 0.0
    for i in range(100_000):
        e = 0.99 * e + (1 - 0.99) * (i % 7)
        want.append(e)
    assert len(got) == 100_000 and np.allclose(got, want, rtol=1e-12)


def test_fold_at_the_bounds_of_parts(spark):
    for n in (0, 1, filters.PART - 1, filters.PART, filters.PART + 1, 3 * filters.PART):
        x = F.slice(F.transform(F.sequence(F.lit(0), F.lit(1000)), lambda i: i.cast("double")), F.lit(1), F.lit(n))
        assert len(one(spark, filters.envelope(x))) == n
    assert one(spark, filters.envelope(F.lit(None).cast("array<double>"))) is None


def test_payload_of_a_megabyte(spark):
    rows = spark.createDataFrame([(1, bytes(np.random.default_rng(3).integers(0, 250, 1 << 20, dtype=np.uint8)))], "id long, b binary").cache()
    whole = bytes(rows.first().b)
    began = time.monotonic()
    pieces = packets.packetize(rows).orderBy("k").collect()
    assert b"".join(bytes(r.payload) for r in pieces) == whole and [r.marker for r in pieces] == [False] * (len(pieces) - 1) + [True]
    frames = containers.pcm_frames(rows).orderBy("k").collect()
    assert b"".join(bytes(r.payload) for r in frames) == whole[: len(frames) * 320]
    pages = containers.ogg_pages(rows.select(F.col("id").alias("stream"), F.lit(0).alias("seq"), "b"))
    back = containers.ogg_packets(containers.join_chunks(pages.select(F.col("stream").alias("id"), F.col("number").alias("k"), F.col("page").alias("payload")))).collect()
    assert len(back) == 1 and bytes(back[0].payload) == whole and back[0].good
    samples = rows.select("id", containers.mp4_file(F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda i: F.substring("b", i * 256 + 1, F.lit(256)))).alias("b"))
    got = containers.mp4_samples(samples).orderBy("sample").collect()
    assert len(got) == 4096 and b"".join(bytes(r.payload) for r in got) == whole
    assert one(spark, headers.sync_places(F.concat(F.lit(b"\x00" * 300_000), F.lit(b"\xff\xfb\x90")))) == [300_000]
    assert time.monotonic() - began < 120


def test_every_header_line_counts(spark):
    text = "RTSP/1.0 200 OK\r\n" + "".join(f"H{i}: v{i}\r\n" for i in range(1500)) + "\r\nbody"
    got = one(spark, packets.parse_response(F.lit(text)))
    assert len(got.headers) == 1500 and got.headers["h1499"] == "v1499" and got.body == "body"


def test_codes_and_bits_as_bytes(spark):
    for width in (1, 2, 3, 4, 5, 7):
        codes = [i * 5 % (1 << width) for i in range(37)]
        packed = bits.pack_codes(F.array(*[F.lit(c) for c in codes]), width)
        digits = "".join(f"{c:0{width}b}" for c in codes)
        digits += "0" * (-len(digits) % 8)
        assert bytes(one(spark, packed)) == int(digits, 2).to_bytes(len(digits) // 8, "big")
        assert one(spark, bits.unpack_codes(packed, width))[:37] == codes
    assert bytes(one(spark, bits.pack_codes(F.array().cast("array<int>"), 3))) == b"" and one(spark, bits.unpack_codes(F.lit(b""), 3)) == []
    assert bytes(one(spark, bits.from_bits(F.lit("1010000011")))) == b"\xa0\xc0"
    assert bytes(one(spark, bits.joined(F.array(F.lit(b"a"), F.lit(b""), F.lit(None).cast("binary"), F.lit(b"bc"))))) == b"abc"


def test_codec_state_goes_on_from_frame_to_frame(spark):
    v = [int(9000 * np.sin(i / 5)) for i in range(80)]
    arrays = [F.array(*[F.lit(x) for x in part]) for part in (v, v[:41], v[41:])]
    whole = one(spark, adaptive.g726_encode(arrays[0], 3))
    first = one(spark, adaptive.g726_encode(arrays[1], 3))
    value = one(spark, adaptive.g726_decode(F.array(*[F.lit(c) for c in first]), 3))[-1]
    index = 0
    for c in first:
        index = min(88, index + adaptive.G726_CHANGE[min(7, 3 - c if c < 4 else c - 4)])
    state = (F.lit(value), F.lit(index))
    assert first + one(spark, adaptive.g726_encode(arrays[2], 3, state)) == whole
    back = one(spark, adaptive.g726_from_stream(adaptive.g726_stream(arrays[2], 3, state), 3, state))
    assert back[:39] == one(spark, adaptive.g726_decode(F.array(*[F.lit(c) for c in whole]), 3))[41:]
    stream = adaptive.ima_stream(F.array(*[F.lit(x) for x in v[:5]]), (F.lit(-300), F.lit(40)))
    raw = bytes(one(spark, stream))
    assert raw[:4] == (-300).to_bytes(2, "little", signed=True) + bytes([40, 0]) and len(raw) == 4 + 3
    assert len(one(spark, adaptive.ima_from_stream(stream))) == 6 and one(spark, adaptive.ima_from_stream(F.lit(b"abc"))) is None


def test_headers_of_unknown_vendors_fall_back(spark):
    rows = spark.createDataFrame([(b"12345", None), (b"12345", "nobody"), (b"12345", "dahua")], "b binary, chip string")
    got = [bytes(r.x) for r in rows.select(headers.chip_add(F.col("b"), F.col("chip")).alias("x")).collect()]
    assert got == [b"\x00\x01\x02\x0012345"] * 2 + [b"\x00\x01\x01\x00\x05\x0012345"]


def test_streams_pass_in_batches_as_they_do_whole(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.2, 900)
    rows = spark.createDataFrame([(s, i, float(v)) for s in (1, 2) for i, v in enumerate(x[: 900 if s == 1 else 20])], "stream long, n long, x double")
    echo = rows.withColumn("x", 0.6 * F.col("x"))
    results = []
    for size in (10_000, 37):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        results.append([sorted(map(tuple, speech.suppress_noise(rows, size=64).collect())), sorted(map(tuple, speech.cancel_echo(echo, rows, 16).collect()))])
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    (noise, left), again = results
    assert len(noise) == len(left) == 920
    for one_way, other in zip((noise, left), again, strict=True):
        assert np.allclose(np.array(one_way, float), np.array(other, float), atol=1e-12)
    assert [y for s, _, y in noise if s == 2] == list(x[:20])  # shorter than a frame
    assert np.sum([y * y for s, n, y in left if s == 1 and n > 600]) < 0.05 * np.sum((0.6 * x[600:]) ** 2)
