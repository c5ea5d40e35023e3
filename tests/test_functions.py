"""Known answers, round trips and bounds."""

import math

import pytest
from pyspark.sql import functions as F

from fluxtone.functions import adaptive, bits, filters, g711, headers, signal, spectral
from fluxtone.operators import containers, mixing, packets, prediction, speech
from fluxtone.operators.registry import CodecRegistry, codec_table, default_registry
from fluxtone.sources.files import read_files, write_files


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def samples(spark, values):
    return spark.createDataFrame([(list(values),)], "v array<int>")


def test_g711_all_samples(spark):
    v = F.col("id").cast("int") - 32768
    rows = spark.range(65536).select(v.alias("v"), g711.alaw_encode(v).alias("a"), g711.ulaw_encode(v).alias("u"))
    rows = rows.withColumn("ab", F.abs(g711.alaw_decode(F.col("a")) - F.col("v"))).withColumn("ub", F.abs(g711.ulaw_decode(F.col("u")) - F.col("v")))
    r = rows.agg(F.min("a"), F.max("a"), F.min("u"), F.max("u"), F.max("ab"), F.max(F.when(F.abs("v") < 32124, F.col("ub"))), F.countDistinct("a"), F.countDistinct("u")).first()
    assert (r[0], r[1], r[2], r[3]) == (0, 255, 0, 255) and r[4] <= 512 and r[5] <= 1024 and r[6] == 256 and r[7] >= 255
    assert one(spark, g711.alaw_encode(F.lit(0))) == 0xD5 and one(spark, g711.ulaw_encode(F.lit(0))) == 0xFF and one(spark, g711.ulaw_encode(F.lit(-1))) == 0x7E


def test_pcm_and_channels(spark):
    assert one(spark, signal.float_to_pcm16(F.array(F.lit(1.5), F.lit(-2.0), F.lit(0.5), F.lit(-0.00005)))) == [32767, -32768, 16383, -1]
    back = one(spark, signal.pcm16_to_float(F.array(F.lit(32767), F.lit(-32768))))
    assert back[0] > 0.99 and back[1] == -1.0
    assert one(spark, signal.mono_to_stereo(F.array(F.lit(0.5), F.lit(-0.3)))) == [0.5, 0.5, -0.3, -0.3]
    assert one(spark, signal.stereo_to_mono(F.array(*map(F.lit, (1.0, 0.0, 0.5, 0.5, 9.0))))) == [0.5, 0.5]
    assert signal.gain_of_db(0) == 1 and abs(signal.gain_of_db(-6) - 0.5) < 0.01 and signal.db_of_gain(0) == -80
    assert signal.semitones_to_ratio(12) == 2 and signal.semitones_to_ratio(-12) == 0.5
    assert one(spark, signal.volume(F.array(F.lit(0.5), F.lit(-0.9)), 2.0, 0.8)) == [0.8, -0.8]
    assert one(spark, signal.volume(F.array(F.lit(0.5)), 2.0, mute=True)) == [0.0]


@pytest.mark.parametrize(("n", "rate_in", "rate_out", "count"), [(160, 8000, 16000, 320), (100, 8000, 8000, 100), (480, 48000, 8000, 80)])
def test_resample_lengths(spark, n, rate_in, rate_out, count):
    out = samples(spark, range(n)).select(signal.resample_linear(F.col("v"), rate_in, rate_out)).first()[0]
    assert len(out) == count
    if rate_in == rate_out:
        assert out[:-1] == list(range(n - 1)) and out[-1] == 0


def test_adpcm_follows_a_sine_and_packs(spark):
    sine = [int(math.sin(2 * math.pi * i / 128) * 28000) for i in range(1024)]
    r = samples(spark, sine).select(adaptive.ima_encode(F.col("v")).alias("c")).select("c", adaptive.ima_decode(F.col("c")).alias("b"), adaptive.ima_pack(F.col("c")).alias("p")).first()
    assert len(r.b) == 1024 and max(abs(a - b) for a, b in zip(sine[64:], r.b[64:], strict=True)) < 8000 and len(r.p) == 1024
    assert samples(spark, [100] * 3).select(adaptive.ima_pack(adaptive.ima_encode(F.col("v")))).first()[0][-1] == "0"


@pytest.mark.parametrize("width", [2, 3, 4, 5])
def test_g726_and_g722_lengths(spark, width):
    noise = [((i * 1103515245 + 12345) % 6001) - 3000 for i in range(320)]
    r = samples(spark, noise).select(adaptive.g726_encode(F.col("v"), width).alias("c")).select("c", adaptive.g726_decode(F.col("c"), width).alias("b")).first()
    assert len(r.b) == 320 and all(0 <= c < 1 << width for c in r.c)
    r = samples(spark, noise).select(adaptive.g722_encode(F.col("v")).alias("c")).select("c", adaptive.g722_decode(F.col("c")).alias("b")).first()
    assert len(r.c) == 160 and len(r.b) == 320


def test_filters(spark):
    tone = lambda f: [math.sin(2 * math.pi * f * n / 8000) for n in range(400)]
    rows = spark.createDataFrame([("low", tone(100)), ("high", tone(3500))], "k string, x array<double>")
    lowpass = filters.Biquad.design("lowpass", 8000, 1000)
    energy = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v)
    got = {r.k: r.e for r in rows.select("k", (energy(filters.biquad(F.col("x"), lowpass)) / energy("x")).alias("e")).collect()}
    assert got["low"] > 0.9 and got["high"] < 0.05
    for kind in ("peaking", "lowshelf", "highshelf"):  # 0 dB is the identity
        f = filters.Biquad.design(kind, 8000, 1000, 0.7071, 0.0)
        assert f.b0 == pytest.approx(1) and f.b1 == pytest.approx(f.a1) and f.b2 == pytest.approx(f.a2)
    assert len(filters.ten_band(44100, [0] * 10)) == 10 and len(filters.ten_band(8000, [0] * 10)) == 7
    quiet = rows.select(F.array_max(filters.compressor(F.col("x"), 8000)).alias("m")).collect()
    assert all(r.m < 1 for r in quiet)
    loud = spark.createDataFrame([([0.9] * 100,)], "x array<double>").select(F.array_max(filters.automatic_gain(F.col("x"), 8000)).alias("m")).first()
    assert loud.m <= 1.0


def test_spectrum_of_a_sine(spark):
    rows = spark.range(1024).select(F.lit(1).alias("id"), F.col("id").cast("int").alias("n"), F.sin(2 * math.pi * 100 * F.col("id") / 8000).alias("x"))
    by = {r.k: r.magnitude for r in spectral.magnitude(spectral.dft(rows, 1024, bins=40)).collect()}
    assert by[12] > 10 and max(by, key=by.get) in (12, 13)
    assert one(spark, spectral.power_db(F.lit(0.0), 64)) == -120.0


def test_rice_levinson_restore(spark):
    rows = spark.range(-200, 200).select(F.col("id").alias("v"))
    assert rows.where(prediction.rice_decode(prediction.rice_code(F.col("v"))) != F.col("v")).count() == 0
    assert rows.where(F.length(prediction.rice_code(F.col("v"))) != prediction.rice_bits(F.col("v"))).count() == 0
    r = one(spark, prediction.levinson(F.array(*map(F.lit, (1.0, 0.5, 0.25))), 2))
    assert r.a == pytest.approx([0.5, 0.0]) and r.error == pytest.approx(0.75)
    assert one(spark, prediction.restore(F.array(F.lit(3), F.lit(5)).cast("array<long>"), F.array(F.lit(1), F.lit(-1)).cast("array<long>"), 2)) == [3, 5, 8, 10]


def test_packets(spark):
    payload = bytes.fromhex("aabbccdd")
    raw = packets.rtp_serialize(F.lit(True), F.lit(8), F.lit(12345), F.lit(67890), F.lit(0x12345678), F.lit(payload), F.array(F.lit(0x22222222).cast("long")))
    p = one(spark, packets.rtp_parse(raw))
    assert (p.version, p.marker, p.payload_type, p.seq, p.timestamp, p.ssrc, p.csrc, bytes(p.payload)) == (2, True, 8, 12345, 67890, 0x12345678, [0x22222222], payload)
    assert one(spark, packets.rtp_parse(F.lit(b"short"))) is None
    # an extension of one word, and two bytes of padding
    wild = bytes([0xB0, 0x08, 0, 1]) + bytes(8) + bytes([0xBE, 0xDE, 0, 1]) + bytes(4) + payload + bytes([0, 2])
    assert bytes(one(spark, packets.rtp_parse(F.lit(wild))).payload) == payload
    m = one(spark, packets.parse_message(packets.frame_message(F.lit(6), F.lit(65535), F.lit(b"\1\2\3"))))
    assert (m.codec, m.seq, bytes(m.payload)) == (6, 65535, b"\1\2\3")
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([65534, 65535, 0, 1, 65533, 2])], "stream int, at int, seq long")
    assert [r.long_seq for r in packets.unwrap(rows, "stream", "at").orderBy("at").collect()] == [65534, 65535, 65536, 65537, 65533, 65538]
    s = one(spark, packets.parse_sdp(F.lit("m=audio 0 RTP/AVP 8\r\na=rtpmap:8 PCMA/8000/1")))
    assert (s.name, s.rate, s.channels) == ("PCMA", 8000, 1) and one(spark, packets.parse_sdp(F.lit(""))) is None
    out = packets.split_interleaved(spark.createDataFrame([(1, b"x$\x02\x00\x03abc$\x01\x00\x09z"), (2, None)], "id long, b binary")).collect()
    assert [(r.id, r.channel, bytes(r.payload)) for r in out] == [(1, 2, b"abc")]


def test_headers(spark):
    assert one(spark, F.crc32(F.lit(b"123456789"))) == 0xCBF43926
    h = one(spark, headers.mp3(F.lit(bytes.fromhex("fffb9000"))))
    assert (h.version, h.layer, h.rate, h.frame_size) == (3, 3, 44100, 417)
    assert one(spark, headers.mp3(F.lit(b"none"))) is None
    a = one(spark, headers.adts(F.lit(bytes.fromhex("fff95080201ffc"))))
    assert a.rate == 44100 and a.mpeg == 2 and a.profile == 2
    c = one(spark, headers.audio_config(headers.write_audio_config(F.lit(2), F.lit(11502), F.lit(2))))
    assert (c.object_type, c.rate, c.channels, c.rate_index) == (2, 11502, 2, 15)
    for chip in ("hisilicon", "dahua", "uniview"):
        t = one(spark, headers.chip_trim(headers.chip_add(F.lit(bytes(range(1, 51))), chip)))
        assert t.chip == chip and bytes(t.payload) == bytes(range(1, 51))
    assert one(spark, headers.chip_trim(F.lit(b"abc"))).chip is None
    w = one(spark, headers.wav_info(containers.wav_file(F.lit(bytes(100)), 16000)))
    assert (w.format, w.channels, w.rate, w.bits, w.data_size) == (1, 1, 16000, 16, 100) and one(spark, headers.wav_info(F.lit(bytes(44)))) is None
    assert one(spark, bits.le(F.lit(b"\1\2\3"), 0, 3)) == 0x030201 and one(spark, bits.wrap16(F.lit(40000))) == -25536


@pytest.mark.parametrize("size", [0, 1, 254, 255, 510, 65025, 70000])
def test_ogg_sizes(spark, size):
    rows = spark.createDataFrame([(1, 1, bytes(size)), (1, 2, b"tail")], "stream long, seq long, b binary")
    pages = containers.ogg_pages(rows).select(F.col("stream").alias("id"), F.col("number").alias("k"), F.col("page").alias("payload"))
    out = sorted((r.k, r.good, bytes(r.payload)) for r in containers.ogg_packets(containers.join_chunks(pages)).collect())
    assert out == [(0, True, bytes(size)), (1, True, b"tail")]


def test_files_in_and_out(spark, tmp_path):
    rows = spark.createDataFrame([("a.wav", b"RIFF1234WAVE"), ("b.bin", b"fLaC"), ("c", b"x")], "name string, b binary")
    assert write_files(rows, f"file://{tmp_path}/out") == 3
    got = {r.name.rsplit("/", 1)[1]: (r.kind, bytes(r.b)) for r in read_files(spark, f"file://{tmp_path}/out").collect()}
    assert got == {"a.wav": ("wav", b"RIFF1234WAVE"), "b.bin": ("flac", b"fLaC"), "c": ("pcm", b"x")}


def test_registry_mix_and_speech(spark):
    registry = default_registry()
    assert registry.supported(6) and not registry.supported(98) and registry.ids() == [2, 6, 7, 8, 26]
    with pytest.raises(ValueError):
        CodecRegistry().register(1, None, None)
    assert codec_table(spark).count() == 33
    half = spark.createDataFrame([(i, n, 0.5, 0) for i in (1, 2) for n in range(4 - i)], "id long, n int, x double, g int")
    assert [r.y for r in mixing.mix([(half, 1.0)], "g").orderBy("n").collect()] == [0.5, 0.5, 0.25]
    frames = spark.createDataFrame([(1, f, [0.0] * 6 if f > 2 else [500.0] * 6) for f in range(30)], "stream int, frame long, energies array<double>")
    said = speech.speech_decision(speech.speech_probability(frames)).orderBy("frame").collect()
    assert [r.speech for r in said] == [True] * 18 + [False] * 12 and all(0 <= r.probability <= 1 for r in said)
    rng = [((i * 7919) % 1000) / 1000 - 0.5 for i in range(2000)]
    far = spark.createDataFrame([(1, i, x) for i, x in enumerate(rng)], "stream long, n long, x double")
    left = speech.cancel_echo(far.select("stream", "n", (F.col("x") * 0.6).alias("x")), far, 16).where("n > 1500").agg(F.max(F.abs("y"))).first()[0]
    assert left < 0.02
