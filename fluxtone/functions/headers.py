"""Header fields of codecs and containers, as expressions over binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxtone.functions.bits import be, bits_at, bits_of, field, from_bits, le, let, to_be, to_bits, to_le, u8

# Sampling rates by index, and rates in thousands of bits a second by index.
AAC_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
MP3_BITRATES = {
    1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
MP3_RATES = {"3": (44100, 48000, 32000), "2": (22050, 24000, 16000), "0": (11025, 12000, 8000)}


def _pick(values, at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def adts(b: Column) -> Column:
    """struct of an ADTS header, or null without its sync word; profile counts from 1 as object types do."""
    h = be(b, 0, 7)
    index = field(h, 34, 4)
    found = F.struct(
        F.when(field(h, 43, 1) == 0, 4).otherwise(2).alias("mpeg"),
        (field(h, 40, 1) == 1).alias("no_crc"),
        (field(h, 38, 2) + 1).alias("profile"),
        index.alias("rate_index"),
        F.coalesce(_pick(AAC_RATES, index), F.lit(44100)).alias("rate"),
        field(h, 30, 3).alias("channels"),
        field(h, 13, 13).alias("frame_length"),
    )
    return F.when((F.octet_length(b) >= 7) & (field(h, 44, 12) == 0xFFF), found)


def adts_header(rate_index: Column, channels: Column, payload_size: Column) -> Column:
    """Seven bytes for a low-complexity frame without a checksum."""
    size = payload_size.cast("long") + 7
    h = F.lit(0xFFF1 << 40) + F.lit(1 << 38) + rate_index.cast("long") * (1 << 34) + channels.cast("long") * (1 << 30) + size * (1 << 13) + F.lit((0x7FF << 2))
    return to_be(h, 7)


def mp3(b: Column) -> Column:
    """struct of an MPEG audio header, or null without its sync word or with a reserved version, rate or bitrate."""
    h = be(b, 0, 4)
    version, layer, rate, bitrate = field(h, 19, 2), 4 - field(h, 17, 2), field(h, 10, 2), field(h, 12, 4)
    speed = F.when(version == 3, _pick(MP3_BITRATES[1], bitrate)).otherwise(_pick(MP3_BITRATES[2], bitrate)) * 1000
    hertz = F.when(version == 3, _pick(MP3_RATES["3"], rate)).when(version == 2, _pick(MP3_RATES["2"], rate)).otherwise(_pick(MP3_RATES["0"], rate))
    samples = F.when(version == 3, 1152).otherwise(576)
    size = F.when(speed > 0, F.floor(F.when(version == 3, 144).otherwise(72) * speed / hertz) + field(h, 9, 1)).otherwise(0)
    found = F.struct(version.alias("version"), layer.alias("layer"), speed.alias("bitrate"), hertz.alias("rate"), field(h, 6, 2).alias("mode"), samples.alias("samples"), size.cast("long").alias("frame_size"))
    return F.when((F.octet_length(b) >= 4) & (field(h, 21, 11) == 0x7FF) & (version != 1) & (rate < 3) & (bitrate < 15), found)


def sync_places(b: Column) -> Column:
    """Places of MPEG sync words (eleven set bits), as an array: what lies between them makes no rows."""
    places = lambda b: F.when(F.octet_length(b) > 1, F.sequence(F.lit(0), F.octet_length(b) - 2)).otherwise(F.array().cast("array<int>"))
    return let(b, lambda b: F.filter(places(b), lambda at: F.substring(F.hex(F.substring(b, at + 1, F.lit(2))), 1, 3).isin("FFE", "FFF")))


def audio_config(b: Column) -> Column:
    """struct of an AAC configuration: object type, rate (24 bits of its own where the index is 15), channels."""
    wide = F.rpad(F.hex(b), 14, "0")
    bits = F.conv(F.substring(wide, F.lit(1), F.lit(14)), 16, 10).cast("long")  # 56 bits
    index = field(bits, 47, 4)
    own = index == 15
    rate = F.when(own, field(bits, 23, 24)).otherwise(F.coalesce(_pick(AAC_RATES, index), F.lit(0)).cast("long"))
    tail = F.when(own, field(bits, 16, 7)).otherwise(field(bits, 40, 7))
    found = F.struct(field(bits, 51, 5).alias("object_type"), index.alias("rate_index"), rate.alias("rate"), field(tail, 3, 4).alias("channels"), (field(tail, 2, 1) == 1).alias("short_frames"), (field(tail, 1, 1) == 1).alias("core_coder"), (field(tail, 0, 1) == 1).alias("extension"))
    return F.when(F.octet_length(b) >= F.when(own, 5).otherwise(2), found)


def write_audio_config(object_type: Column, rate: Column, channels: Column) -> Column:
    index = rate_index(rate)
    head = object_type.cast("long") * 16 + index
    short = to_be((head * 16 + channels.cast("long")) * 8, 2)
    return F.when(index < 15, short).otherwise(to_be(((head * (1 << 24) + rate.cast("long")) * 16 + channels.cast("long")) * 8, 5))


def rate_index(rate: Column) -> Column:
    """Index of a sampling rate; 15 for one that has none."""
    return F.coalesce(*[F.when(rate == r, i) for i, r in enumerate(AAC_RATES)], F.lit(15)).cast("long")


def write_extended_config(object_type: Column, rate: Column, channels: Column, extension: Column, extension_rate: Column, ps: Column) -> Column:
    """A configuration with an extension: 5 for a band replication at ``extension_rate`` and its parametric stereo, 29 for that alone, 0 for none."""
    number = lambda r: F.concat(to_bits(rate_index(r), 4), F.when(rate_index(r) == 15, to_bits(r, 24)).otherwise(""))
    more = F.when(extension == 5, F.concat(F.lit("001011"), number(extension_rate), ps.cast("int").cast("string"))).when(extension == 29, F.concat(F.lit("11101"), ps.cast("int").cast("string"))).otherwise("")
    return from_bits(F.concat(to_bits(object_type, 5), number(rate), to_bits(channels, 4), F.lit("00"), (extension > 0).cast("int").cast("string"), more))


def config_extension(b: Column) -> Column:
    """struct<extension, sbr, rate, ps> after a configuration's 16 bits, 24 of an own rate, and 14 of a core coder's delay; null without one."""
    digits = bits_of(b)
    base = F.when(bits_at(digits, 5, 4) == 15, 24).otherwise(0)
    at = base + 16 + F.when(bits_at(digits, base + 14, 1) == 1, 14).otherwise(0)
    kind, sbr = bits_at(digits, at, 5), bits_at(digits, at + 5, 1) == 1
    index = bits_at(digits, at + 6, 4)
    own = index == 15
    rate = F.when(own, bits_at(digits, at + 10, 24)).otherwise(_pick(AAC_RATES, index).cast("long"))
    ps = F.when(kind == 29, bits_at(digits, at + 5, 1) == 1).when((kind == 5) & sbr, bits_at(digits, at + F.when(own, 34).otherwise(10), 1) == 1)
    found = F.struct(kind.alias("extension"), F.when(kind == 5, sbr).alias("sbr"), F.when((kind == 5) & sbr, rate).alias("rate"), F.coalesce(ps, F.lit(False)).alias("ps"))
    return F.when((bits_at(digits, base + 15, 1) == 1) & kind.isNotNull(), found)


def config_from_adts(b: Column) -> Column:
    """The configuration that an ADTS header stands for; its profile counts from 1 already."""
    h = adts(b)
    return write_audio_config(h["profile"], h["rate"], h["channels"])


def adts_from_config(b: Column, payload_size: Column) -> Column:
    """An ADTS header for a frame of a low-complexity configuration; null for other object types and for rates without an index."""
    c = audio_config(b)
    return F.when((c["object_type"] == 2) & (c["rate_index"] < 15), adts_header(c["rate_index"], c["channels"], payload_size))


def write_vorbis_comments(vendor: Column, comments: Column) -> Column:
    """The second header: vendor, then a list of texts, each after its length."""
    text = lambda s: F.concat(to_le(F.octet_length(s).cast("long"), 4), F.encode(s, "utf-8"))
    listed = F.unhex(F.array_join(F.transform(comments, lambda c: F.hex(text(c))), ""))
    return F.concat(F.lit(b"\x03vorbis"), text(vendor), to_le(F.size(comments).cast("long"), 4), listed, F.lit(b"\x01"))


def vorbis_comments(b: Column) -> Column:
    """struct<vendor, comments, size> of a second header, ``size`` with its last mark; null without its first mark, or where a length is more than there is."""
    length = lambda at: sum((u8(b, at + i) * (1 << (8 * i)) for i in range(4)), F.lit(0).cast("long")).cast("int")
    text = lambda at, size: F.decode(F.substring(b, at + 1, size), "utf-8")
    vendor = length(F.lit(7))
    count = length(vendor + 11)
    start = F.struct((vendor + 15).alias("at"), F.array().cast("array<string>").alias("out"))
    turns = F.when((count > 0) & (count <= F.octet_length(b)), F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    read = F.aggregate(turns, start, lambda s, _: F.struct((s["at"] + 4 + length(s["at"])).alias("at"), F.array_append(s["out"], text(s["at"] + 4, length(s["at"]))).alias("out")))
    found = F.struct(text(F.lit(11), vendor).alias("vendor"), read["out"].alias("comments"), (read["at"] + 1).alias("size"))
    return F.when((F.substring(b, F.lit(1), F.lit(7)) == F.lit(b"\x03vorbis")) & (read["at"] < F.octet_length(b)), found)


def flac_info(b: Column) -> Column:
    """struct of a 34-byte stream information block."""
    raw = be(b, 10, 7)
    return F.struct(be(b, 0, 2).alias("min_block"), be(b, 2, 2).alias("max_block"), be(b, 4, 3).alias("min_frame"), be(b, 7, 3).alias("max_frame"), field(raw, 36, 20).alias("rate"), (field(raw, 33, 3) + 1).alias("channels"), (field(raw, 28, 5) + 1).alias("bits"), (be(b, 14, 4) + field(be(b, 13, 1), 0, 4) * (1 << 32)).alias("samples"), F.lower(F.hex(F.substring(b, F.lit(19), F.lit(16)))).alias("md5"))


def write_flac_info(block: Column, rate: Column, channels: Column, bits: Column, samples: Column, md5: Column) -> Column:
    high = rate.cast("long") * (1 << 12) + (channels.cast("long") - 1) * (1 << 9) + (bits.cast("long") - 1) * 16 + F.shiftright(samples.cast("long"), 32)
    return F.concat(to_be(block.cast("long"), 2), to_be(block.cast("long"), 2), to_be(F.lit(0).cast("long"), 6), to_be(high, 4), to_be(samples.cast("long").bitwiseAND(0xFFFFFFFF), 4), F.unhex(md5))


def vorbis_info(b: Column) -> Column:
    """struct of an identification header, or null without its mark."""
    sizes = u8(b, 28)
    found = F.struct(le(b, 7, 4).alias("version"), u8(b, 11).alias("channels"), le(b, 12, 4).alias("rate"), F.pow(F.lit(2), field(sizes, 0, 4)).cast("long").alias("block_0"), F.pow(F.lit(2), field(sizes, 4, 4)).cast("long").alias("block_1"))
    return F.when(F.substring(b, F.lit(1), F.lit(7)) == F.lit(b"\x01vorbis"), found)


def write_vorbis_info(channels: Column, rate: Column, block_0: int = 8, block_1: int = 11) -> Column:
    zero = F.lit(0).cast("long")
    return F.concat(F.lit(b"\x01vorbis"), to_le(zero, 4), to_be(channels.cast("long"), 1), to_le(rate.cast("long"), 4), to_le(zero, 4), to_le(zero, 4), to_le(zero, 4), F.lit(bytes([block_1 * 16 + block_0, 1])))


def wav_header(data_size: Column, rate: int, channels: int = 1, bits: int = 16) -> Column:
    """44 bytes with patched sizes."""
    each = channels * bits // 8
    number = lambda n, size: to_le(n.cast("long") if isinstance(n, Column) else F.lit(n).cast("long"), size)
    return F.concat(F.lit(b"RIFF"), number(data_size + 36, 4), F.lit(b"WAVEfmt "), number(16, 4), number(1, 2), number(channels, 2), number(rate, 4), number(rate * each, 4), number(each, 2), number(bits, 2), F.lit(b"data"), number(data_size, 4))


def wav_info(b: Column) -> Column:
    """struct of a header whose data chunk comes right after the format, or null without its marks."""
    ok = (F.substring(b, F.lit(1), F.lit(4)) == F.lit(b"RIFF")) & (F.substring(b, F.lit(9), F.lit(4)) == F.lit(b"WAVE"))
    found = F.struct(le(b, 20, 2).alias("format"), le(b, 22, 2).alias("channels"), le(b, 24, 4).alias("rate"), le(b, 34, 2).alias("bits"), F.when(F.substring(b, F.lit(37), F.lit(4)) == F.lit(b"data"), le(b, 40, 4)).alias("data_size"))
    return F.when(ok & (F.octet_length(b) >= 44), found)


def sniff(b: Column, name: Column) -> Column:
    """Container by file name, then by its first bytes; raw samples where neither tells."""
    ending = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    head = F.substring(b, F.lit(1), F.lit(4))
    return (
        F.when(ending == "wav", "wav")
        .when(ending.isin("ogg", "opus"), "ogg")
        .when(ending.isin("mp4", "m4a", "mov"), "mp4")
        .when(head == F.lit(b"RIFF"), "wav")
        .when(head == F.lit(b"OggS"), "ogg")
        .when(head == F.lit(b"fLaC"), "flac")
        .when(F.substring(b, F.lit(5), F.lit(4)) == F.lit(b"ftyp"), "mp4")
        .otherwise("pcm")
    )


def sink_kind(codec: Column) -> Column:
    """Which writer a stream of this name gets."""
    name = F.lower(codec)
    return F.when(name == "opus", "ogg").when(name.isin("wav", "pcm"), "wav").otherwise("mp3")


def opus_frame_size(mode: Column) -> Column:
    return F.when(mode.between(0, 2), 120).when(mode.between(3, 4), 240).when(mode.between(5, 6), 480).otherwise(960)


def chip_add(b: Column, chip: str | Column) -> Column:
    """A vendor's header before the payload; Hisilicon's for any other name and for null."""
    chip = F.lit(chip) if isinstance(chip, str) else chip
    half = F.floor(F.octet_length(b) / 2).cast("long")
    dahua = F.concat(F.lit(b"\x00\x01\x01\x00"), to_le(F.octet_length(b).cast("long") % 65536, 2))
    hisilicon = F.concat(F.lit(b"\x00\x01"), to_be(half % 256, 1), F.lit(b"\x00"))
    return F.concat(F.when(chip == "dahua", dahua).when(chip == "uniview", F.lit(b"\x24\x01\x00\x00")).otherwise(hisilicon), b)


def chip_trim(b: Column) -> Column:
    """struct<chip, payload>: the first vendor whose header fits, in order; chip is null where none does."""
    size = F.octet_length(b)
    hisilicon = (size >= 4) & (be(b, 0, 2) == 1) & (u8(b, 3) == 0) & (u8(b, 2) == F.floor((size - 4) / 2) % 256)
    dahua = (size >= 6) & (be(b, 0, 4) == 0x00010100)
    uniview = (size >= 4) & (be(b, 0, 4) == 0x24010000)
    rest = lambda k: F.substring(b, F.lit(k + 1), size)
    return F.when(hisilicon, F.struct(F.lit("hisilicon").alias("chip"), rest(4).alias("payload"))).when(dahua, F.struct(F.lit("dahua").alias("chip"), rest(6).alias("payload"))).when(uniview, F.struct(F.lit("uniview").alias("chip"), rest(4).alias("payload"))).otherwise(F.struct(F.lit(None).cast("string").alias("chip"), b.alias("payload")))
