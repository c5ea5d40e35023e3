"""Codecs by id: a registry of column builders, and the codec dimension for joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxtone.functions import adaptive, g711, headers
from fluxtone.functions.bits import from_octets, octets

# Codec ids and names.
CODECS = {
    1: "G721", 2: "G722", 3: "G723", 4: "G728", 5: "G729", 6: "G711A", 7: "G711U", 8: "G726", 9: "G729A", 10: "DVI4_3", 11: "DVI4_4",
    12: "DVI4_8K", 13: "DVI4_16K", 14: "LPC", 15: "S16BE_STEREO", 16: "S16BE_MONO", 17: "MPEGAUDIO", 18: "LPCM", 19: "AAC", 20: "WMA9STD",
    21: "HEAAC", 22: "PCM_VOICE", 23: "PCM_AUDIO", 24: "AACLC", 25: "MP3", 26: "ADPCMA", 27: "MP4AUDIO", 28: "AMR", 91: "Transparent",
    98: "H264", 99: "H265", 100: "AVS", 101: "SVAC",
}


class CodecRegistry:
    """Builders of encode and decode columns by codec id: samples (array<int>) to codes (array<int> or bytes) and back."""

    def __init__(self) -> None:
        self._builders: dict[int, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {}

    def register(self, codec_id: int, encode: Callable[[Column], Column], decode: Callable[[Column], Column]) -> None:
        if encode is None or decode is None:
            raise ValueError("a codec needs both directions")
        self._builders[codec_id] = (encode, decode)

    def supported(self, codec_id: int) -> bool:
        return codec_id in self._builders

    def ids(self) -> list[int]:
        return sorted(self._builders)

    def _route(self, codec_id: Column, values: Column, way: int) -> Column:
        """One CASE over the registered ids; null for the others."""
        branches = [(codec_id == i, b[way](values)) for i, b in sorted(self._builders.items())]
        return reduce(lambda case, b: case.when(*b), branches[1:], F.when(*branches[0]))

    def encode(self, codec_id: Column, samples: Column) -> Column:
        return self._route(codec_id, samples, 0)

    def decode(self, codec_id: Column, codes: Column) -> Column:
        return self._route(codec_id, codes, 1)


def default_registry() -> CodecRegistry:
    found = CodecRegistry()
    found.register(6, lambda v: F.transform(v, g711.alaw_encode), lambda c: F.transform(c, g711.alaw_decode))
    found.register(7, lambda v: F.transform(v, g711.ulaw_encode), lambda c: F.transform(c, g711.ulaw_decode))
    found.register(2, adaptive.g722_encode, adaptive.g722_decode)
    found.register(8, adaptive.g726_encode, adaptive.g726_decode)
    found.register(26, adaptive.ima_encode, adaptive.ima_decode)
    return found


def byte_registry() -> CodecRegistry:
    """The same codecs between samples and bytes as they are stored and sent."""
    found, plain = CodecRegistry(), default_registry()
    for i in (2, 6, 7):
        encode, decode = plain._builders[i]
        found.register(i, lambda v, f=encode: from_octets(f(v)), lambda b, f=decode: f(octets(b)))
    found.register(8, adaptive.g726_stream, adaptive.g726_from_stream)
    found.register(26, adaptive.ima_stream, adaptive.ima_from_stream)
    return found


def to_pcm(registry: CodecRegistry, codec_id: Column, data: Column) -> Column:
    """struct<chip, samples> of a device's bytes: the vendor's header comes off, then the codec of the id decodes the rest.

    ``chip`` is null where no vendor's header fits, ``samples`` where the registry hasn't the id.
    """
    trimmed = headers.chip_trim(data)
    return F.struct(trimmed["chip"].alias("chip"), registry.decode(codec_id, trimmed["payload"]).alias("samples"))


def from_pcm(registry: CodecRegistry, codec_id: Column, samples: Column, chip: Column) -> Column:
    """Bytes for a device: encoded by the codec of the id, with the header of vendor ``chip``, or none where that is null."""
    data = registry.encode(codec_id, samples)
    return F.when(chip.isNull(), data).otherwise(headers.chip_add(data, chip))


def codec_table(spark: SparkSession) -> DataFrame:
    """codec_id, name: the dimension, a row for each id."""
    return spark.createDataFrame(sorted(CODECS.items()), "codec_id int, name string")
