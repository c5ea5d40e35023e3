"""Functions for SQL text: table functions over containers and packets, for LATERAL, and codecs over columns.

``register(spark)`` gives them their names for the session.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fluxtone.functions.vorbis import SETUP, setup_rows
from fluxtone.operators.containers import FLAC_BLOCKS, MP4_BOXES, flac_block_rows, mp4_box_rows
from fluxtone.operators.packet_codecs import _G726, _Ima
from fluxtone.sources.ogg import HEAD, page_size, pieces


class FlacBlocks:
    """Metadata blocks of a FLAC file's bytes."""

    def eval(self, b: bytes) -> Iterator[tuple]:
        yield from flac_block_rows(b)


class Mp4Boxes:
    """Leaf boxes of an MP4 file's bytes."""

    def eval(self, b: bytes) -> Iterator[tuple]:
        yield from mp4_box_rows(b)


class OggParts:
    """Parts of packets of an Ogg file's bytes, page by page; what is no page with a right checksum is passed over."""

    def eval(self, b: bytes) -> Iterator[tuple]:
        at = 0
        while b is not None and 0 <= (at := b.find(b"OggS", at)) <= len(b) - HEAD:
            size = page_size(b, at)
            if size:
                page = bytes(b[at : at + size])
                for i, (begins, ends, payload) in enumerate(pieces(page)):
                    yield int.from_bytes(page[14:18], "little"), int.from_bytes(page[18:22], "little"), i, begins, ends, payload
            at += size or 1


#: Bytes of the longest setup header whose parts a worker keeps.
KEPT = 1 << 14
PARTS = pa.list_(pa.struct([("part", pa.string()), ("k", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("size", pa.int32()), ("total", pa.int64())]))


@lru_cache(maxsize=256)
def _kept(b: bytes, channels: int) -> tuple[tuple, ...]:
    return tuple(setup_rows(b, channels))


def setup_parts(b: pa.Array, channels: pa.Array) -> pa.Array:
    """Parts of third Vorbis headers, a list for each; an encoder writes streams alike the same header, so what is alike is read once."""
    places: dict[tuple, int] = {}
    at = [places.setdefault(header, len(places)) for header in zip(b.to_pylist(), channels.to_pylist(), strict=True)]
    found = [[*(_kept if b is not None and len(b) <= KEPT else setup_rows)(b, channels)] for b, channels in places]
    return pa.array(found, PARTS).take(pa.array(at, pa.int32()))


#: Name, class and columns of each table function in Python.
TABLES = (
    ("flac_blocks", FlacBlocks, FLAC_BLOCKS),
    ("mp4_boxes", Mp4Boxes, MP4_BOXES),
    ("ogg_parts", OggParts, "stream long, number long, piece int, begins boolean, ends boolean, payload binary"),
)


def register(spark: SparkSession) -> None:
    """Table functions flac_blocks, mp4_boxes and ogg_parts of a file's bytes, vorbis_setup of a header's, and vorbis_parts(b, channels), the same as an array; ima_samples(b) and g726_samples(b, bits) of a packet's."""
    for name, of, columns in TABLES:
        spark.udtf.register(name, F.udtf(of, returnType=columns))

    @F.pandas_udf("array<int>")
    def ima_samples(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else _Ima(4).feed(x)[0])

    @F.pandas_udf("array<int>")
    def g726_samples(b: pd.Series, bits: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _G726(int(n)).feed(x)[0] for x, n in zip(b, bits, strict=True)])

    @F.arrow_udf(f"array<struct<{SETUP.replace(' ', ':').replace(',:', ', ')}>>")
    def vorbis_parts(b: pa.Array, channels: pa.Array) -> pa.Array:
        return setup_parts(b, channels)

    # a table function in SQL over an array of a batch's headers: one in Python takes and gives rows one by one
    spark.udf.register("vorbis_parts", vorbis_parts)
    spark.sql(f"create or replace temporary function vorbis_setup(b binary, channels long) returns table ({SETUP}) return select p.* from (select explode(vorbis_parts(b, channels)) as p)")
    spark.udf.register("ima_samples", ima_samples)
    spark.udf.register("g726_samples", g726_samples)
