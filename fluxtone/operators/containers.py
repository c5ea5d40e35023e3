"""Container files as tables: frames and pages of files, sample tables, and files built from frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from fluxtone.functions.bits import be, joined, to_be, to_le
from fluxtone.functions.headers import wav_header
from fluxtone.functions.vorbis import setup_bytes


def cut_frames(rows: DataFrame, start: Column, size: Column, total: Column) -> DataFrame:
    """id, k, payload: whole frames of ``size`` bytes from byte ``start`` of ``b``, ``total`` bytes in all; a rest is dropped."""
    spans = rows.select("id", "b", start.cast("int").alias("start"), size.cast("int").alias("size"), F.floor(total / size).cast("int").alias("frames")).where("frames > 0")
    # frames are cut before rows multiply, so that no row carries more than its own
    cut = F.transform(F.sequence(F.lit(0), F.col("frames") - 1), lambda k: F.struct(k.alias("k"), F.substring("b", F.col("start") + k * F.col("size") + 1, F.col("size")).alias("payload")))
    return spans.select("id", F.explode(cut).alias("f")).select("id", "f.*")


def wav_layout(b: bytes | None) -> tuple | None:
    """channels, rate, bits, start and size of the samples of a WAV file, whatever chunks stand before them; None without a format or samples."""
    if b is None or len(b) < 12 or bytes(b[:4]) != b"RIFF" or bytes(b[8:12]) != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(b):
        kind, size = bytes(b[at : at + 4]), int.from_bytes(b[at + 4 : at + 8], "little")
        if kind == b"fmt " and size >= 16 and at + 24 <= len(b):
            form = int.from_bytes(b[at + 10 : at + 12], "little"), int.from_bytes(b[at + 12 : at + 16], "little"), int.from_bytes(b[at + 22 : at + 24], "little")
        elif kind == b"data":
            return None if form is None else (*form, at + 8, min(size, len(b) - at - 8))
        at += 8 + size + size % 2  # a chunk of odd size has a byte of 0 after it
    return None


WAV_LAYOUT = "struct<channels:int,rate:int,bits:int,start:long,size:long>"


def wav_frames(files: DataFrame) -> DataFrame:
    """Frames of 20 ms of (id, b) WAV files; files without a format and samples have none."""

    @F.pandas_udf(WAV_LAYOUT)
    def layout(b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([wav_layout(x) or (None,) * 5 for x in b], columns=["channels", "rate", "bits", "start", "size"], dtype="Int64")

    rows = files.withColumn("w", layout("b")).where("w.start is not null")
    size = F.floor(F.col("w.channels") * (F.col("w.bits") / 8)) * F.floor(F.col("w.rate") / 50)
    return cut_frames(rows, F.col("w.start"), F.greatest(size, F.lit(1)), F.col("w.size"))


def pcm_frames(files: DataFrame, rate: int = 8000, milliseconds: int = 20, channels: int = 1, bits: int = 16) -> DataFrame:
    return cut_frames(files, F.lit(0), F.lit(rate * milliseconds // 1000 * channels * bits // 8), F.octet_length("b"))


def wav_file(payload: Column, rate: int, channels: int = 1, bits: int = 16) -> Column:
    return F.concat(wav_header(F.octet_length(payload), rate, channels, bits), payload)


def lacing(size: Column) -> Column:
    """Segment table of a packet: 255 for each full segment, then the rest, which may be 0."""
    return F.concat(F.unhex(F.repeat(F.lit("FF"), F.floor(size / 255).cast("int"))), to_be((size % 255).cast("long"), 1))


def ogg_page(flags: Column, granule: Column, stream: Column, number: Column, table: Column, body: Column) -> Column:
    """A page; its checksum is that of the page with zeros in its place."""
    head = F.concat(F.lit(b"OggS\x00"), to_be(flags.cast("long"), 1), to_le(granule.cast("long"), 8), to_le(stream.cast("long"), 4), to_le(number.cast("long"), 4))
    tail = F.concat(to_be(F.octet_length(table).cast("long"), 1), table, body)
    return F.concat(head, to_le(F.crc32(F.concat(head, F.lit(b"\x00\x00\x00\x00"), tail)), 4), tail)


def ogg_pages(packets: DataFrame, granule_step: int = 960) -> DataFrame:
    """stream, seq, granule, page of (stream, seq, b): a page for each packet of at most 255 segments, larger ones on several.

    The first page of a stream begins it, the last one ends it.
    """
    room = 255 * 255
    parts = F.floor(F.octet_length("b") / room).cast("int")
    bodies = F.transform(F.sequence(F.lit(0), parts), lambda k: F.struct(k.alias("part"), F.substring("b", k * room + 1, F.lit(room)).alias("body"), (k == parts).alias("last")))
    cut = packets.select("stream", "seq", F.explode(bodies).alias("p")).select("stream", "seq", "p.*")
    order, whole = Window.partitionBy("stream").orderBy("seq", "part"), Window.partitionBy("stream")
    cut = cut.withColumn("number", F.row_number().over(order) - 1).withColumn("pages", F.count("*").over(whole)).withColumn("packet", F.dense_rank().over(Window.partitionBy("stream").orderBy("seq")))
    body, last = F.col("body"), F.col("last")
    table = F.when(last, lacing(F.octet_length(body))).otherwise(F.unhex(F.repeat(F.lit("FF"), F.lit(255))))
    flags = (F.col("part") > 0).cast("int") + (F.col("number") == 0).cast("int") * 2 + (F.col("number") == F.col("pages") - 1).cast("int") * 4
    granule = F.col("packet").cast("long") * granule_step
    return cut.select("stream", "seq", F.col("number").cast("long").alias("number"), granule.alias("granule"), ogg_page(flags, granule, F.col("stream"), F.col("number"), table, body).alias("page"))


def ogg_packets(files: DataFrame) -> DataFrame:
    """id, k, granule, good, payload of (id, b): packets put together from segments, over pages too; good: all checksums held."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for pdf in batches:
            out = []
            for i, b in zip(pdf["id"], pdf["b"], strict=True):
                at, k, held, good = 0, 0, b"", True
                while b is not None and at + 27 <= len(b) and b[at : at + 4] == b"OggS":
                    n = b[at + 26]
                    sizes, body = b[at + 27 : at + 27 + n], at + 27 + n
                    stop = body + sum(sizes)
                    good &= zlib.crc32(b[at : at + 22] + b"\0\0\0\0" + b[at + 26 : stop]) == int.from_bytes(b[at + 22 : at + 26], "little")
                    for s in sizes:
                        held += b[body : body + s]
                        body += s
                        if s < 255:
                            out.append((i, k, int.from_bytes(b[at + 6 : at + 14], "little"), good, bytes(held)))
                            k, held, good = k + 1, b"", True
                    at = stop
            yield pd.DataFrame(out, columns=["id", "k", "granule", "good", "payload"])

    return files.select("id", "b").mapInPandas(walk, "id long, k int, granule long, good boolean, payload binary")


def flac_block_rows(b: bytes | None) -> Iterator[tuple]:
    """k, kind, last, start, size of each metadata block of a FLAC file, each after a byte of kind and three of size."""
    at, k, last = 4, 0, b is None or bytes(b[:4]) != b"fLaC"
    while not last and at + 4 <= len(b):
        size, last = int.from_bytes(b[at + 1 : at + 4], "big"), b[at] >= 0x80
        if at + 4 + size > len(b):
            break
        yield k, b[at] & 0x7F, last, at + 4, size
        at, k = at + 4 + size, k + 1


#: Boxes that hold boxes, and those whose bodies are tables of a track's samples.
INNER = frozenset({b"moov", b"trak", b"mdia", b"minf", b"stbl"})
SAMPLE_TABLES = frozenset({b"stsz", b"stsc", b"stco", b"co64"})


def mp4_box_rows(b: bytes | None) -> Iterator[tuple]:
    """path, start, size, body of each leaf box of an MP4 file, by path from the top; bodies of sample tables only."""
    todo = [(0, len(b or b""), "")]
    while todo:
        at, end, path = todo.pop()
        while at + 8 <= end:
            size, kind, head = int.from_bytes(b[at : at + 4], "big"), bytes(b[at + 4 : at + 8]), 8
            if size == 1 and at + 16 <= end:
                size, head = int.from_bytes(b[at + 8 : at + 16], "big"), 16
            size = size or end - at
            if size < head or at + size > end:
                break
            name = f"{path}/{kind.decode('latin1')}"
            if kind in INNER:
                todo.append((at + head, at + size, name))
            else:
                yield name, at + head, size - head, bytes(b[at + head : at + size]) if kind in SAMPLE_TABLES else None
            at += size


def _walked(files: DataFrame, rows_of: Callable[[bytes | None], Iterator[tuple]], columns: str) -> DataFrame:
    """id and ``columns``: what ``rows_of`` gives of each file's bytes."""
    names = ["id", *(c.split()[0] for c in columns.split(", "))]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(i, *row) for i, b in zip(pdf["id"], pdf["b"], strict=True) for row in rows_of(b)], columns=names)

    return files.select("id", "b").mapInPandas(walk, f"id long, {columns}")


FLAC_BLOCKS = "k int, kind int, last boolean, start long, size long"
MP4_BOXES = "path string, start long, size long, body binary"


def flac_blocks(files: DataFrame) -> DataFrame:
    """id, k, kind, last, start, size of (id, b): metadata blocks of a FLAC file."""
    return _walked(files, flac_block_rows, FLAC_BLOCKS)


def mp4_boxes(files: DataFrame) -> DataFrame:
    """id, path, start, size, body of (id, b): leaf boxes of an MP4 file, by path from the top; bodies of sample tables only."""
    return _walked(files, mp4_box_rows, MP4_BOXES)


def _entries(boxes: DataFrame, kind: str, first: int, width: int, fields: list[tuple[str, int, int]]) -> DataFrame:
    """id, k and number fields (name, offset, size) of a table box whose entries of ``width`` bytes begin at ``first``."""
    rows = boxes.where(F.col("path").endswith(f"/{kind}")).select("id", "body", be("body", first - 4, 4).alias("count")).where("count > 0")
    entry = F.transform(F.sequence(F.lit(0), F.col("count").cast("int") - 1), lambda k: F.struct(k.alias("k"), F.substring("body", k * width + first + 1, F.lit(width)).alias("e")))
    return rows.select("id", F.explode(entry).alias("s")).select("id", "s.k", *[be("s.e", at, size).alias(name) for name, at, size in fields])


def sample_offsets(sizes: DataFrame, runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, sample, size, chunk, offset from the three tables of a track.

    sizes (id, sample, size), runs (id, first chunk, per chunk), chunks (id, chunk, offset); chunks count from 1,
    samples from 0. A chunk's run is the last one that begins at it or before; a sample's place in its chunk is
    the running sum of sizes before it.
    """
    order = Window.partitionBy("id").orderBy("chunk")
    known = chunks.join(runs.select("id", F.col("first").alias("chunk"), "per"), ["id", "chunk"], "left")
    known = known.withColumn("per", F.last("per", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    known = known.withColumn("from", F.coalesce(F.sum("per").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    places = known.select("id", "chunk", F.col("offset").alias("base"), F.explode(F.sequence(F.col("from"), F.col("from") + F.col("per") - 1)).alias("sample"))
    within = Window.partitionBy("id", "chunk").orderBy("sample").rowsBetween(Window.unboundedPreceding, -1)
    met = sizes.join(places, ["id", "sample"])
    return met.select("id", "sample", "size", "chunk", (F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))).alias("offset"))


def mp4_samples(files: DataFrame) -> DataFrame:
    """id, sample, size, chunk, offset, payload of (id, b) MP4 files."""
    boxes = mp4_boxes(files)
    sizes = _entries(boxes, "stsz", 12, 4, [("size", 0, 4)]).withColumnRenamed("k", "sample")
    runs = _entries(boxes, "stsc", 8, 12, [("first", 0, 4), ("per", 4, 4)]).drop("k")
    chunks = _entries(boxes, "stco", 8, 4, [("offset", 0, 4)]).unionByName(_entries(boxes, "co64", 8, 8, [("offset", 1, 7)]))
    found = sample_offsets(sizes, runs, chunks.select("id", (F.col("k") + 1).alias("chunk"), "offset"))
    # a file meets the list of its samples once, and they are cut before rows multiply
    lists = found.groupBy("id").agg(F.collect_list(F.struct("sample", "size", "chunk", "offset")).alias("l"))
    cut = F.transform("l", lambda s: F.struct(s["sample"].alias("sample"), s["size"].alias("size"), s["chunk"].alias("chunk"), s["offset"].alias("offset"), F.substring("b", s["offset"].cast("int") + 1, s["size"].cast("int")).alias("payload")))
    return lists.join(files.select("id", "b"), "id").select("id", F.explode(cut).alias("s")).select("id", "s.*")


def mp4_file(samples: Column) -> Column:
    """A file of one track and one chunk from its samples (array<binary>), sizes and offset in closed form."""
    count = F.size(samples).cast("long")
    number = lambda n: to_be(n if isinstance(n, Column) else F.lit(n).cast("long"), 4)

    def box(kind: bytes, *parts: Column) -> Column:
        body = F.concat(*parts)
        return F.concat(number(F.octet_length(body).cast("long") + 8), F.lit(kind), body)

    sizes = F.unhex(F.array_join(F.transform(samples, lambda s: F.lpad(F.hex(F.octet_length(s)), 8, "0")), ""))
    zero = number(0)
    head = box(b"ftyp", F.lit(b"M4A "), zero, F.lit(b"isom"))
    # 8 bytes for each of moov, trak, mdia, minf, stbl, then stsz 20 + 4n, stsc 28, stco 20, and mdat's own 8
    start = 20 + 5 * 8 + 20 + 4 * count + 28 + 20 + 8
    table = box(b"stbl", box(b"stsz", zero, zero, number(count), sizes), box(b"stsc", zero, number(1), number(1), number(count), number(1)), box(b"stco", zero, number(1), number(start)))
    return F.concat(head, box(b"moov", box(b"trak", box(b"mdia", box(b"minf", table)))), box(b"mdat", joined(samples)))


def join_chunks(rows: DataFrame) -> DataFrame:
    """id, b of (id, k, payload): a file's chunks one after another, as they are."""
    lists = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "payload"))).alias("l"))
    return lists.select("id", joined(F.col("l.payload")).alias("b"))


#: Setup headers that are written at once: their bits are bytes of an array.
AT_ONCE = 1000


def setup_headers(rows: DataFrame) -> DataFrame:
    """The rows with ``b``, a Vorbis setup header's bytes, in place of its parts in ``setup``; null where a part or a number of one is."""
    columns = StructType([StructField("b", BinaryType()) if f.name == "setup" else f for f in rows.schema])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot in (batch.slice(i, AT_ONCE) for i in range(0, batch.num_rows, AT_ONCE)):
                yield lot.set_column(lot.schema.get_field_index("setup"), "b", setup_bytes(lot["setup"]))

    return rows.mapInArrow(write, columns)
