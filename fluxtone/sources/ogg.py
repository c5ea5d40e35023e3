"""Ogg files as a data source that reads large files in splits, and packets put together from what the splits give.

A page belongs to the split that its first byte lies in. A reader that begins within a file looks for the next mark whose
page's checksum holds, so no task walks a file from its start, and a file gives the same rows at any split size. (A
page whose body holds a whole page with a right checksum is the one thing that could be read in two ways.) Damaged pages
are passed over; the packets that they had parts of aren't whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SPLIT = 64 << 20
MARK, HEAD = b"OggS", 27
#: A page is no larger; bytes read at a time.
LARGEST, CHUNK = HEAD + 255 + 255 * 255, 1 << 20
PIECES = "file string, split long, at long, stream long, number long, granule long, piece int, begins boolean, ends boolean, payload binary"
ROWS = 500


def page_size(b: bytes, at: int) -> int:
    """Size of the page that begins there with a right checksum, or 0."""
    if b[at : at + 4] != MARK or at + HEAD > len(b):
        return 0
    sizes = b[at + HEAD : at + HEAD + b[at + 26]]
    stop = at + HEAD + len(sizes) + sum(sizes)
    if len(sizes) < b[at + 26] or stop > len(b):
        return 0
    good = zlib.crc32(b[at : at + 22] + bytes(4) + b[at + 26 : stop]) == int.from_bytes(b[at + 22 : at + 26], "little")
    return stop - at if good else 0


def pages(file, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of the pages that begin from ``start`` to before ``stop``."""
    at, held, first = start, b"", start  # held are the bytes from first on
    while at < stop:
        if first + len(held) - at < LARGEST:
            file.seek(at)
            held, first = file.read(LARGEST + CHUNK), at
        found = held.find(MARK, at - first)
        if found < 0:
            # the last three bytes may begin a mark
            nearer = first + len(held) - 3
            if nearer <= at:
                return
            at = nearer
            continue
        at = first + found
        if at >= stop:
            return
        if first + len(held) - at < LARGEST and first < at:
            continue  # a page may go on beyond what is held
        size = page_size(held, at - first)
        if size:
            yield at, held[at - first : at - first + size]
        at += size or 1


def pieces(page: bytes) -> Iterator[tuple[bool, bool, bytes]]:
    """Of each packet that a page has a part of: whether it begins and ends there, and the part."""
    sizes, at = page[HEAD : HEAD + page[26]], HEAD + page[26]
    begins, start = not page[5] & 1, at
    for i, size in enumerate(sizes):
        at += size
        if size < 255 or i + 1 == len(sizes):
            yield begins, size < 255, page[start:at]
            begins, start = True, at


@dataclass
class Split(InputPartition):
    path: str
    start: int
    stop: int
    number: int


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Split]:
        store, base = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(base)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
        return [Split(x.path, at, min(at + self.split, x.size), at // self.split) for x in found if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")) for at in range(0, x.size, self.split)]

    def read(self, partition: Split | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        schema = pa.schema([("file", pa.string()), ("split", pa.int64()), ("at", pa.int64()), ("stream", pa.int64()), ("number", pa.int64()), ("granule", pa.int64()), ("piece", pa.int32()), ("begins", pa.bool_()), ("ends", pa.bool_()), ("payload", pa.binary())])
        rows = []
        with store.open_input_file(partition.path) as file:
            for at, page in pages(file, partition.start, partition.stop):
                number = lambda a, n, signed=False: int.from_bytes(page[a : a + n], "little", signed=signed)  # noqa: B023, E731
                rows += [(partition.path, partition.number, at, number(14, 4), number(18, 4), number(6, 8, True), i, *piece) for i, piece in enumerate(pieces(page))]
                if len(rows) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class OggSource(DataSource):
    """Option ``split_bytes``: the most that a task reads of a file, but for the end of its last page."""

    @classmethod
    def name(cls) -> str:
        return "ogg"

    def schema(self) -> str:
        return PIECES

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], int(self.options.get("split_bytes", SPLIT)))


def read_pieces(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """A row for each packet's part in a page, of a file or of all files of a folder."""
    spark.dataSource.register(OggSource)
    return spark.read.format("ogg").option("split_bytes", split_bytes).load(path)


def packets(parts: DataFrame) -> DataFrame:
    """file, stream, k, granule, whole, payload of ``read_pieces``: a stream's packets, numbered from 0.

    Packets are counted by split first and then within a split, so no task has all parts of a stream. A packet is whole
    where it begins and ends, on pages of consecutive numbers. Parts before a file's first beginning have number -1.
    """
    key = ["file", "stream"]
    begun = parts.groupBy(*key, "split").agg(F.sum(F.col("begins").cast("long")).alias("begun"))
    ahead = Window.partitionBy(*key).orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    begun = begun.select(*key, "split", F.coalesce(F.sum("begun").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy(*key, "split").orderBy("at", "piece").rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.withColumn("own", F.sum(F.col("begins").cast("long")).over(within)).join(begun, [*key, "split"]).withColumn("k", F.col("ahead") + F.col("own") - 1)
    found = rows.groupBy(*key, "k").agg(F.array_sort(F.collect_list(F.struct("at", "number", "begins", "ends", "granule", "payload"))).alias("l"))
    first, last = F.get("l", F.lit(0)), F.element_at("l", -1)
    whole = first["begins"] & last["ends"] & (last["number"] - first["number"] + 1 == F.size("l"))
    payload = F.unhex(F.array_join(F.transform("l", lambda p: F.hex(p["payload"])), ""))
    return found.select(*key, "k", last["granule"].alias("granule"), whole.alias("whole"), payload.alias("payload"))
