"""WARC archives of pages, and the histories of their captures by an external merge of sorted runs.

Writing: a page is a record, its payload the html in UTF-8 (null: empty). Of pages with equal payloads of
``LEAST`` bytes or more that with the smallest page_id is a ``response`` with the payload, and the others are
``revisit`` records without it, which refer to it; payloads that are shorter are always stored. The data source
``warc`` writes records to ``.warc.gz`` archives, one gzip member each, and starts another archive when one is
full; archives get their names when Spark commits the job, so tasks that are run again leave nothing behind.

Reading: each archive is read member by member, so a task holds one record at a time.

Index: the captures of an archive, no more than fit in one archive, are sorted in memory by (URL key, time,
page_id, place), and form a *run*, which is written in short blocks; the first keys of the blocks are the external
index of the run. Cut points drawn from those first keys deal out the whole order into ranges. Every block is cut
at them and sent to its ranges. In a range pieces come in order of their first keys (Spark's external sort); what
lies below the first key of the next piece is merged by a loser tree over the open pieces. So a task holds about
``WAVE`` captures and at most the open piece of each run. Ranges are in order of key too, and with the counts of
the ranges before it each capture gets its place in the order of all.

Defined cases: a row without page_id counts as larger than all others; rows that repeat a page's id and payload
are responses alike; null URLs count as ''; times come from ``when``, or else are page_id seconds from 1970; an
empty table gives no archive and no row. Only page_id, url and html are read, other columns may have any name.
"""

from __future__ import annotations

import atexit
import gzip
import hashlib
import re
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from fluxtone.llm.common import remove_at_exit, shared_folder, small_batches, stored

LEAST = 100
ARCHIVE_BYTES = 64 << 20
#: Captures of a block of a run; captures of a range, about; ranges at most; captures merged at a time, about.
BLOCK, RANGE, MOST_RANGES, WAVE = 32, 4096, 8192, 16384
SALTS = 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "page_id long, url string, stamp long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


HEAD = b"WARC/1."
#: Bytes read at a time, and rows and payload bytes of a batch that a reader hands on.
CHUNK, ROWS, HANDED = 1 << 20, 500, 4 << 20


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id} {digest}'.encode()).hexdigest())}>"


def date_of(stamp: int) -> str:
    return f"{np.datetime64(stamp, 's')}Z"


def stamp_of(date: str) -> int:
    return int(np.datetime64(date.rstrip("Z"), "s").astype(np.int64))


def url_key(url: str) -> str:
    """Host labels from the last to the first, then path and query: ``http://www.b.com/x?y#z`` is ``com,b)/x?y``."""
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)", url)
    if not m:
        return url.partition("#")[0]
    host = re.sub(r"^www[0-9]*\.", "", re.sub(r":(80|443)$", "", m[1].rpartition("@")[2].lower()))
    return ",".join(reversed(host.split("."))) + ")" + (m[2] if m[2].startswith("/") else "/" + m[2])


def plain(url: str) -> str:
    """Blanks and control characters as percent signs and digits: a header is one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str, stamp: int, payload: bytes, digest: str, refers_to: int | None, response: bool) -> bytes:
    """A whole WARC record; a revisit has the HTTP header of its page without the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (payload if response else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date_of(stamp)}", f"WARC-Target-URI: {plain(url)}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if not response:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", *([] if refers_to is None else [f"Refers-To-Page-ID: {refers_to}"])]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def capture(data: bytes) -> dict | None:
    """What the index has of a record, and its payload; None for other kinds of records."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(HEAD):
        raise ValueError("no WARC record")
    names = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    kind = names.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    block = rest[: int(names["content-length"])]
    if len(block) < int(names["content-length"]):
        raise ValueError("a WARC record is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = names.get("warc-payload-digest", "").removeprefix("sha256:")
    size = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]+)", http)
    if kind == "response":
        found = hashlib.sha256(payload).hexdigest()
        if digest and found != digest:
            raise ValueError("a WARC record's payload has another digest than its header says")
        digest = found
    number = lambda name: int(names[name]) if name in names else None
    return {
        "page_id": number("page-id"), "url": names.get("warc-target-uri", ""), "stamp": stamp_of(names["warc-date"]), "payload_bytes": len(payload) if kind == "response" or not size else int(size[1]), "payload_digest": digest,
        "record_type": kind, "refers_to": number("refers-to-page-id"), "payload": payload if kind == "response" else None,
    }


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member of a stream."""
    inflate, out, offset, length, left = zlib.decompressobj(31), [], 0, 0, b""
    while chunk := left or stream.read(CHUNK):
        out.append(inflate.decompress(chunk))
        left = inflate.unused_data
        length += len(chunk) - len(left)
        if inflate.eof:
            yield offset, length, b"".join(out)
            inflate, out, offset, length = zlib.decompressobj(31), [], offset + length, 0
    if length:
        raise ValueError("an archive is cut off")


@dataclass
class Written(WriterCommitMessage):
    #: (draft, name) of each archive
    files: list[tuple[str, str]]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, most: int):
        self.path, self.most, self.job = path, most, uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = fs.FileSystem.from_uri(self.path)
        part, files, out, size = TaskContext.get().partitionId(), [], None, 0
        try:
            for batch in iterator:
                for r in batch.to_pylist():
                    if out is None:
                        name = f"{part:06d}-{len(files):04d}-{self.job}.warc.gz"
                        files.append((f"{base}/.drafts-{self.job}/{uuid.uuid4().hex}", f"{base}/{name}"))
                        store.create_dir(f"{base}/.drafts-{self.job}", recursive=True)
                        out, size = store.open_output_stream(files[-1][0], compression=None), 0
                    member = gzip.compress(record(r["page_id"], r["url"], r["stamp"], r["payload"], r["digest"], r["refers_to"], r["response"]), 6, mtime=0)
                    out.write(member)
                    size += len(member)
                    if size >= self.most:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.path)
        store.create_dir(base, recursive=True)
        for message in messages:
            for draft, name in message.files if message else ():
                store.move(draft, name)
        self._clear(store, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*fs.FileSystem.from_uri(self.path))

    def _clear(self, store: fs.FileSystem, base: str) -> None:
        drafts = f"{base}/.drafts-{self.job}"
        if store.get_file_info(drafts).type == fs.FileType.Directory:
            store.delete_dir(drafts)


@dataclass
class Archive(InputPartition):
    path: str


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path, schema.names
        self.schema = pa.schema([(f.name, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString().replace("bigint", "long")]) for f in schema])

    def partitions(self) -> list[Archive]:
        store, base = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return [Archive(x.path) for x in found if x.path.endswith(".warc.gz")]

    def read(self, partition: Archive | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archives
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        rows, size, name = [], 0, partition.path.rpartition("/")[2]
        with store.open_input_stream(partition.path, compression=None) as stream:
            for offset, length, data in members(stream):
                if found := capture(data):
                    rows.append(found | {"archive": name, "offset": offset, "length": length})
                    size += len(found["payload"] or b"") if "payload" in self.names else 0
                if len(rows) >= ROWS or size >= HANDED:
                    yield pa.RecordBatch.from_pylist(rows, self.schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, self.schema)


class WarcSource(DataSource):
    """Option ``payload``: false leaves the payloads out. Option ``archive_bytes``: size at which an archive is full."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return CAPTURES if self.options.get("payload", "true") == "false" else CAPTURES + ", payload binary"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options.get("archive_bytes", ARCHIVE_BYTES)))

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema)


def write_warc(pages: DataFrame, folder: str, when: Column | None = None, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes archives of (page_id, url, html) to a folder that all executors share."""
    spark = pages.sparkSession
    small_batches(spark)
    spark.dataSource.register(WarcSource)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    stamp = F.coalesce(F.col("page_id").cast("long") if when is None else F.unix_seconds(when.cast("timestamp")), F.lit(0).cast("long"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), stamp.alias("stamp"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    ids = F.struct(F.col("page_id").isNull().alias("none"), "page_id")
    first = rows.where(F.col("payload_bytes") >= LEAST).groupBy("digest").agg(F.count("*").alias("n"), F.min(ids).alias("first")).where("n > 1")
    # a group of any size is dealt to SALTS tasks
    first = stored(first.select("digest", F.col("first.page_id").alias("first"), F.lit(True).alias("met")), "first").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(first, ["digest", "salt"], "left")
    response = F.col("met").isNull() | F.col("first").eqNullSafe(F.col("page_id"))
    columns = ["page_id", "url", "stamp", "payload", "payload_bytes", "digest", F.when(~response, F.col("first")).alias("refers_to"), response.alias("response")]
    met.select(columns).write.format("warc").mode("append").option("archive_bytes", archive_bytes).save(folder)


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The records of all archives of a folder, with their payloads (null for revisits)."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


class LoserTree:
    """Merges sorted lists of keys: each inner node holds the loser of the match below it, so a step replays one path."""

    def __init__(self, keys: list[list[bytes]]):
        self.keys, self.at, k = keys, [0] * len(keys), len(keys)
        self.now = [x[0] if x else None for x in keys]
        self.losers, won = [0] * k, [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = won[2 * node], won[2 * node + 1]
            won[node], self.losers[node] = (b, a) if self._less(b, a) else (a, b)
        self.winner = won[1] if k > 1 else 0

    def _less(self, a: int, b: int) -> bool:
        return self.now[a] is not None and (self.now[b] is None or self.now[a] < self.now[b])

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(list, place in it) of each key, the least first."""
        while self.keys and self.now[self.winner] is not None:
            w = self.winner
            yield w, self.at[w]
            self.at[w] += 1
            self.now[w] = self.keys[w][self.at[w]] if self.at[w] < len(self.keys[w]) else None
            node = (len(self.keys) + w) // 2
            while node:
                if self._less(self.losers[node], w):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


_BIAS = 1 << 63


def sort_key(row: dict) -> bytes:
    """Bytes in order of URL key, time, page_id (none last) and place in the archives."""
    page = b"\x01" if row["page_id"] is None else b"\x00" + struct.pack(">Q", row["page_id"] + _BIAS)
    return row["url_key"].encode() + b"\x00" + struct.pack(">Q", row["stamp"] + _BIAS) + page + row["archive"].encode() + b"\x00" + struct.pack(">Q", row["offset"])


_KEYED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("stamp", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url_key", pa.string()), ("key", pa.binary())])


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def runs(captures: DataFrame) -> DataFrame:
    """The sorted run of each archive in blocks: first, last, n, body. A task of ``captures`` has whole archives."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            for r in rows:
                r["url_key"] = url_key(r["url"])
                r["key"] = sort_key(r)
            rows.sort(key=lambda r: r["key"])
            cut = [rows[i : i + BLOCK] for i in range(0, len(rows), BLOCK)]
            for i in range(0, len(cut), ROWS):
                some = cut[i : i + ROWS]
                yield pa.RecordBatch.from_pydict({"first": [x[0]["key"] for x in some], "last": [x[-1]["key"] for x in some], "n": [len(x) for x in some], "body": [_packed(pa.Table.from_pylist(x, _KEYED)) for x in some]})

        rows: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if rows and rows[-1]["archive"] != r["archive"]:
                    yield from run(rows)
                    rows = []
                rows.append(r)
        yield from run(rows)

    return captures.mapInArrow(each, "first binary, last binary, n long, body binary")


def cut_points(blocks: DataFrame, ranges: int) -> list[bytes]:
    """About ``ranges`` - 1 keys that deal out the order evenly, from a sample of the index of some 20 keys a range.

    Whatever the sample, all captures are merged; it only decides how even the ranges are.
    """
    total = blocks.count()
    if ranges < 2 or not total:
        return []
    want = 20 * ranges
    some = blocks.select("first") if total <= want else blocks.select("first").where(F.pmod(F.xxhash64("first"), F.lit(total)) < want)
    keys = sorted(bytes(r.first) for r in some.toLocalIterator())
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def pieces(blocks: DataFrame, cuts: list[bytes]) -> DataFrame:
    """Blocks cut where ranges meet: range, first, n, body."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"range": [], "first": [], "n": [], "body": []}
            for r in batch.to_pylist():
                lo, hi = bisect_right(cuts, r["first"]), bisect_right(cuts, r["last"])
                if lo == hi:
                    found = [(lo, r["first"], r["n"], r["body"])]
                else:
                    rows = _unpacked(r["body"])
                    keys = rows.column("key").to_pylist()
                    edges = [0, *[bisect_left(keys, c) for c in cuts[lo:hi]], len(keys)]
                    found = [(lo + i, keys[a], b - a, _packed(rows.slice(a, b - a))) for i, (a, b) in enumerate(pairwise(edges)) if b > a]
                for name, column in zip(out, zip(*found, strict=True), strict=True):
                    out[name] += column
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("range", pa.int32()), ("first", pa.binary()), ("n", pa.int64()), ("body", pa.binary())]))

    return blocks.mapInArrow(each, "range int, first binary, n long, body binary")


def merge(batches: Iterator[pa.RecordBatch], before: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Captures in order, with their place, from pieces in order of (range, first)."""
    held: list[tuple[list[bytes], pa.Table]] = []
    now, place, size = None, 0, 0

    def below(bound: bytes | None) -> Iterator[pa.RecordBatch]:
        nonlocal held, place, size
        ends = [len(keys) if bound is None else bisect_left(keys, bound) for keys, _ in held]
        starts = [0, *accumulate(ends)]
        order = [starts[i] + j for i, j in LoserTree([keys[:e] for (keys, _), e in zip(held, ends, strict=True)])]
        if order:
            rows = pa.concat_tables([t.slice(0, e) for (_, t), e in zip(held, ends, strict=True)]).take(pa.array(order)).drop_columns(["key"])
            rows = rows.append_column("place", pa.array(range(place, place + len(order)), pa.int64()))
            yield from rows.combine_chunks().to_batches(max_chunksize=ROWS)
        place, size = place + len(order), size - len(order)
        held = [(keys[e:], t.slice(e)) for (keys, t), e in zip(held, ends, strict=True) if e < len(keys)]

    for batch in batches:
        for r in batch.to_pylist():
            if r["range"] != now:
                yield from below(None)
                now, place = r["range"], before[r["range"]]
            elif size >= WAVE:
                yield from below(r["first"])
            rows = _unpacked(r["body"])
            held.append((rows.column("key").to_pylist(), rows))
            size += rows.num_rows
    yield from below(None)


def histories(captures: DataFrame, per_range: int = RANGE) -> DataFrame:
    """``captures`` (as ``read_warc`` gives them, without payloads) with url_key and their place, from 0, in order of URL key, time, page_id and place in the archives.

    Rows come out in this order within a partition, and every range of the order is within one.
    """
    spark = captures.sparkSession
    blocks = stored(runs(captures), "runs")
    total = blocks.agg(F.sum("n")).first()[0] or 0
    ranges = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // per_range)))
    cuts = cut_points(blocks, ranges)
    sizes = {r.range: r.n for r in pieces(blocks, cuts).groupBy("range").agg(F.sum("n").alias("n")).toLocalIterator()}  # a row a range
    before, so_far = {}, 0
    for number in sorted(sizes):
        before[number], so_far = so_far, so_far + sizes[number]
    dealt = pieces(blocks, cuts).repartition("range").sortWithinPartitions("range", "first")
    return dealt.mapInArrow(lambda batches: merge(batches, before), CAPTURES + ", url_key string, place long")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the archives of ``pages``, reads them back and returns the histories; without ``folder`` in the shared one."""
    spark = pages.sparkSession
    if folder is None:
        folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
        atexit.register(remove_at_exit, spark, folder)
    write_warc(pages, folder)
    return histories(read_warc(spark, folder, payload=False))


ORACLE = """
with p as (
  select page_id, coalesce(url, '') as url, sha256(coalesce(html, '')) as payload_digest, strlen(coalesce(html, ''))::bigint as payload_bytes from pages),
k as (
  select *, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) as host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) as rest,
         case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end as first from p),
h as (
  select *, regexp_replace(regexp_replace(regexp_replace(lower(host), '^.*@', ''), ':(80|443)$', ''), '^www[0-9]*\\.', '') as bare from k),
u as (
  select *, case when host = '' then regexp_replace(url, '#.*$', '')
                 else array_to_string(list_reverse(string_split(bare, '.')), ',') || ')' || case when rest like '/%' then '' else '/' end || rest end as url_key from h)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to, url_key,
       row_number() over (order by url_key, page_id) - 1 as place
from u
"""
