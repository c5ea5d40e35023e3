"""Real-time packets: headers, cutting, joining, loss and order. Sequence numbers are columns, never row order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxtone.functions.bits import be, field, joined, let, to_be, u8

HEADER = 12


def rtp_serialize(marker: Column, payload_type: Column, seq: Column, timestamp: Column, ssrc: Column, payload: Column, csrc: Column | None = None) -> Column:
    """Version 2, no padding, no extension; sources in ``csrc`` (array<long>) follow the fixed header."""
    count = F.size(csrc) if csrc is not None else F.lit(0)
    fixed = F.concat(to_be((count + 128).cast("long"), 1), to_be((marker.cast("int") * 128 + payload_type).cast("long"), 1), to_be(seq.cast("long"), 2), to_be(timestamp.cast("long"), 4), to_be(ssrc.cast("long"), 4))
    if csrc is None:
        return F.concat(fixed, payload)
    more = F.unhex(F.array_join(F.transform(csrc, lambda s: F.lpad(F.hex(s), 8, "0")), ""))
    return F.concat(fixed, more, payload)


def rtp_parse(b: Column) -> Column:
    """struct of the header's fields and the payload; null where there are fewer than 12 bytes.

    Words of a header extension are skipped, and padding (its size in the last byte) is cut off.
    """
    first, second = u8(b, 0), u8(b, 1)
    sources = field(first, 0, 4)
    start = HEADER + 4 * sources
    extended = field(first, 4, 1) == 1
    words = F.conv(F.hex(F.substring(b, start.cast("int") + 3, F.lit(2))), 16, 10).cast("long")
    start = (start + F.when(extended, 4 + 4 * F.coalesce(words, F.lit(0))).otherwise(0)).cast("int")
    padding = F.when(field(first, 5, 1) == 1, u8(b, F.octet_length(b) - 1)).otherwise(0)
    size = F.greatest(F.octet_length(b) - start - padding.cast("int"), F.lit(0))
    csrc = F.when(sources > 0, F.transform(F.sequence(F.lit(0), sources.cast("int") - 1), lambda i: F.conv(F.hex(F.substring(b, i * 4 + HEADER + 1, F.lit(4))), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    found = F.struct(
        field(first, 6, 2).alias("version"),
        (field(first, 5, 1) == 1).alias("padding"),
        extended.alias("extension"),
        csrc.alias("csrc"),
        (field(second, 7, 1) == 1).alias("marker"),
        field(second, 0, 7).alias("payload_type"),
        be(b, 2, 2).alias("seq"),
        be(b, 4, 4).alias("timestamp"),
        be(b, 8, 4).alias("ssrc"),
        F.substring(b, start + 1, size).alias("payload"),
    )
    return F.when(F.octet_length(b) >= HEADER, found)


def packetize(rows: DataFrame, mtu: int = 1400) -> DataFrame:
    """id, k, pieces, marker, payload of (id, b): as many pieces as the mtu less a header asks for, the last one marked."""
    room = mtu - HEADER
    pieces = F.greatest(F.ceil(F.octet_length("b") / room), F.lit(1)).cast("int")
    # pieces are cut before rows multiply, so that no row carries more than its own
    each = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda k: F.struct(k.alias("k"), F.substring("b", k * room + 1, F.lit(room)).alias("payload")))
    cut = rows.select("id", "b", pieces.alias("pieces")).select("id", "pieces", F.explode(each).alias("p"))
    return cut.select("id", "p.k", "pieces", (F.col("p.k") == F.col("pieces") - 1).alias("marker"), "p.payload")


def session(pieces: DataFrame, stream: str, order: list[str], start: int = 0, step: int = 160) -> DataFrame:
    """Adds seq (16 bits) and timestamp (32 bits): both wrap; a frame's pieces share a timestamp."""
    whole = Window.partitionBy(stream).orderBy(*order)
    frame = Window.partitionBy(stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    turn = F.row_number().over(whole) - 1 + start
    before = F.coalesce(F.sum(F.col("marker").cast("long")).over(frame), F.lit(0))
    return pieces.withColumn("seq", F.pmod(turn, F.lit(65536))).withColumn("timestamp", F.pmod(before * step, F.lit(1 << 32)))


def unwrap(rows: DataFrame, stream: str, arrival: str, seq: str = "seq") -> DataFrame:
    """Adds long_seq: 16-bit numbers made one rising count, by arrival; a fall of more than half the range is a wrap."""
    order = Window.partitionBy(stream).orderBy(arrival)
    fall = (F.col(seq) < F.lag(seq).over(order) - 32768).cast("long") - (F.col(seq) > F.lag(seq).over(order) + 32768).cast("long")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_fall", F.coalesce(fall, F.lit(0))).withColumn("long_seq", F.col(seq) + 65536 * F.sum("_fall").over(so_far)).drop("_fall")


def reassemble(rows: DataFrame, stream: str = "ssrc") -> DataFrame:
    """stream, first, last, packets, b: payloads up to each marker, joined in order; a tail without a marker is no frame."""
    before = Window.partitionBy(stream).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    framed = rows.withColumn("frame", F.coalesce(F.sum(F.col("marker").cast("int")).over(before), F.lit(0)))
    groups = framed.groupBy(stream, "frame").agg(F.array_sort(F.collect_list(F.struct("seq", "b"))).alias("l"), F.max("marker").alias("ended")).where("ended")
    return groups.select(stream, "frame", F.get("l.seq", F.lit(0)).alias("first"), F.get("l.seq", F.size("l") - 1).alias("last"), F.size("l").alias("packets"), joined(F.col("l.b")).alias("b"))


def loss(rows: DataFrame, stream: str = "stream") -> DataFrame:
    """stream, received, lost, repeated, rate: gaps between distinct numbers in order."""
    once = rows.groupBy(stream, "seq").agg(F.count("*").alias("copies"))
    gap = F.col("seq") - F.lag("seq").over(Window.partitionBy(stream).orderBy("seq")) - 1
    sums = once.withColumn("gap", F.coalesce(gap, F.lit(0))).groupBy(stream).agg(F.count("*").alias("received"), F.sum("gap").alias("lost"), F.sum(F.col("copies") - 1).alias("repeated"))
    return sums.withColumn("rate", F.col("lost") / (F.col("received") + F.col("lost")))


def fill_gaps(rows: DataFrame, stream: str = "stream") -> DataFrame:
    """stream, seq, x, lost: every number from the first to the last once, with the last value heard where one is missing."""
    once = rows.groupBy(stream, "seq").agg(F.first("x").alias("x"))
    after = F.coalesce(F.lead("seq").over(Window.partitionBy(stream).orderBy("seq")) - 1, F.col("seq"))
    spans = once.select(stream, "x", F.col("seq").alias("from"), after.alias("to"))
    return spans.select(stream, "x", "from", F.explode(F.sequence("from", "to")).alias("seq")).select(stream, "seq", "x", (F.col("seq") > F.col("from")).alias("lost"))


def frame_message(codec: Column, seq: Column, payload: Column) -> Column:
    """Codec byte, 16-bit number, 16-bit length, payload."""
    return F.concat(to_be(codec.cast("long"), 1), to_be(seq.cast("long"), 2), to_be(F.octet_length(payload).cast("long"), 2), payload)


def parse_message(b: Column) -> Column:
    """struct<codec, seq, payload>, or null where the length is more than there is."""
    size = be(b, 3, 2)
    found = F.struct(u8(b, 0).alias("codec"), be(b, 1, 2).alias("seq"), F.substring(b, F.lit(6), size.cast("int")).alias("payload"))
    return F.when((F.octet_length(b) >= 5) & (size + 5 <= F.octet_length(b)), found)


def parse_sdp(text: Column) -> Column:
    """struct<name, rate, channels> of the audio line's map, or of the first map."""
    lines = F.split(text, "\r?\n")
    wanted = F.regexp_extract(F.get(F.filter(lines, lambda s: s.startswith("m=audio")), F.lit(0)), r"^m=audio \S+ \S+ (\S+)", 1)
    maps = F.transform(F.filter(lines, lambda s: s.startswith("a=rtpmap:")), lambda s: F.split(F.regexp_replace(s, "^a=rtpmap:", ""), " "))
    own = F.get(F.filter(maps, lambda p: (F.size(p) > 1) & (F.get(p, F.lit(0)) == wanted)), F.lit(0))
    first = F.get(maps, F.lit(0))
    spec = F.split(F.coalesce(F.get(own, F.lit(1)), F.get(first, F.size(first) - 1)), "/")
    rate = F.coalesce(F.get(spec, F.lit(1)).try_cast("int"), F.lit(8000))
    channels = F.coalesce(F.get(spec, F.lit(2)).try_cast("int"), F.lit(1))
    return F.when(F.size(spec) > 1, F.struct(F.upper(F.get(spec, F.lit(0))).alias("name"), rate.alias("rate"), channels.alias("channels")))


def parse_response(text: Column) -> Column:
    """struct<status, reason, headers map with lower-case names, body>."""
    head = F.regexp_extract(text, r"(?s)^(.*?)\r?\n\r?\n", 1)
    body = F.regexp_replace(text, r"(?s)^.*?\r?\n\r?\n", "")
    lines = F.split(head, "\r?\n")
    status = F.regexp_extract(F.get(lines, F.lit(0)), r"^\S+ (\d+)", 1).try_cast("int")
    reason = F.regexp_extract(F.get(lines, F.lit(0)), r"^\S+ \d+ (.*)$", 1)
    pairs = F.transform(F.filter(F.slice(lines, 2, F.size(lines)), lambda s: s.contains(":")), lambda s: F.struct(F.lower(F.trim(F.regexp_extract(s, "^([^:]*):", 1))).alias("k"), F.trim(F.regexp_replace(s, "^[^:]*:", "")).alias("v")))
    # of repeated headers the last one holds: for each name in order, its last pair
    numbered = F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v")))
    headers = let(F.array_sort(numbered), lambda p: F.map_from_entries(F.transform(F.filter(p, lambda x, i: (i == F.size(p) - 1) | (x["k"] != F.get(p["k"], i + 1))), lambda x: F.struct(x["k"], x["v"]))))
    return F.struct(status.alias("status"), reason.alias("reason"), headers.alias("headers"), body.alias("body"))


def split_interleaved(rows: DataFrame) -> DataFrame:
    """id, k, channel, payload of (id, b): the '$'-framed pieces of captured bytes; others are passed over.

    Where a frame begins depends on the lengths of all before it, so a capture is walked once, in a table function.
    """

    def walk(batches):
        for pdf in batches:
            out = []
            for i, b in zip(pdf["id"], pdf["b"], strict=True):
                at, k = 0, 0
                while b is not None and at + 4 <= len(b):
                    size = int.from_bytes(b[at + 2 : at + 4], "big")
                    if b[at] != 0x24 or at + 4 + size > len(b):
                        at += 1
                        continue
                    out.append((i, k, b[at + 1], bytes(b[at + 4 : at + 4 + size])))
                    at, k = at + 4 + size, k + 1
            yield pd.DataFrame(out, columns=["id", "k", "channel", "payload"])

    return rows.select("id", "b").mapInPandas(walk, "id long, k int, channel int, payload binary")
