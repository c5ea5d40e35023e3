"""Lossless coding of blocks of samples: rows of blocks become rows of frames, and back.

A block meets every kind of subframe as a row of its own, and the one of the least size stays: rows of a block are in
one task, so the aggregation sends on one row a block. Wide expressions are spread over columns, one step each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxtone.functions import flac
from fluxtone.functions.bits import bits_at, bits_of, from_bits, let, shifted_left, shifted_right, to_bits
from fluxtone.functions.flac import CONSTANT, FIX, FIXED, LPC, PRECISION, VERBATIM, WIDTHS, after, codes, signed, to_signed, total

def _none() -> Column:
    return F.array().cast("array<bigint>")


def _fixed(order: int) -> Column:
    return F.array(*[F.lit(w).cast("bigint") for w in FIXED[order]]).cast("array<bigint>")


def options(blocks: DataFrame, keys: list[str], orders: tuple[int, ...] = flac.ORDERS) -> DataFrame:
    """keys, n, low, own, s, kind, q, shift, z, bits: every kind of subframe that a block (keys, v, width) can have.

    ``low`` bits are 0 in all samples; ``s`` are the samples without them, of ``own`` bits; ``z`` is the residual as
    zigzag numbers; ``bits`` is the subframe's size with one partition.
    """
    most = max(orders, default=0)
    rows = blocks.where(F.size("v") > 0).select(*keys, "v", "width", F.size("v").alias("n"), flac.wasted(F.col("v")).alias("low"))
    rows = rows.select(*keys, "n", "low", (F.col("width") - F.col("low")).alias("own"), F.transform("v", lambda x: shifted_right(x, F.col("low"))).alias("s"))
    kind = lambda k, q, a: F.struct(F.lit(k).alias("kind"), q.alias("fixed"), a.cast("array<double>").alias("a"))
    listed = [kind(CONSTANT, _none(), F.lit(None)), kind(VERBATIM, _none(), F.lit(None)), *[kind(FIX + o, _fixed(o), F.lit(None)) for o in FIXED]]
    if orders:
        rows = rows.withColumn("r", flac.autocorrelations(F.col("s"), most)).withColumn("weights", flac.predictors(F.col("r"), most))
        listed += [kind(LPC + o, _none(), F.get("weights", F.lit(o - 1))) for o in orders]
    rows = rows.withColumn("o", F.explode(F.array(*listed))).select(*keys, "n", "low", "own", "s", "o.*").withColumn("fit", flac.quantised(F.col("a")))
    linear = F.col("kind") > LPC
    rows = rows.where(~linear | F.col("fit").isNotNull()).select(*keys, "n", "low", "own", "s", "kind", F.when(linear, F.col("fit.q")).otherwise(F.col("fixed")).alias("q"), F.when(linear, F.col("fit.shift")).otherwise(0).alias("shift"))
    order = F.size("q")
    rows = rows.where((order < F.col("n")) & ((F.col("kind") != CONSTANT) | (F.size(F.array_distinct("s")) == 1)))
    rows = rows.withColumn("z", F.when(F.col("kind") >= FIX, F.transform(flac.residual(F.col("s"), F.col("q"), F.col("shift")), flac.zigzag)).otherwise(_none()))
    plain = F.when(F.col("kind") == CONSTANT, 1).when(F.col("kind") == VERBATIM, F.col("n")).otherwise(order) * F.col("own")
    weights = F.when(F.col("kind") > LPC, 9 + order * PRECISION).otherwise(0)
    coded = F.when(F.col("kind") >= FIX, flac.parameter(F.col("z"))["bits"] + 6 + WIDTHS[0]).otherwise(0)
    return rows.withColumn("bits", (8 + F.col("low") + plain + weights + coded).cast("long"))


def subframes(blocks: DataFrame, keys: list[str], orders: tuple[int, ...] = flac.ORDERS) -> DataFrame:
    """keys, n, kind, q, shift, low, halvings, digits: a block's subframe of the least size (by one partition, ties to the lower kind), its residual in the partitions that are least."""
    fields = ["bits", "kind", "q", "shift", "low", "own", "n", "s", "z"]
    best = options(blocks, keys, orders).groupBy(keys).agg(F.min(F.struct(*fields)).alias("b")).select(*keys, "b.*")
    order, coded = F.size("q"), F.col("kind") >= FIX
    rows = best.withColumn("plan", F.when(coded, flac.partitions(F.col("z"), order)))
    head = F.concat(F.lit("0"), to_bits(F.col("kind"), 6), F.when(F.col("low") > 0, F.concat(F.lit("1"), F.repeat(F.lit("0"), F.col("low") - 1), F.lit("1"))).otherwise("0"))
    count = F.when(F.col("kind") == CONSTANT, 1).when(F.col("kind") == VERBATIM, F.col("n")).otherwise(order)
    first = F.array_join(F.transform(F.slice("s", F.lit(1), count), lambda x: signed(x, F.col("own"))), "")
    weights = F.when(F.col("kind") > LPC, F.concat(to_bits(F.lit(PRECISION - 1), 4), to_bits(F.col("shift"), 5), F.array_join(F.transform("q", lambda w: signed(w, F.lit(PRECISION))), ""))).otherwise("")
    left = F.when(coded, flac.residual_digits(F.col("z"), order, F.col("plan"))).otherwise("")
    return rows.select(*keys, "n", "kind", "q", "shift", "low", F.coalesce("plan.halvings", F.lit(0)).alias("halvings"), F.concat(head, first, weights, left).alias("digits"))


def frames(blocks: DataFrame, rate: int = 44100, width: int = 16, orders: tuple[int, ...] = flac.ORDERS) -> DataFrame:
    """id, number, b of (id, number, v array<array<long>>): a frame for each block of one channel, or of two, which are
    left and right, or one of them and their difference, or their middle and difference, whatever is least.

    Samples have 8, 12, 16, 20, 24 or 32 bits; a block has 1 to 65,536 of them; other rows give none.
    """
    keys, l, r = ["id", "number", "stereo", "c"], F.get("v", F.lit(0)), F.get("v", F.lit(1))
    channel = lambda c, v, bits: F.struct(F.lit(c).alias("c"), v.alias("v"), F.lit(bits).alias("width"))
    both = F.array(channel("l", l, width), channel("r", r, width), channel("m", F.zip_with(l, r, lambda a, b: shifted_right(a + b, 1)), width), channel("s", F.zip_with(l, r, lambda a, b: a - b), width + 1))
    stereo = F.size("v") == 2
    rows = blocks.where((F.size("v") == 1) | stereo & (F.size(l) == F.size(r))).where(F.size(l).between(1, 65536))
    rows = rows.select("id", "number", stereo.alias("stereo"), F.explode(F.when(stereo, both).otherwise(F.array(channel("l", l, width)))).alias("x")).select("id", "number", "stereo", "x.*")
    coded = subframes(rows, keys, orders)
    of = lambda c: F.max(F.when(F.col("c") == c, F.col("digits"))).alias(c)
    met = coded.groupBy("id", "number", "stereo").agg(F.max("n").alias("n"), *[of(c) for c in "lrms"])
    choice = lambda layout, x, y: F.struct((F.length(x) + F.length(y)).alias("size"), F.lit(layout).alias("layout"), F.concat(x, y).alias("digits"))
    least = F.least(choice(1, F.col("l"), F.col("r")), choice(8, F.col("l"), F.col("s")), choice(9, F.col("s"), F.col("r")), choice(10, F.col("m"), F.col("s")))
    met = met.withColumn("choice", F.when(F.col("stereo"), least).otherwise(choice(0, F.col("l"), F.lit(""))))
    head = flac.head(F.col("number"), F.col("n"), F.col("choice.layout"), rate, width)
    byte = lambda n, size: F.unhex(F.lpad(F.hex(n.cast("long")), 2 * size, "0"))
    found = met.select("id", "number", head.alias("head"), from_bits(F.col("choice.digits")).alias("body"))
    found = found.select("id", "number", F.concat("head", byte(flac.crc8(F.col("head")), 1), "body").alias("b"))
    return found.select("id", "number", F.concat("b", byte(flac.crc16(F.col("b")), 2)).alias("b"))


def _residual(rows: DataFrame, at: str, good: Column, order: Column) -> DataFrame:
    """Reads a coded residual from the digits in column ``at``: adds left (array<long>, null where it is cut off) and leaves in ``at`` the digits after it."""
    rows = rows.withColumn("_width", F.when(good, F.get(F.array(*[F.lit(w) for w in WIDTHS]), bits_at(F.col(at), 0, 2).cast("int")))).withColumn("_halvings", bits_at(F.col(at), 2, 4).cast("int"))
    rows = rows.withColumn("_part", shifted_right(F.col("n"), F.col("_halvings")))
    fits = F.col("_width").isNotNull() & (shifted_left(F.col("_part"), F.col("_halvings")) == F.col("n")) & (F.col("_part") >= order)
    nothing = F.array().cast("array<array<bigint>>")
    start = F.struct(nothing.alias("v"), after(F.col(at), 6).alias("rest"))

    def partition(s: Column, j: Column) -> Column:
        count = F.col("_part") - F.when(j == 0, order).otherwise(0)
        k = F.conv(F.substring(s["rest"], F.lit(1), F.col("_width")), 2, 10).cast("int")
        escape = k == shifted_left(F.lit(1), F.col("_width")) - 1
        wide = F.conv(F.substring(s["rest"], F.col("_width") + 1, F.lit(5)), 2, 10).cast("int")
        skipped = F.col("_width") + F.when(escape, 5).otherwise(0)
        pattern = F.when(~escape, F.format_string("0*1[01]{%d}", k)).when(wide > 0, F.format_string("[01]{%d}", wide))
        found = F.when(escape & (wide == 0), F.array_repeat(F.lit(""), count)).otherwise(codes(after(s["rest"], skipped), pattern, count))

        def taken(c: Column) -> Column:
            value = F.transform(c, lambda x: F.when(escape, F.coalesce(to_signed(x), F.lit(0))).otherwise(flac.decoded(x, k)))
            size = total(F.transform(c, lambda x: F.length(x).cast("long"))).cast("int")
            return F.when(F.size(c) == count, F.struct(F.array_append(s["v"], value).alias("v"), after(s["rest"], skipped + size).alias("rest")))

        return let(found, taken)

    rows = rows.withColumn("_read", F.when(fits, F.aggregate(F.sequence(F.lit(0), shifted_left(F.lit(1), F.col("_halvings")) - 1), start, partition)))
    return rows.withColumn("left", F.flatten("_read.v")).withColumn(at, F.when(good, F.col("_read.rest")).otherwise(F.col(at))).drop("_width", "_halvings", "_part", "_read")


def read_subframe(rows: DataFrame, at: str, width: Column, out: str) -> DataFrame:
    """Reads a subframe of ``n`` samples of ``width`` bits from the digits in column ``at``.

    Adds ``out`` (array<long>, null where the digits hold no whole subframe) and leaves in ``at`` the digits after it.
    """
    kind, n = F.col("_kind"), F.col("n")
    rows = rows.withColumn("_flag", F.length(F.regexp_extract(at, "^0[01]{6}(0|10*1)", 1))).withColumn("_kind", bits_at(F.col(at), 1, 6).cast("int"))
    rows = rows.withColumn("_low", F.greatest(F.col("_flag") - 1, F.lit(0))).withColumn("_own", width - F.col("_low"))
    order = F.when(kind.between(FIX, FIX + 4), kind - FIX).when(kind > LPC, kind - LPC).when(kind == CONSTANT, 1).when(kind == VERBATIM, n)
    rows = rows.withColumn("_order", F.when((F.col("_flag") > 0) & (F.col("_own") > 0) & (order <= n), order)).withColumn(at, after(F.col(at), 7 + F.col("_flag")))
    order, fit = F.col("_order"), lambda digits, bits, count: F.transform(codes(F.substring(digits, F.lit(1), bits * count), F.format_string("[01]{%d}", bits), count), to_signed)
    rows = rows.withColumn("_first", F.when(order.isNotNull(), fit(F.col(at), F.col("_own"), order)))
    rows = rows.withColumn("_whole", F.coalesce(F.size("_first") == order, F.lit(False))).withColumn(at, after(F.col(at), order * F.col("_own")))
    linear = F.col("_whole") & (kind > LPC)
    rows = rows.withColumn("_bits", F.when(linear, bits_at(F.col(at), 0, 4).cast("int") + 1)).withColumn("_shift", F.when(linear, to_signed(F.substring(F.col(at), 5, 5)).cast("int")).otherwise(0))
    rows = rows.withColumn("_q", F.when(linear, fit(after(F.col(at), 9), F.col("_bits"), order)).otherwise(F.get(F.array(*[_fixed(o) for o in FIXED]), kind - FIX)))
    rows = rows.withColumn(at, F.when(linear, after(F.col(at), 9 + order * F.col("_bits"))).otherwise(F.col(at)))
    predicted = F.col("_whole") & (kind >= FIX) & (F.size("_q") == order) & (F.col("_shift") >= 0)
    rows = _residual(rows, at, F.coalesce(predicted, F.lit(False)), order)
    found = F.when(kind == CONSTANT, F.array_repeat(F.get("_first", F.lit(0)), n)).when(kind == VERBATIM, F.col("_first")).when(F.col("left").isNotNull(), flac.restore(F.col("_first"), F.col("left"), F.col("_q"), F.col("_shift")))
    rows = rows.withColumn("_v", F.when(F.col("_whole"), found))
    rows = rows.withColumn(out, F.transform("_v", lambda x: shifted_left(x, F.col("_low"))))
    return rows.drop("_flag", "_kind", "_low", "_own", "_order", "_first", "_whole", "_bits", "_shift", "_q", "_v", "left")


def read_frames(frames: DataFrame, width: int = 16, channels: int = 2) -> DataFrame:
    """id, k, number, n, v array<array<long>> of (id, k, b): frames whose checksums hold, channel by channel.

    ``v`` is null where a subframe is cut off, or where there are more than ``channels``. ``width`` is that of the
    stream, for frames that leave it to its header.
    """
    rows = frames.withColumn("h", flac.frame_head(F.col("b"))).where(F.col("h").isNotNull() & (flac.crc16(F.col("b")) == 0))
    count = F.when(F.col("h.layout") < 8, F.col("h.layout") + 1).otherwise(2)
    rows = rows.select("id", "k", "h.number", F.col("h.samples").alias("n"), F.col("h.layout").alias("layout"), F.coalesce("h.width", F.lit(width)).alias("width"), count.alias("count"), bits_of(F.substring("b", F.col("h.size") + 1, F.octet_length("b") - F.col("h.size") - 2)).alias("rest"))
    apart = F.when(F.col("layout") == 9, 0).when(F.col("layout").isin(8, 10), 1).otherwise(-1)  # the channel that is a difference
    for c in range(channels):
        rows = read_subframe(rows, "rest", F.col("width") + F.when(apart == c, 1).otherwise(0), f"c{c}")
    found = F.slice(F.array(*[F.col(f"c{c}") for c in range(channels)]), F.lit(1), F.col("count"))
    v = F.when((F.col("count") <= channels) & ~F.exists(found, lambda x: x.isNull()), found)
    if channels >= 2:
        a, b = F.col("c0"), F.col("c1")
        whole = lambda m, s: m * 2 + F.pmod(s, F.lit(2))
        left_side = F.array(a, F.zip_with(a, b, lambda l, s: l - s))
        side_right = F.array(F.zip_with(a, b, lambda s, r: s + r), b)
        mid_side = F.array(F.zip_with(a, b, lambda m, s: shifted_right(whole(m, s) + s, 1)), F.zip_with(a, b, lambda m, s: shifted_right(whole(m, s) - s, 1)))
        v = F.when(v.isNotNull(), F.when(F.col("layout") == 8, left_side).when(F.col("layout") == 9, side_right).when(F.col("layout") == 10, mid_side).otherwise(v))
    return rows.select("id", "k", "number", "n", v.alias("v"))


#: Marks after a frame's that are tried as its end before all others are.
NEAR = 8


def frame_spans(files: DataFrame) -> DataFrame:
    """id, k, start, b of (id, b): the frames of a file, numbered from 0, found by their marks.

    A frame begins at a mark whose header's checksum holds, and ends at the first such mark after it, or at the end of
    the file, where its own checksum holds. What else looks like a mark, in samples or between frames, fails a test.
    """
    byte = lambda i: F.substring("b", i, F.lit(1))
    marks = F.filter(F.sequence(F.lit(0), F.octet_length("b") - 5), lambda i: (byte(i + 1) == F.lit(b"\xff")) & byte(i + 2).isin(b"\xf8", b"\xf9"))
    heads = F.filter(marks, lambda i: flac.frame_head(F.substring("b", i + 1, F.lit(16))).isNotNull())
    rows = files.where(F.octet_length("b") >= 6).select("id", "b", heads.alias("heads")).select("id", "b", F.concat("heads", F.array(F.octet_length("b"))).alias("at"))

    def end(start: Column, ends: Column) -> Column:
        return F.aggregate(ends, F.lit(None).cast("int"), lambda found, e: F.when(found.isNotNull(), found).when(flac.crc16(F.substring("b", start + 1, e - start)) == 0, e))

    spans = F.transform(F.slice("at", F.lit(1), F.size("at") - 1), lambda s, i: F.struct(s.alias("start"), F.coalesce(end(s, F.slice("at", i + 2, F.lit(NEAR))), end(s, F.slice("at", i + 2 + NEAR, F.size("at")))).alias("end")))
    rows = rows.select("id", "b", F.filter(spans, lambda c: c["end"].isNotNull()).alias("spans"))
    # frames are cut before rows multiply
    cut = F.transform("spans", lambda c, k: F.struct(k.alias("k"), c["start"].alias("start"), F.substring("b", c["start"] + 1, c["end"] - c["start"]).alias("b")))
    return rows.select("id", F.explode(cut).alias("f")).select("id", "f.*")
