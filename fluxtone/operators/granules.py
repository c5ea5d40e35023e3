"""Hybrid synthesis of granules: 576 lines to 576 samples, through overlapped blocks of 32 subbands and a polyphase filter.

Rows are (stream, granule, kind, lines). What goes from one granule to the next is taken from the rows before it in
the stream: the second halves of a granule's blocks, and 15 slots of the filter's matrixed samples.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS, LINES, TAPS = 32, 18, 16
#: Kinds of blocks: usual, start of short ones, three short ones, end of short ones.
USUAL, START, SHORT, STOP = range(4)


def block_window(i: Column, kind: Column) -> Column:
    """Weight of place ``i`` of 36 by kind: sines whose one half is, before and after short blocks, flat and then steep."""
    long, short = F.sin(math.pi / 36 * (i + 0.5)), lambda at: F.sin(math.pi / 12 * (at + 0.5))
    fall = F.when(i < 18, long).when(i < 24, 1.0).when(i < 30, short(i - 18)).otherwise(0.0)
    rise = F.when(i < 6, 0.0).when(i < 12, short(i - 6)).when(i < 18, 1.0).otherwise(long)
    return F.when(kind == START, fall).when(kind == STOP, rise).otherwise(long)


def _sum(n: int, term) -> Column:
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda a, k: a + term(k))


def blocks(lines: Column, kind: Column) -> Column:
    """array<array<double>>: 36 windowed samples of each subband. The lines of three short blocks alternate."""
    line = lambda band, k: F.get(lines, band * LINES + k)
    long = lambda band, i: _sum(18, lambda k: line(band, k) * F.cos(math.pi / 72 * ((2 * i + 19) * (2 * k + 1) % 144))) * block_window(i, kind)

    def short(band: Column, i: Column) -> Column:
        one = lambda w: F.when((i >= 6 + 6 * w) & (i < 18 + 6 * w), _sum(6, lambda k: line(band, 3 * k + w) * F.cos(math.pi / 24 * ((2 * (i - 6 - 6 * w) + 7) * (2 * k + 1) % 48))) * F.sin(math.pi / 12 * (i - 6 - 6 * w + 0.5))).otherwise(0.0)
        return one(0) + one(1) + one(2)

    places, bands = F.sequence(F.lit(0), F.lit(35)), F.sequence(F.lit(0), F.lit(BANDS - 1))
    return F.when(kind == SHORT, F.transform(bands, lambda b: F.transform(places, lambda i: short(b, i)))).otherwise(F.transform(bands, lambda b: F.transform(places, lambda i: long(b, i))))


def subbands(granules: DataFrame) -> DataFrame:
    """stream, granule, s array<array<double>>: 32 subband samples of each of 18 slots; every other one of every other band changes sign."""
    order = Window.partitionBy("stream").orderBy("granule")
    rows = granules.select("stream", "granule", blocks(F.col("lines"), F.col("kind")).alias("z"))
    before = F.when(F.lag("granule").over(order) == F.col("granule") - 1, F.lag("z").over(order))
    rows = rows.select("stream", "granule", "z", before.alias("before"))
    at = lambda z, band, i: F.get(F.get(F.col(z), band), i)
    sign = lambda band, i: F.when((band % 2 == 1) & (i % 2 == 1), -1.0).otherwise(1.0)
    sample = lambda band, i: sign(band, i) * (at("z", band, i) + F.coalesce(at("before", band, i + LINES), F.lit(0.0)))
    return rows.select("stream", "granule", F.transform(F.sequence(F.lit(0), F.lit(LINES - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda band: sample(band, i))).alias("s"))


def tap(n: Column) -> Column:
    """Weight ``n`` of the 512 of the synthesis window: a half sine."""
    return F.sin(math.pi / (BANDS * TAPS) * (n + 0.5))


def synthesis(subband_rows: DataFrame) -> DataFrame:
    """stream, granule, y array<double>: samples by the polyphase filter.

    A slot's 32 values are matrixed into 64. A sample is a weighted sum over the slot and the 15 before it, of the first
    32 of these in even and the last 32 in odd distance; slots before a stream's first are silent.
    """
    matrixed = F.transform("s", lambda s: F.transform(F.sequence(F.lit(0), F.lit(2 * BANDS - 1)), lambda n: _sum(BANDS, lambda k: F.get(s, k) * F.cos(math.pi / 64 * ((n + 16) * (2 * k + 1) % 128)))))
    rows = subband_rows.select("stream", "granule", matrixed.alias("v"))
    # the slots of a granule reach back into the one before it
    order = Window.partitionBy("stream").orderBy("granule")
    silence = F.array_repeat(F.array_repeat(F.lit(0.0), 2 * BANDS), TAPS - 1)
    before = F.when(F.lag("granule").over(order) == F.col("granule") - 1, F.slice(F.lag("v").over(order), LINES - TAPS + 2, TAPS - 1))
    rows = rows.select("stream", "granule", F.concat(F.coalesce(before, silence), "v").alias("v"))
    value = lambda slot, j, i: F.get(F.get("v", slot + TAPS - 1 - i), j + F.when(i % 2 == 0, 0).otherwise(BANDS)) * tap(j + BANDS * i)
    slots = F.transform(F.sequence(F.lit(0), F.lit(LINES - 1)), lambda slot: F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: _sum(TAPS, lambda i: value(slot, j, i))))
    return rows.select("stream", "granule", F.flatten(slots).alias("y"))
