"""Transforms of sample frames in long form (id, n, x): one row a sample, one aggregation a transform.

A bin is a sum over samples, so a transform is an explode of the bins followed by an aggregation that combines in
each task; the rows of a frame are multiplied by its bins and by no other frame's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxtone.functions.bits import from_bits, let, to_bits

from fluxtone.functions.signal import window


def dft(frames: DataFrame, size: int, kind: str = "hann", bins: int | None = None) -> DataFrame:
    """id, k, re, im of windowed frames; shorter ones count as padded with zeros."""
    bins = bins or size // 2 + 1
    rows = frames.where(F.col("n") < size).select("id", "n", (F.col("x") * window(F.col("n"), size, kind)).alias("x"))
    each = rows.select("id", "n", "x", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("k"))
    angle = 2 * math.pi * ((F.col("k") * F.col("n")) % size) / size
    return each.groupBy("id", "k").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), (-F.sum(F.col("x") * F.sin(angle))).alias("im"))


def magnitude(spectrum: DataFrame) -> DataFrame:
    return spectrum.select("id", "k", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("magnitude"))


def power_db(magnitude: Column, size: int) -> Column:
    level = magnitude / (size / 2)
    return F.when(level > 1e-6, F.greatest(20 * F.log10(level), F.lit(-120.0))).otherwise(-120.0)


def mdct(frames: DataFrame, half: int) -> DataFrame:
    """id, k, c of frames of 2 * half samples under the power-complementary window."""
    n, size = F.col("n"), 2 * half
    shape = F.sin(F.lit(math.pi / 2) * F.pow(F.sin(math.pi / size * (n + 0.5)), 2))
    rows = frames.where(n < size).select("id", "n", (F.col("x") * shape).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(half - 1))).alias("k"))
    angle = math.pi / half * (n + 0.5 + half / 2) * (F.col("k") + 0.5)
    return rows.groupBy("id", "k").agg((F.sum(F.col("x") * F.cos(angle)) * (2 / half)).alias("c"))


def imdct(coefficients: DataFrame, half: int) -> DataFrame:
    """id, n, y of 2 * half windowed samples (sine window) of ``half`` coefficients."""
    rows = coefficients.select("id", "k", "c", F.explode(F.sequence(F.lit(0), F.lit(2 * half - 1))).alias("n"))
    angle = math.pi / (4 * half) * (2 * F.col("n") + 1 + half) * (2 * F.col("k") + 1)
    sums = rows.groupBy("id", "n").agg((F.sum(F.col("c") * F.cos(angle)) * (2 / half)).alias("y"))
    return sums.select("id", "n", (F.col("y") * F.sin(math.pi / (2 * half) * (F.col("n") + 0.5))).alias("y"))


def overlap_add(blocks: DataFrame, hop: int) -> DataFrame:
    """stream, n, y: the first half of each block (id in order within a stream) plus the second half of the one before."""
    return blocks.groupBy("stream", (F.col("id") * hop + F.col("n")).alias("n")).agg(F.sum("y").alias("y"))


def requantize(q: Column, gain: Column) -> Column:
    """Sign times magnitude to the power 4/3 times 2 to a quarter of the gain."""
    return F.signum(q) * F.pow(F.abs(q).cast("double"), F.lit(4.0 / 3)) * F.pow(F.lit(2.0), gain / 4)


# The butterflies' constants between neighbouring bands of 18 lines.
BUTTERFLIES = (-0.6, -0.535, -0.33, -0.185, -0.095, -0.041, -0.0142, -0.0037)
LINES = 18


def reduce_alias(lines: Column) -> Column:
    """Butterflies over the eight lines on each side of the bounds between whole bands of an array of lines.

    The lines below a bound lose, and those above it gain, their mirror image across it: no line is in two butterflies.
    """
    cosine, sine = (F.array(*[F.lit(v) for v in values]) for values in ([1 / math.sqrt(1 + c * c) for c in BUTTERFLIES], [c / math.sqrt(1 + c * c) for c in BUTTERFLIES]))

    def turned(lines: Column, v: Column, at: Column) -> Column:
        bands, band, place = F.floor(F.size(lines) / LINES), F.floor(at / LINES), at % LINES
        low, high = LINES - 1 - place, place  # distances from the bound above and from the one below
        below = v * F.get(cosine, low) - F.get(lines, at + 2 * low + 1) * F.get(sine, low)
        above = v * F.get(cosine, high) + F.get(lines, at - 2 * high - 1) * F.get(sine, high)
        return F.when((low < len(BUTTERFLIES)) & (band + 1 < bands), below).when((high < len(BUTTERFLIES)) & (band > 0) & (band < bands), above).otherwise(v)

    return let(lines, lambda whole: F.transform(whole, lambda v, at: turned(whole, v, at)))


def plain_imdct(coefficients: DataFrame, half: int) -> DataFrame:
    """id, n, y of 2 * half samples without a window or a scale: 18 coefficients a long block, 6 a short one."""
    rows = coefficients.select("id", "k", "c", F.explode(F.sequence(F.lit(0), F.lit(2 * half - 1))).alias("n"))
    angle = math.pi / (4 * half) * (2 * F.col("n") + 1 + half) * (2 * F.col("k") + 1)
    return rows.groupBy("id", "n").agg(F.sum(F.col("c") * F.cos(angle)).alias("y"))


def band_codes(coefficients: DataFrame, half: int, bands: int = 21) -> DataFrame:
    """id, codes: 6 bits for each of ``bands`` bands of equal width, twice the level in dB above -28; a silent band has -100 dB.

    A band has a line at least, and bands lie one after another, so the last ones may lie past the end and are silent.
    """
    edges = [0]
    for b in range(bands):
        edges.append(edges[-1] + max(1, (b + 1) * half // bands - b * half // bands))
    each = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(low).alias("low"), F.lit(high).alias("high")) for b, (low, high) in enumerate(zip(edges, edges[1:], strict=False))])
    band = F.filter(each, lambda e: (e["low"] <= F.col("k")) & (F.col("k") < e["high"]))[0]
    sums = coefficients.withColumn("e", band).groupBy("id", F.col("e.band").alias("band"), (F.col("e.high") - F.col("e.low")).alias("width")).agg(F.sum(F.col("c") * F.col("c")).alias("power"))
    rms = F.sqrt(F.col("power") / F.col("width"))
    level = F.when(rms > 0, 20 * F.log10(rms)).otherwise(-100.0)
    code = F.least(F.greatest(((level + 28) * 2).cast("int"), F.lit(0)), F.lit(63))
    found = sums.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("band", code.alias("code")))).alias("m"))
    return found.select("id", F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0))).alias("codes"))


def opus_frame(codes: Column) -> Column:
    """A frame of band codes after the byte of its kind: 6 bits each, then five bits of 0 for what the frame doesn't use."""
    digits = F.concat(F.array_join(F.transform(codes, lambda c: to_bits(c, 6)), ""), F.lit("00000"))
    return F.concat(F.lit(bytes([(8 << 3) | 4])), from_bits(digits))


def left_right(mid: Column, side: Column, scale: float = 1.0) -> tuple[Column, Column]:
    """Left and right lines of mid and side ones: sums and differences times ``scale``, which is the root of a half in MP3 and 1 in AAC."""
    return F.zip_with(mid, side, lambda m, s: (m + s) * scale), F.zip_with(mid, side, lambda m, s: (m - s) * scale)
