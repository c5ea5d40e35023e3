"""Resampling and overlap-add over streams in long form (stream, n, x)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxtone.functions.signal import window


def resample(rows: DataFrame, ratio: float) -> DataFrame:
    """stream, n, x at ``ratio`` input samples an output sample: a join on the sample before and the one after."""
    ends = rows.groupBy("stream").agg((F.max("n") + 1).alias("size"))
    # output places of each input sample: those whose position lies between it and the next
    spots = rows.join(ends, "stream").withColumn("first", F.ceil(F.col("n") / ratio)).withColumn("last", F.least(F.ceil((F.col("n") + 1) / ratio) - 1, F.floor(F.col("size") / ratio) - 1))
    spots = spots.where("first <= last").select("stream", "n", "x", "size", F.explode(F.sequence("first", "last")).alias("k"))
    after = rows.select("stream", (F.col("n") - 1).alias("n"), F.col("x").alias("next"))
    met = spots.join(after, ["stream", "n"], "left")
    share = F.col("k") * ratio - F.col("n")
    return met.select("stream", F.col("k").cast("long").alias("n"), (F.col("x") * (1 - share) + F.coalesce("next", "x") * share).alias("x"))


def overlap_add(rows: DataFrame, frame: int, hop_in: int, hop_out: int) -> DataFrame:
    """stream, n, y: windowed frames read every ``hop_in`` samples and added up every ``hop_out``; windows are not normalised.

    Each sample knows the frames that hold it, at most ceil(frame / hop_in), so no frame is ever gathered in one
    place and a stream of any length is one combining aggregation. Only whole frames count.
    """
    ends = rows.groupBy("stream").agg((F.max("n") + 1).alias("size"))
    first = F.greatest(F.floor((F.col("n") - frame) / hop_in) + 1, F.lit(0))
    last = F.least(F.floor(F.col("n") / hop_in), F.ceil((F.col("size") - frame) / hop_in) - 1)
    spots = rows.join(ends, "stream").select("stream", "n", "x", first.alias("first"), last.alias("last")).where("first <= last")
    spots = spots.select("stream", "x", "n", F.explode(F.sequence("first", "last")).alias("f"))
    i = F.col("n") - F.col("f") * hop_in
    return spots.groupBy("stream", (F.col("f") * hop_out + i).cast("long").alias("n")).agg(F.sum(F.col("x") * window(i, frame)).alias("y"))


def change_speed(rows: DataFrame, ratio: float, frame: int = 1024) -> DataFrame:
    """Speed by overlap-add at unlike hops; the ratio is held in 0.25 to 4."""
    hop = frame // 4
    return overlap_add(rows, frame, hop, max(1, int(hop / min(max(ratio, 0.25), 4.0))))


def shift_pitch(rows: DataFrame, ratio: float, frame: int = 1024) -> DataFrame:
    """Pitch by resampling, then overlap-add at like hops."""
    hop = frame // 4
    return overlap_add(resample(rows, min(max(ratio, 0.25), 4.0)), frame, hop, hop)


def ratio_of_semitones(semitones: float) -> float:
    return math.pow(2, semitones / 12)
