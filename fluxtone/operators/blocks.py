"""Streams of samples (stream, n, x) as overlapping blocks, their spectra, and streams again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxtone.functions import fast


def frames(samples: DataFrame, size: int) -> DataFrame:
    """stream, frame, x array<double>: ``size`` samples a frame, n counting from 0; what is missing is 0. A group is one frame."""
    rows = samples.groupBy("stream", F.floor(F.col("n") / size).alias("frame")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("n") % size).cast("int").alias("at"), F.col("x").cast("double").alias("x")))).alias("m"))
    return rows.select("stream", "frame", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("x"))


def overlapping(rows: DataFrame, size: int) -> DataFrame:
    """stream, frame, x: each frame after the one before it, or after silence; where none follows a frame, silence does."""
    silence, order = F.array_repeat(F.lit(0.0), size), Window.partitionBy("stream").orderBy("frame")
    last = F.coalesce(F.lead("frame").over(order) != F.col("frame") + 1, F.lit(True))
    ends = rows.withColumn("last", last).where("last").select("stream", (F.col("frame") + 1).alias("frame"), silence.alias("x"))
    both = rows.union(ends)
    follows = F.lag("frame").over(order) == F.col("frame") - 1
    return both.select("stream", "frame", F.concat(F.when(follows, F.lag("x").over(order)).otherwise(silence), "x").alias("x"))


def spectra(samples: DataFrame, half: int = 960) -> DataFrame:
    """stream, frame, c array<double>: coefficients of windowed blocks that overlap by half, times 2 / half."""
    blocks = overlapping(frames(samples, half), half).select("stream", "frame", fast.shaped(F.col("x"), half).alias("c"))
    return fast.mdct(blocks, "c", half).withColumn("c", F.transform("c", lambda v: v * (2 / half)))


def samples(spectra: DataFrame, half: int = 960) -> DataFrame:
    """stream, n, x: the samples again, by windows and sums of halves that overlap; a half that no block overlaps is left out."""
    blocks = fast.imdct(spectra, "c", half).select("stream", "frame", fast.shaped(F.col("c"), half).alias("y"))
    order = Window.partitionBy("stream").orderBy("frame")
    met = blocks.withColumn("after", F.lead("y").over(order)).withColumn("next", F.lead("frame").over(order)).where(F.col("next") == F.col("frame") + 1)
    whole = F.zip_with(F.slice("y", half + 1, half), F.slice("after", 1, half), lambda a, b: a + b)
    return met.select("stream", "frame", F.posexplode(whole).alias("at", "x")).select("stream", (F.col("frame") * half + F.col("at")).alias("n"), "x")
