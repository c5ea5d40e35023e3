"""Audio streams written batch by batch: the writer for a codec's name, its header, chunks and trailer.

A batch writes its chunks to a folder of its own number, over what an earlier try of the batch left there, and its
header and trailer likewise; so a batch that comes again changes nothing. A file is its streams' pieces in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxtone.functions.headers import wav_header
from fluxtone.operators.containers import join_chunks, lacing, ogg_page
from fluxtone.streaming.jobs import each_batch

#: Samples of a frame (20 ms at 48 kHz), and samples that a decoder leaves out at first.
FRAME, SKIP = 960, 3840
VENDOR = b"fluxtone"
OPUS_HEAD = b"OpusHead" + bytes([1, 1]) + SKIP.to_bytes(2, "little") + (48000).to_bytes(4, "little") + bytes(3)
OPUS_TAGS = b"OpusTags" + len(VENDOR).to_bytes(4, "little") + VENDOR + bytes(4)
MOST = 255 * 254


def kind_of(codec: str | None) -> str:
    """Opus goes to Ogg pages, wav and pcm to a WAV file, all else and null to a file of the chunks as they are."""
    name = (codec or "").lower()
    return "ogg" if name == "opus" else "wav" if name in ("wav", "pcm") else "mp3"


def _so_far(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    """stream, before: chunks of a stream in all batches before this one, as the one before left them."""
    if not batch:
        return spark.createDataFrame([], "stream long, before long")
    return spark.read.schema("stream long, before long").parquet(f"{folder}/counts/part={batch - 1}").select("stream", "before")


def write_batch(chunks: DataFrame, batch: int, kind: str, folder: str) -> None:
    """Appends a batch of (stream, seq, b) to its streams: in order of seq within the batch, batches in their order."""
    spark = chunks.sparkSession
    before = _so_far(spark, folder, batch)
    new = chunks.groupBy("stream").agg(F.count("*").alias("before"))
    before.union(new).groupBy("stream").agg(F.sum("before").alias("before")).write.mode("overwrite").parquet(f"{folder}/counts/part={batch}")
    own = F.row_number().over(Window.partitionBy("stream").orderBy("seq"))
    rows = chunks.withColumn("own", own).join(before, "stream", "left")
    k = (F.coalesce("before", F.lit(0)) + F.col("own")).cast("long")  # from 1
    piece = F.col("b")
    if kind == "ogg":
        page = ogg_page(F.lit(0), SKIP + k * FRAME, F.col("stream"), k + 1, lacing(F.octet_length("b")), F.col("b"))
        piece = F.when(F.octet_length("b") <= MOST, page).otherwise(F.raise_error(F.lit("a packet of more than a page")).cast("binary"))
    rows.select("stream", k.alias("k"), piece.alias("payload")).write.mode("overwrite").parquet(f"{folder}/chunks/part={batch}")


def finish(spark: SparkSession, kind: str, folder: str, rate: int = 24000) -> DataFrame:
    """stream, b: each stream's file, with its header and trailer. Asked again, it gives the same again."""
    chunks = spark.read.schema("stream long, k long, payload binary").parquet(f"{folder}/chunks").select("stream", "k", "payload")
    ends = chunks.groupBy("stream").agg(F.max("k").alias("last"))
    rows = chunks
    if kind == "ogg":
        packet = lambda flags, number, granule, b: ogg_page(F.lit(flags), granule, F.col("stream"), number, lacing(F.octet_length(b)), b)
        zero = F.lit(0).cast("long")
        first = F.concat(packet(2, zero, zero, F.lit(OPUS_HEAD)), packet(0, zero + 1, zero, F.lit(OPUS_TAGS)))
        rows = rows.union(ends.select("stream", zero, first)).union(ends.select("stream", F.col("last") + 1, packet(4, F.col("last") + 2, SKIP + F.col("last") * FRAME, F.lit(b""))))
    files = join_chunks(rows.select(F.col("stream").alias("id"), "k", "payload"))
    body = F.concat(wav_header(F.octet_length("b"), rate), "b") if kind == "wav" else F.col("b")
    return files.select(F.col("id").alias("stream"), body.alias("b"))


def write_streams(stream: DataFrame, codec: str | None, folder: str, rate: int = 24000) -> DataFrame:
    """Runs a streaming (stream, seq, b) into the writer of ``codec`` and returns the files: stream, b."""
    kind = kind_of(codec)
    each_batch(stream, lambda batch, number: write_batch(batch, number, kind, folder), f"{folder}/state")
    return finish(stream.sparkSession, kind, folder, rate)
