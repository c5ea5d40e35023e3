"""Streaming jobs: duplicates, sessions, reordering, and sinks by batch.

Each job reads files as they come (``availableNow``: all there are, in batches, then it ends) and appends to
Parquet in a folder that driver and executors share. State is keyed by stream.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where all run in one process.

    On a cluster without that setting there is no such folder, and this fails. The setting is left as it is.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_folder()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='fluxtone-')}"


def read(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream. As a pattern, a path may name either."""
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    return (source.option("maxFilesPerTrigger", files_at_once) if files_at_once else source).parquet(f"{path[:-1]}[{path[-1]}]")


def finish(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that there is and returns what it appended."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def in_lots(rows: DataFrame, lot: Column, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run`` on a stream of ``rows`` that come lot by lot (0, 1 and so on), all of a lot in one batch; the last result.

    ``run`` is called after each lot has come, and goes on where it left off.
    """
    spark = rows.sparkSession
    base = f"{shared_folder(spark)}/lots-{uuid.uuid4().hex}"
    numbered = rows.withColumn("lot", lot.cast("int"))
    last = numbered.agg(F.max("lot")).first()[0] or 0
    for i in range(last + 1):
        numbered.where(F.col("lot") == i).drop("lot").write.parquet(f"{base}/{i:04d}")
        out = run(spark.readStream.schema(rows.schema).parquet(f"{base}/*"))
    return out


def appended(build: Callable[[DataFrame], DataFrame], spark: SparkSession, name: str) -> Callable[[DataFrame], DataFrame]:
    """For ``in_lots``: appends what ``build`` makes of the stream to a table, with one state over all lots."""
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def run(stream: DataFrame) -> DataFrame:
        made = build(stream)
        made.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(made.schema).parquet(f"{base}/out")

    return run


def drop_repeats(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """First arrivals; a repeat within ``delay`` of event time is dropped, and state older than that is let go."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, key: str, time: str, gap: str, delay: str) -> DataFrame:
    """key, start, stop, events: sessions that the watermark has closed."""
    grouped = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("events"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "events")


def reorder(stream: DataFrame, slots: int = 64, late: bool = False) -> DataFrame:
    """stream, seq, x, place: rows of each stream in order of seq from 0, released as soon as their turn has come.

    Rows ahead of their turn are held. When more than ``slots`` are, the missing ones are given up and the
    stream goes on with the least one held; rows that come after that are too late and fall away, and so do
    repeats. The state of a stream is its next number, its count, and at most ``slots`` rows from batch to batch.

    With ``late``, rows that are too late and repeats of released ones are appended at once, with place -1, and
    numbers are given up within a batch too: where all numbers come at some time, no row is lost, and ``in_order``
    gives all of them their places. What is held behind a number that never comes stays held.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, count, numbers, values = state.get if state.exists else (0, 0, [], [])
        held = dict(zip(numbers, values, strict=True))
        out = []

        def release() -> None:
            nonlocal following, count
            ahead = sorted(held, reverse=True)  # the least one last
            while ahead and (following == ahead[-1] or len(held) > slots):
                following = ahead.pop()
                out.append((key[0], following, held.pop(following), count))
                following, count = following + 1, count + 1

        for pdf in batches:
            if late:
                out += [(key[0], int(s), float(x), -1) for s, x in zip(pdf["seq"], pdf["x"], strict=True) if s < following]
            held |= {int(s): float(x) for s, x in zip(pdf["seq"], pdf["x"], strict=True) if s >= following}
            if late:
                release()
                yield pd.DataFrame(out, columns=["stream", "seq", "x", "place"])
                out = []
        release()
        state.update((following, count, list(held), list(held.values())))
        yield pd.DataFrame(out, columns=["stream", "seq", "x", "place"])

    return stream.groupBy("stream").applyInPandasWithState(step, "stream long, seq long, x double, place long", "following long, count long, numbers array<long>, held array<double>", "append", GroupStateTimeout.NoTimeout)


def jitter(stream: DataFrame, patience: float, delay: str = "0 seconds") -> DataFrame:
    """stream, seq, x, place, missing of a streaming (stream, seq, t, x): packets in order of seq from 0, with what never came given up in time.

    A packet goes on as soon as all before it have, or been given up. One that waits behind a missing number waits
    until the watermark (the latest t less ``delay``) is ``patience`` seconds past its own t; then the numbers missing
    before it are given up, also if nothing of its stream comes any more. A packet that comes after its number was
    given up, after its like, or after the watermark falls away. ``missing`` counts the numbers given up just before a
    packet. The state of a stream is its next number, its count, and the packets that wait.
    """
    wait = int(patience * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, count, numbers, times, values = state.get if state.exists else (0, 0, [], [], [])
        held = {n: (t, x) for n, t, x in zip(numbers, times, values, strict=True)}
        for pdf in batches:  # none where time has run out
            for n, t, x in zip(pdf["seq"], pdf["t"], pdf["x"], strict=True):
                if n >= following:
                    held.setdefault(int(n), (int(t.timestamp() * 1000), float(x)))
        now = state.getCurrentWatermarkMs()
        tired = max((n for n, (t, _) in held.items() if t + wait <= now), default=-1)
        out, ahead = [], sorted(held, reverse=True)  # the least number last
        while ahead and (ahead[-1] == following or ahead[-1] <= tired):
            n = ahead.pop()
            out.append((key[0], n, held.pop(n)[1], count, n - following))
            following, count = n + 1, count + 1
        state.update((following, count, list(held), [t for t, _ in held.values()], [x for _, x in held.values()]))
        if held:
            state.setTimeoutTimestamp(max(min(t for t, _ in held.values()) + wait, now + 1))
        if out:
            yield pd.DataFrame(out, columns=["stream", "seq", "x", "place", "missing"])

    keyed = stream.withWatermark("t", delay).groupBy("stream")
    return keyed.applyInPandasWithState(step, "stream long, seq long, x double, place long, missing long", "following long, count long, numbers array<long>, times array<long>, held array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def numbered(rows: DataFrame, name: str, width: int = 1 << 16) -> DataFrame:
    """``rows`` with their numbers from 0 by seq within each stream: prefix sums over blocks of ``width`` of seq, then within blocks."""
    rows = rows.withColumn("block", F.floor(F.col("seq") / width))
    before = Window.partitionBy("stream").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("stream", "block").agg(F.count("*").alias("size"))
    ahead = sizes.select("stream", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("stream", "block").orderBy("seq")) - 1
    return rows.withColumn("within", within).join(ahead, ["stream", "block"]).withColumn(name, (F.col("ahead") + F.col("within")).cast("long")).drop("block", "ahead", "within")


def in_order(appended: DataFrame, width: int = 1 << 16) -> DataFrame:
    """What ``reorder`` with ``late`` appended, each number once, with places by seq whenever a row came."""
    return numbered(appended.select("stream", "seq", "x").dropDuplicates(["stream", "seq"]), "place", width)


def each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands each batch to ``sink`` with its number. A batch can come twice after a failure, so sinks write by number."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
