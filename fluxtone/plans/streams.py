"""Queries that run as streams over the events, held against the same in batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxtone.functions.headers import wav_info
from fluxtone.operators.containers import ogg_packets
from fluxtone.plans import speech as speech_plans
from fluxtone.plans import views
from fluxtone.plans.oracle import PACKETS, SERIES
from fluxtone.streaming import carried, jobs, sinks

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("select event_id as id, user_id as u, round(value, 4) as value from events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which every seventeenth comes twice."""
    events = jobs.read(spark, f"{sf_dir}/events.parquet").withColumn("t", F.col("ts").cast("timestamp"))
    twice = events.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 17 == 5).cast("int"))))
    once = jobs.drop_repeats(twice, ["event_id"], "t", "3650 days")
    out = jobs.finish(once.select(F.col("event_id").alias("id"), F.col("user_id").alias("u"), "value"), "dedup")
    return out.select("id", "u", F.round("value", 4).alias("value"))


GAP, DELAY = 3600, 600


@query(f"""with e as (select user_id as u, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval {GAP} second, true) as opens from events),
  s as (select u, ts, sum(opens::int) over (partition by u order by ts) as k from e),
  g as (select u, min(ts) as start, max(ts) + interval {GAP} second as stop, count(*) as events from s group by u, k)
  select u, floor(epoch(start))::bigint as start, floor(epoch(stop))::bigint as stop, events from g where stop <= (select max(ts) - interval {DELAY} second from events)""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by user, as far as the watermark closes them."""
    events = jobs.read(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("u"), F.col("ts").cast("timestamp").alias("t"))
    out = jobs.finish(jobs.sessions(events, "u", "t", f"{GAP} seconds", f"{DELAY} seconds"), "sessions")
    return out.select("u", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "events")


#: Rows of a stream held ahead of their turn; the result doesn't depend on it.
SLOTS = 100_000


@query(f"select stream, seq, round(x, 6) as x, seq as place from (select stream, row_number() over (partition by stream order by seq) - 1 as seq, x from ({SERIES}))")
def stream_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stream's samples, come in four files by a hash of their numbers, in order again."""
    rows = jobs.numbered(views.series(spark, sf_dir).select("stream", "seq", "x"), "number").select("stream", F.col("number").alias("seq"), "x")
    path = f"{jobs.shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    rows.withColumn("lot", F.pmod(F.xxhash64("seq"), F.lit(4))).repartition(4, "lot").drop("lot").write.parquet(path)
    out = jobs.in_order(jobs.finish(jobs.reorder(jobs.read(spark, path, 1), SLOTS, late=True), "reorder"))
    return out.select("stream", "seq", F.round("x", 6).alias("x"), "place")


@query(f"""with p as (select ssrc as stream, text, row_number() over (partition by ssrc order by seq) as k, count(*) over (partition by ssrc) as n from ({PACKETS})),
  w as (select stream, string_agg(text, '' order by k) as text from p group by stream)
  select 'opus' as codec, stream, (k + 1)::int as k, 3840 + 960 * k as granule, true as good, md5(text) as digest from p
  union all select 'opus', stream, j::int, case when j < 2 then 0 else 3840 + 960 * n end, true, case when j = 0 then md5(unhex('{sinks.OPUS_HEAD.hex()}')) when j = 1 then md5(unhex('{sinks.OPUS_TAGS.hex()}')) else md5('') end
    from (select stream, n, unnest([0, 1, n + 2]) as j from p where k = 1)
  union all select 'pcm', stream, 0, octet_length(encode(text)), true, md5(text) from w
  union all select 'aac', stream, 0, octet_length(encode(text)), true, md5(text) from w""")
def stream_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that come in three batches, through the writers of three codecs, and their files read back."""
    rows = views.packets(spark, sf_dir).select(F.col("ssrc").alias("stream"), "seq", "b")
    base = f"{jobs.shared_folder(spark)}/sinks-{uuid.uuid4().hex}"
    lot = F.when(F.col("seq") < 2, 0).when(F.col("seq") <= 4, 1).otherwise(2)
    files = jobs.in_lots(rows, lot, lambda stream: {codec: sinks.write_streams(stream, codec, f"{base}/{codec}") for codec in ("opus", "pcm", "aac")})
    opus = ogg_packets(files["opus"].withColumnRenamed("stream", "id")).select(F.lit("opus").alias("codec"), F.col("id").alias("stream"), "k", "granule", "good", F.md5("payload").alias("digest"))
    wav = files["pcm"].withColumn("w", wav_info(F.col("b"))).withColumn("body", F.substring("b", F.lit(45), F.octet_length("b")))
    wav = wav.select(F.lit("pcm").alias("codec"), "stream", F.lit(0).alias("k"), F.col("w.data_size").alias("granule"), (F.col("w.rate") == 24000).alias("good"), F.md5("body").alias("digest"))
    plain = files["aac"].select(F.lit("aac").alias("codec"), "stream", F.lit(0).alias("k"), F.octet_length("b").cast("long").alias("granule"), F.lit(True).alias("good"), F.md5("b").alias("digest"))
    return opus.union(wav).union(plain)


#: The first packet's time is some time after that of a watermark that hasn't moved yet.
LOTS, PATIENCE, START, FAR = 4, 8, 1_000_000, 100_000
JITTER = f"select stream, row_number() over (partition by stream order by seq) - 1 as seq, x from ({SERIES})"


@query(f"""with h as (select * from ({JITTER}) where seq % 10 <> 3 and seq % 17 <> 5)
  select stream, seq, round(x, 6) as x, row_number() over (partition by stream order by seq) - 1 as place, seq - coalesce(lag(seq) over (partition by stream order by seq), -1) - 1 as missing from h""")
def stream_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets a second apart, of which every tenth is lost and others come when their time is long past, given out in order and in time.

    Two packets of a stream of their own, far later, let the watermark pass all the others.
    """
    rows = jobs.numbered(views.series(spark, sf_dir).select("stream", "seq", "x"), "number").select("stream", F.col("number").alias("seq"), F.timestamp_seconds(F.col("number") + START).alias("t"), "x").where("seq % 10 <> 3")
    size = rows.agg(F.max("seq")).first()[0] or 0
    late = F.col("seq") % 17 == 5
    marks = spark.range(2).select(F.lit(-1).cast("long").alias("stream"), F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") + START + size + FAR).alias("t"), F.lit(0.0).alias("x"))
    lot = F.when(F.col("stream") < 0, LOTS + F.col("seq")).when(late, LOTS + 2).otherwise(F.least(F.floor(F.col("seq") * LOTS / (size + 1)), F.lit(LOTS - 1)))
    out = jobs.in_lots(rows.union(marks), lot, jobs.appended(lambda stream: jobs.jitter(stream, PATIENCE), spark, "jitter"))
    return out.where("stream >= 0").select("stream", "seq", F.round("x", 6).alias("x"), "place", "missing")


@query(speech_plans._agc_sql())
def stream_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gain of streams that come in lots, as that of whole streams."""
    rows = views.series(spark, sf_dir).select("stream", "seq", "x")
    last = rows.agg(F.max("seq")).first()[0] or 1
    lot = F.least(F.floor(F.col("seq") * LOTS / (last + 1)), F.lit(LOTS - 1))
    y = jobs.in_lots(rows, lot, jobs.appended(lambda stream: carried.gain(stream, speech_plans.RATE), spark, "gain"))
    return y.groupBy("stream").agg(F.round(F.sum(F.col("y") * F.col("y")), 6).alias("energy"), F.round(F.max_by("y", "seq"), 6).alias("last"))


@query(speech_plans.ORACLE["vad_hangover"])
def stream_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech in streams whose frames come in lots, as in whole streams."""
    rows = speech_plans._levels(spark, sf_dir).select("stream", F.col("frame").alias("seq"), "energies")
    found = jobs.in_lots(rows, F.floor(F.col("seq") % 50 * LOTS / 50), jobs.appended(carried.speech, spark, "speech"))
    return found.groupBy("stream").agg(F.sum(F.col("speech").cast("long")).alias("speech"), F.sum((F.col("probability") > 0.4).cast("long")).alias("above"))
