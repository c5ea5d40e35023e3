"""Queries over packets, messages and transport text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxtone.functions.bits import joined, to_be
from fluxtone.operators import packets
from fluxtone.plans import views
from fluxtone.plans.oracle import LOSSY, PACKETS

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


PIECES = "select id, k::int as k, n::int as pieces, k = n - 1 as marker, least(1388, size - k * 1388)::int as bytes from (select doc_id as id, octet_length(encode(text)) as size, greatest(ceil(octet_length(encode(text)) / 1388.0), 1)::int as n from documents) cross join lateral (select unnest(range(n)) as k)"


@query(PIECES)
def rtp_packetize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packets.packetize(views.payload(spark, sf_dir))
    return out.select("id", "k", "pieces", "marker", F.octet_length("payload").alias("bytes"))


@query(f"""select id, k, (rank - 1 + 65500) % 65536 as seq, (ends * 160) % 4294967296 as timestamp from (
  select id, k, row_number() over (partition by id // 100 order by id, k) as rank, coalesce(sum(marker::int) over (partition by id // 100 order by id, k rows between unbounded preceding and 1 preceding), 0)::bigint as ends from ({PIECES}))""")
def rtp_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Senders of a hundred documents each; numbers wrap."""
    pieces = packets.packetize(views.payload(spark, sf_dir)).withColumn("sender", F.expr("id div 100"))
    out = packets.session(pieces.drop("payload"), "sender", ["id", "k"], start=65500)
    return out.select("id", "k", F.col("seq").cast("long").alias("seq"), "timestamp")


@query("""select conv_id as id, turn as t, 2::bigint as version, role = 'assistant' as marker, 8::bigint as payload_type, (turn * 7 + 65530) % 65536 as seq, (turn * 160)::bigint as timestamp, conv_id as ssrc,
  conv_id % 3 as sources, octet_length(encode(text)) as bytes, md5(text) as digest from conversations""")
def rtp_header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets with none to two contributing sources, written and read back."""
    rows = views.packets(spark, sf_dir)
    csrc = F.slice(F.array(F.lit(7).cast("long"), F.lit(0x22222222).cast("long")), 1, (F.col("ssrc") % 3).cast("int"))
    raw = packets.rtp_serialize(F.col("marker"), F.lit(8), (F.col("seq") * 7 + 65530) % 65536, F.col("seq") * 160, F.col("ssrc"), F.col("b"), csrc)
    p = rows.select(F.col("ssrc").alias("id"), F.col("seq").alias("t"), packets.rtp_parse(raw).alias("p"))
    return p.select("id", "t", "p.version", "p.marker", "p.payload_type", "p.seq", "p.timestamp", "p.ssrc", F.size("p.csrc").cast("long").alias("sources"), F.octet_length("p.payload").cast("long").alias("bytes"), F.md5("p.payload").alias("digest"))


@query(f"""with f as (select *, coalesce(sum(marker::int) over (partition by ssrc order by seq rows between unbounded preceding and 1 preceding), 0) as frame from ({PACKETS}))
  select ssrc, frame::bigint as frame, min(seq) as first, max(seq) as last, count(*)::int as packets, string_agg(text, '' order by seq) as text from f group by ssrc, frame having bool_or(marker)""")
def rtp_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packets.reassemble(views.packets(spark, sf_dir))
    return out.select("ssrc", F.col("frame").cast("long").alias("frame"), "first", "last", "packets", F.decode("b", "utf-8").alias("text"))


@query(f"""with o as (select stream, seq, count(*) as copies from ({LOSSY}) group by all), g as (select *, coalesce(seq - lag(seq) over (partition by stream order by seq) - 1, 0) as gap from o)
  select stream, count(*) as received, sum(gap)::bigint as lost, sum(copies - 1)::bigint as repeated, round(sum(gap) / (count(*) + sum(gap)), 6) as rate from g group by stream""")
def rtp_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.loss(views.lossy(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@query(f"""with o as (select stream, seq, any_value(x) as x from ({LOSSY}) group by all), g as (select stream, unnest(range(min(seq), max(seq) + 1)) as seq from o group by stream)
  select g.stream, g.seq, round(last_value(o.x ignore nulls) over (partition by g.stream order by g.seq), 6) as x, o.x is null as lost from g left join o on g.stream = o.stream and g.seq = o.seq""")
def jitter_gapfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.fill_gaps(views.lossy(spark, sf_dir)).withColumn("x", F.round("x", 6))


@query(f"select stream, seq, (65000 + seq * 10) as long_seq from (select distinct stream, seq from ({LOSSY}))")
def rtp_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16-bit numbers that wrap, made one rising count by order of arrival."""
    rows = views.lossy(spark, sf_dir).select("stream", "seq").distinct().withColumn("short", (65000 + F.col("seq") * 10) % 65536)
    return packets.unwrap(rows, "stream", "seq", "short").select("stream", "seq", "long_seq")


@query("""select conv_id as id, turn as t, 6::bigint as codec, turn % 65536 as seq, octet_length(encode(text)) as bytes, md5(text) as digest, true as short_is_null from conversations""")
def ws_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages written, read back, and refused when they are cut short."""
    raw = packets.frame_message(F.lit(6), F.col("seq"), F.col("b"))
    rows = views.packets(spark, sf_dir).select("ssrc", "seq", raw.alias("raw")).withColumn("p", packets.parse_message(F.col("raw")))
    cut = packets.parse_message(F.substring("raw", F.lit(1), F.octet_length("raw") - 1))
    return rows.select(F.col("ssrc").alias("id"), F.col("seq").alias("t"), "p.codec", "p.seq", F.octet_length("p.payload").cast("long").alias("bytes"), F.md5("p.payload").alias("digest"), cut.isNull().alias("short_is_null"))


# Codec ids by the names that session descriptions use; all other names are passed through as 91.
NAMES = {"PCMA": 6, "PCMU": 7, "L16": 18, "L8": 18, "MPA": 17, "MPEG": 17, "MP4A-LATM": 19, "MPEG4-GENERIC": 19}
KINDS = ("PCMA/8000/1", "pcmu/8000", "L16/44100/2", "OPUS/48000/2", "MPEG4-GENERIC/22050/1", "G722/x")


@query(f"""with k as (select event_id as id, {list(KINDS)!r}[(event_id % 6)::int + 1] as spec from events), p as (select id, string_split(spec, '/') as p from k)
  select id, upper(p[1]) as name, coalesce(try_cast(p[2] as int), 8000) as rate, coalesce(try_cast(p[3] as int), 1) as channels,
    case upper(p[1]) {" ".join(f"when '{k}' then {v}" for k, v in NAMES.items())} else 91 end as codec from p""")
def sdp_rtpmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session description for each event; the audio line names the second of two maps."""
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), (F.col("event_id") % 6).cast("int"))
    text = F.concat(F.lit("v=0\r\na=rtpmap:96 H264/90000\r\nm=audio 0 RTP/AVP 97\r\na=rtpmap:97 "), kind, F.lit("\r\na=x\r\n"))
    rows = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), packets.parse_sdp(text).alias("s")).select("id", "s.*")
    codec = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), F.col("name")), F.lit(91))
    return rows.withColumn("codec", codec)


@query("""select event_id as id, case when event_id % 4 = 0 then 404 else 200 end as status, case when event_id % 4 = 0 then 'Not Found' else 'OK' end as reason,
  event_id::varchar as cseq, 's' || (user_id::varchar) as session, props as body from events""")
def rtsp_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.col("event_id") % 4 == 0
    text = F.concat(F.lit("RTSP/1.0 "), F.when(bad, "404 Not Found").otherwise("200 OK"), F.lit("\r\nCSeq: "), F.col("event_id").cast("string"), F.lit("\r\nSESSION:s"), F.col("user_id").cast("string"), F.lit("\r\n\r\n"), F.col("props"))
    rows = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), packets.parse_response(text).alias("r"))
    return rows.select("id", "r.status", "r.reason", F.col("r.headers")["cseq"].alias("cseq"), F.col("r.headers")["session"].alias("session"), "r.body")


@query("""select conv_id as id, (row_number() over (partition by conv_id order by turn) - 1)::int as k, (turn % 4)::int as channel, md5(text) as digest from conversations""")
def interleaved_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as one capture of '$' frames with noise before it, split again."""
    framed = F.concat(F.lit(b"\x24"), to_be(F.col("seq") % 4, 1), to_be(F.octet_length("b").cast("long"), 2), F.col("b"))
    rows = views.packets(spark, sf_dir).select("ssrc", "seq", framed.alias("f"))
    whole = rows.groupBy(F.col("ssrc").alias("id")).agg(F.array_sort(F.collect_list(F.struct("seq", "f"))).alias("l"))
    capture = whole.select("id", F.concat(F.lit(b"xx"), joined(F.col("l.f"))).alias("b"))
    return packets.split_interleaved(capture).select("id", "k", "channel", F.md5("payload").alias("digest"))
