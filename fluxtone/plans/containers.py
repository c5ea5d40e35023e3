"""Queries over container files, header fields and the codec registry."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxtone.functions import headers, tables, vorbis
from fluxtone.functions.bits import le, to_be, u8
from fluxtone.operators import containers
from fluxtone.operators.registry import CODECS, codec_table
from fluxtone.plans import views
from fluxtone.plans.oracle import PACKETS, array
from fluxtone.sources import files, ogg
from fluxtone.streaming.jobs import shared_folder

QUERIES, ORACLE = {}, {}
SIZES = "select doc_id as id, octet_length(encode(text)) as size, hex(encode(text)) as h, md5(text) as digest from documents"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _events(spark, sf_dir) -> DataFrame:
    return views.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("u"))


@query(f"select id, size + 44 as bytes, 1::bigint as format, 2::bigint as channels, 16000::bigint as rate, 16::bigint as bits, size as data_size from ({SIZES})")
def wav_header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.payload(spark, sf_dir).select("id", containers.wav_file(F.col("b"), 16000, 2).alias("f"))
    return rows.select("id", F.octet_length("f").cast("long").alias("bytes"), headers.wav_info(F.col("f")).alias("w")).select("id", "bytes", "w.*")


@query(f"select id, k::int as k, 640 as bytes, md5(unhex(substr(h, k * 1280 + 1, 1280))) as digest from ({SIZES}) cross join lateral (select unnest(range(size // 640)) as k)")
def wav_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of WAV files; in some, other chunks of odd and even sizes stand between the format and the samples."""
    whole = containers.wav_file(F.col("b"), 16000)
    other = F.lit(b"LIST\x03\x00\x00\x00abc\x00fact\x04\x00\x00\x00data")
    longer = F.concat(F.substring(whole, 1, 36), other, F.substring(whole, F.lit(37), F.octet_length(whole)))
    files = views.payload(spark, sf_dir).select("id", F.when(F.col("id") % 3 == 0, longer).otherwise(whole).alias("b"))
    return containers.wav_frames(files).select("id", "k", F.octet_length("payload").alias("bytes"), F.md5("payload").alias("digest"))


@query(f"select id, k::int as k, md5(unhex(substr(h, k * 640 + 1, 640))) as digest from ({SIZES}) cross join lateral (select unnest(range(size // 320)) as k)")
def raw_pcm_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.pcm_frames(views.payload(spark, sf_dir)).select("id", "k", F.md5("payload").alias("digest"))


@query(f"select id, (size // 255 + 1) as segments, size % 255 as last, (size // 255 + 1 + 254) // 255 as pages from ({SIZES})")
def ogg_lacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.payload(spark, sf_dir).select("id", containers.lacing(F.octet_length("b")).alias("t"))
    n = F.octet_length("t").cast("long")
    return rows.select("id", n.alias("segments"), u8(F.col("t"), F.octet_length("t") - 1).alias("last"), F.expr("cast(octet_length(t) + 254 as long) div 255").alias("pages"))


@query(f"select id // 50 as stream, row_number() over (partition by id // 50 order by id)::int - 1 as k, 960 * row_number() over (partition by id // 50 order by id) as granule, true as good, digest from ({SIZES})")
def ogg_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as packets of streams of fifty: pages with checksums, files, and packets again."""
    rows = views.payload(spark, sf_dir).select(F.expr("id div 50").alias("stream"), F.col("id").alias("seq"), "b")
    pages = containers.ogg_pages(rows).select(F.col("stream").alias("id"), F.col("number").alias("k"), F.col("page").alias("payload"))
    out = containers.ogg_packets(containers.join_chunks(pages))
    return out.select(F.col("id").alias("stream"), "k", "granule", "good", F.md5("payload").alias("digest"))


@query(f"select id, sample::bigint as sample, size, chunk::bigint as chunk, (1000 + 100000 * chunk + coalesce(sum(size) over (partition by id, chunk order by sample rows between unbounded preceding and 1 preceding), 0))::bigint as offset from (select *, case when sample < 9 then sample // 3 + 1 else 4 + (sample - 9) // 5 end as chunk from (select id // 40 as id, size, row_number() over (partition by id // 40 order by id) - 1 as sample from ({SIZES})))")
def mp4_sample_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of forty documents: three samples a chunk in the first three chunks, then five."""
    from pyspark.sql import Window

    rows = views.payload(spark, sf_dir).select(F.expr("id div 40").alias("t"), F.col("id").alias("d"), F.octet_length("b").cast("long").alias("size"))
    sizes = rows.select(F.col("t").alias("id"), (F.row_number().over(Window.partitionBy("t").orderBy("d")) - 1).cast("long").alias("sample"), "size")
    tracks = sizes.groupBy("id").agg(F.count("*").alias("n"))
    runs = tracks.select("id", F.explode(F.array(F.struct(F.lit(1).cast("long").alias("first"), F.lit(3).cast("long").alias("per")), F.struct(F.lit(4).cast("long").alias("first"), F.lit(5).cast("long").alias("per")))).alias("r")).select("id", "r.*")
    chunks = tracks.select("id", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(3), 3 + F.ceil((F.col("n") - 9) / 5)).cast("long"))).alias("chunk")).withColumn("offset", 1000 + 100000 * F.col("chunk"))
    return containers.sample_offsets(sizes, runs, chunks).select("id", "sample", "size", "chunk", "offset")


@query("select conv_id as id, (row_number() over (partition by conv_id order by turn) - 1)::int as sample, octet_length(encode(text)) as size, md5(text) as digest from conversations")
def mp4_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of each conversation, its boxes walked and its samples read through the sample tables."""
    lists = views.packets(spark, sf_dir).groupBy(F.col("ssrc").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "b"))), lambda s: s["b"]).alias("l"))
    files = lists.select("id", containers.mp4_file(F.col("l")).alias("b"))
    return containers.mp4_samples(files).select("id", "sample", "size", F.md5("payload").alias("digest"))


@query(f"""select event_id as id, 4 as mpeg, true as no_crc, 2::bigint as profile, event_id % 13 as rate_index, {array(headers.AAC_RATES)}[(event_id % 13)::int + 1] as rate, user_id % 7 + 1 as channels, event_id % 8000 + 7 as frame_length from events""")
def adts_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = headers.adts_header(F.col("id") % 13, F.col("u") % 7 + 1, F.col("id") % 8000)
    return _events(spark, sf_dir).select("id", headers.adts(b).alias("h")).select("id", "h.*")


@query(f"""with e as (select event_id as id, (event_id % 3)::int as v, (event_id % 14 + 1)::int as b, (user_id % 3)::int as r, (event_id // 7 % 2)::bigint as pad, user_id % 4 as mode from events),
  f as (select *, case when v = 0 then 3 when v = 1 then 2 else 0 end::bigint as version, case when v = 0 then {array(headers.MP3_BITRATES[1])}[b + 1] else {array(headers.MP3_BITRATES[2])}[b + 1] end * 1000 as bitrate,
    case when v = 0 then {array(headers.MP3_RATES["3"])}[r + 1] when v = 1 then {array(headers.MP3_RATES["2"])}[r + 1] else {array(headers.MP3_RATES["0"])}[r + 1] end as rate from e)
  select id, version, 3::bigint as layer, bitrate, rate, mode, case when v = 0 then 1152 else 576 end as samples, ((case when v = 0 then 144 else 72 end * bitrate) // rate + pad)::bigint as frame_size from f""")
def mp3_header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.when(F.col("id") % 3 == 0, 3).when(F.col("id") % 3 == 1, 2).otherwise(0)
    word = F.lit(0x7FF << 21).cast("long") + version * (1 << 19) + F.lit((1 << 17) + (1 << 16)) + (F.col("id") % 14 + 1) * (1 << 12) + (F.col("u") % 3) * (1 << 10) + F.expr("id div 7 % 2") * (1 << 9) + (F.col("u") % 4) * (1 << 6)
    return _events(spark, sf_dir).select("id", headers.mp3(headers.to_be(word, 4)).alias("h")).select("id", "h.*")


@query("""select conv_id as id, turn as t, i::int as at from (select conv_id, turn, unnest([4, octet_length(encode(text)) + 8]) as i from conversations)""")
def mp3_sync_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where sync words are in bytes with two of them among text."""
    mark = F.lit(bytes([0xFF, 0xFB, 0x90, 0x00]))
    rows = views.packets(spark, sf_dir).select(F.col("ssrc").alias("id"), F.col("seq").alias("t"), F.concat(F.lit(b"\x01\x02\x03\x04"), mark, "b", mark).alias("b"))
    return rows.select("id", "t", F.explode(headers.sync_places(F.col("b"))).alias("at"))


@query(f"""with e as (select event_id as id, event_id % 4 + 1 as object_type, case when event_id % 5 = 4 then 11502 else {array(headers.AAC_RATES)}[(user_id % 13)::int + 1] end as rate, event_id % 7 + 1 as channels, user_id % 13 as r, event_id % 5 = 4 as own from events)
  select id, case when own then 5 else 2 end as bytes, object_type, case when own then 15 else r end as rate_index, rate::bigint as rate, channels, false as short_frames from e""")
def asc_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.when(F.col("id") % 5 == 4, 11502).otherwise(F.get(F.array(*[F.lit(r) for r in headers.AAC_RATES]), (F.col("u") % 13).cast("int")))
    rows = _events(spark, sf_dir).select("id", headers.write_audio_config(F.col("id") % 4 + 1, rate, F.col("id") % 7 + 1).alias("b"))
    c = rows.select("id", F.octet_length("b").alias("bytes"), headers.audio_config(F.col("b")).alias("c"))
    return c.select("id", "bytes", "c.object_type", "c.rate_index", "c.rate", "c.channels", "c.short_frames")


@query(f"""select id, 4096::bigint as min_block, 4096::bigint as max_block, 44100::bigint as rate, id % 8 + 1 as channels, 16::bigint as bits, 5000000000 + size as samples, digest as md5 from ({SIZES})""")
def flac_info_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.payload(spark, sf_dir)
    info = headers.write_flac_info(F.lit(4096), F.lit(44100), F.col("id") % 8 + 1, F.lit(16), F.lit(5000000000) + F.octet_length("b"), F.md5("b"))
    return rows.select("id", headers.flac_info(info).alias("i")).select("id", "i.min_block", "i.max_block", "i.rate", "i.channels", "i.bits", "i.samples", "i.md5")


@query("""select event_id as id, 0::bigint as version, event_id % 8 + 1 as channels, 8000 + user_id as rate, 256::bigint as block_0, 2048::bigint as block_1 from events""")
def vorbis_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    return rows.select("id", headers.vorbis_info(headers.write_vorbis_info(F.col("id") % 8 + 1, F.col("u") + 8000)).alias("v")).select("id", "v.*")


@query("select event_id as id, case event_id % 10 when 0 then 120 when 1 then 120 when 2 then 120 when 3 then 240 when 4 then 240 when 5 then 480 when 6 then 480 else 960 end as samples from events")
def opus_frame_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("id", headers.opus_frame_size(F.col("id") % 10).alias("samples"))


@query("""select event_id as id, case event_id % 7 when 0 then 'wav' when 1 then 'ogg' when 2 then 'mp4' when 3 then 'flac' when 4 then 'ogg' when 5 then 'mp4' else 'pcm' end as kind,
  case event_id % 4 when 0 then 'ogg' when 1 then 'wav' when 2 then 'wav' else 'mp3' end as sink from events""")
def container_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By first bytes, by name, and the writer for a codec's name."""
    bytes_ = F.get(F.array(*[F.lit(v) for v in (b"RIFF....WAVE", b"OggS0000", b"0000ftypM4A ", b"fLaC0000", b"RIFF", b"x", b"none")]), (F.col("id") % 7).cast("int"))
    name = F.get(F.array(*[F.lit(v) for v in ("a", "b.bin", "c", "d", "e.OPUS", "f.m4a", "g.raw")]), (F.col("id") % 7).cast("int"))
    codec = F.get(F.array(*[F.lit(v) for v in ("OPUS", "wav", "PCM", "aac")]), (F.col("id") % 4).cast("int"))
    return _events(spark, sf_dir).select("id", headers.sniff(bytes_, name).alias("kind"), headers.sink_kind(codec).alias("sink"))


@query(f"""select id, case id % 4 when 0 then 'hisilicon' when 1 then case when (size + 2) // 2 % 256 = 1 then 'hisilicon' else 'dahua' end when 2 then 'uniview' end as chip,
  case when id % 4 = 1 and (size + 2) // 2 % 256 = 1 then size + 2 else size end as bytes from ({SIZES})""")
def chip_header_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of three vendors put on and taken off; one vendor's length can look like another's mark."""
    b = F.col("b")
    made = F.when(F.col("id") % 4 == 0, headers.chip_add(b, "hisilicon")).when(F.col("id") % 4 == 1, headers.chip_add(b, "dahua")).when(F.col("id") % 4 == 2, headers.chip_add(b, "uniview")).otherwise(b)
    rows = views.payload(spark, sf_dir).select("id", headers.chip_trim(made).alias("t"))
    return rows.select("id", "t.chip", F.octet_length("t.payload").cast("long").alias("bytes"))


@query("select event_id as id, n.name from events join (values " + ", ".join(f"({k}, '{v}')" for k, v in CODECS.items()) + ") n(codec_id, name) on n.codec_id = event_id % 30")
def codec_registry_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a codec id; ids that no codec has fall away."""
    rows = _events(spark, sf_dir).select("id", (F.col("id") % 30).cast("int").alias("codec_id"))
    return rows.join(F.broadcast(codec_table(spark)), "codec_id").select("id", "name")


@query(f"""select id, size + case id % 5 when 1 then 6 else 4 end as bytes, md5(unhex(case id % 5 when 1 then '00010100' || format('{{:02X}}{{:02X}}', size % 256, size // 256 % 256) when 2 then '24010000'
  else '0001' || format('{{:02X}}', size // 2 % 256) || '00' end || h)) as digest from ({SIZES})""")
def chip_header_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers by a column of vendors, with unknown and missing ones among them, before whole payloads."""
    chip = F.get(F.array(F.lit("hisilicon"), F.lit("dahua"), F.lit("uniview"), F.lit("unknown"), F.lit(None)), (F.col("id") % 5).cast("int"))
    rows = views.payload(spark, sf_dir).select("id", headers.chip_add(F.col("b"), chip).alias("b"))
    return rows.select("id", F.octet_length("b").cast("long").alias("bytes"), F.md5("b").alias("digest"))


#: CRC-32 of one byte in each state of its low eight bits, by the rule of the polynomial.
def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return table


def _crc_sql(bytes_list: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bytes_list}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"


@query(f"""with p as (select conv_id as id, turn as t, encode(text) as b, octet_length(encode(text)) as n, row_number() over (partition by conv_id order by turn) as k, count(*) over (partition by conv_id) as m from conversations),
  h as (select id, t, '4F67675300' || format('{{:02X}}', case when k = 1 then 2 else 0 end + case when k = m then 4 else 0 end) || le8(960 * k) || le4(id) || le4(k - 1) || '00000000' || format('{{:02X}}', n // 255 + 1) || repeat('FF', (n // 255)::int) || format('{{:02X}}', n % 255) || hex(b) as h from p),
  l as (select id, t, len(h) // 2 as bytes, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::int, 2))::bigint) as b, {array(_crc_table())}::bigint[] as crc from h)
  select id, t, bytes, {_crc_sql("b")} as crc from l""".replace("le8(960 * k)", "array_to_string(list_transform(range(8), lambda j: format('{:02X}', (960 * k) >> (8 * j)::int & 255)), '')").replace("le4(id)", "array_to_string(list_transform(range(4), lambda j: format('{:02X}', id >> (8 * j)::int & 255)), '')").replace("le4(k - 1)", "array_to_string(list_transform(range(4), lambda j: format('{:02X}', (k - 1) >> (8 * j)::int & 255)), '')"))
def ogg_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checksum in each page of conversations as streams, a page for each turn."""
    pages = containers.ogg_pages(views.packets(spark, sf_dir).select(F.col("ssrc").alias("stream"), "seq", "b"))
    return pages.select(F.col("stream").alias("id"), F.col("seq").alias("t"), F.octet_length("page").cast("long").alias("bytes"), le(F.col("page"), 22, 4).alias("crc"))


@query(f"""with e as (select event_id as id, case event_id % 3 when 0 then 0 when 1 then 5 else 29 end as kind, {array(headers.AAC_RATES)}[(user_id % 13)::int + 1] as r, event_id % 2 = 0 as ps, event_id % 5 = 4 as own from events)
  select id, case when kind = 0 then null else kind end::bigint as extension, case when kind = 5 then true end as sbr, case when kind = 5 then case when own then 11502 else r end end::bigint as rate, case when kind > 0 then ps end as ps from e""")
def asc_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations with no extension, with band replication at rates with and without an index, and with parametric stereo alone."""
    kind = F.get(F.array(F.lit(0), F.lit(5), F.lit(29)), (F.col("id") % 3).cast("int"))
    rate = F.when(F.col("id") % 5 == 4, 11502).otherwise(F.get(F.array(*[F.lit(r) for r in headers.AAC_RATES]), (F.col("u") % 13).cast("int")))
    b = headers.write_extended_config(F.lit(2), rate, F.col("id") % 7 + 1, kind, rate, F.col("id") % 2 == 0)
    return _events(spark, sf_dir).select("id", headers.config_extension(b).alias("c")).select("id", "c.*")


@query("""select id, format('{:02X}{:02X}', 16 + r // 2, (r % 2) * 128 + ch * 8) as config, true as back from (select event_id as id, (event_id % 13)::int as r, (user_id % 7 + 1)::int as ch from events)""")
def adts_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configuration of each header, and the header again from that."""
    rows = _events(spark, sf_dir).select("id", headers.adts_header(F.col("id") % 13, F.col("u") % 7 + 1, F.col("id") % 8000).alias("b"), (F.col("id") % 8000).alias("size"))
    rows = rows.withColumn("c", headers.config_from_adts(F.col("b")))
    return rows.select("id", F.hex("c").alias("config"), (headers.adts_from_config(F.col("c"), F.col("size")) == F.col("b")).alias("back"))


@query("""select id, 'Überbau ' || id as vendor, case when id % 3 > 0 then 'TITLE=' || u end as first, id % 3 as comments, true as whole, true as cut_is_null from (select event_id as id, user_id as u from events)""")
def vorbis_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second headers of none to two comments, read back, and refused when they are cut short."""
    texts = F.slice(F.array(F.concat(F.lit("TITLE="), F.col("u").cast("string")), F.lit("ARTIST=é")), F.lit(1), (F.col("id") % 3).cast("int"))
    b = headers.write_vorbis_comments(F.concat(F.lit("Überbau "), F.col("id").cast("string")), texts)
    rows = _events(spark, sf_dir).select("id", b.alias("b")).withColumn("c", headers.vorbis_comments(F.col("b")))
    cut = headers.vorbis_comments(F.substring("b", F.lit(1), F.octet_length("b") - 1))
    return rows.select("id", "c.vendor", F.get("c.comments", F.lit(0)).alias("first"), F.size("c.comments").cast("long").alias("comments"), (F.col("c.size") == F.octet_length("b")).alias("whole"), cut.isNull().alias("cut_is_null"))


@query(f"""select id, k, kind, last, start, bytes from (select id, size, id % 50 as pad from ({SIZES})) cross join lateral (values (0, 0, false, 8::bigint, 34::bigint), (1, 4, false, 46, size), (2, 1, true, 50 + size, pad)) t(k, kind, last, start, bytes)""")
def flac_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a file with stream information, a comment, and padding; what follows the last one is sound."""
    return containers.flac_blocks(_flac_files(spark, sf_dir)).select("id", "k", "kind", "last", "start", F.col("size").alias("bytes"))


def _flac_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = lambda kind, b: F.concat(F.lit(bytes([kind])), to_be(F.octet_length(b).cast("long"), 3), b)
    padding = F.unhex(F.repeat(F.lit("00"), (F.col("id") % 50).cast("int")))
    whole = F.concat(F.lit(b"fLaC"), block(0, F.lit(bytes(34))), block(4, F.col("b")), block(0x81, padding), F.lit(b"\xff\xf8sound"))
    return views.payload(spark, sf_dir).select("id", whole.alias("b"))


@query(f"select ssrc as stream, row_number() over (partition by ssrc order by seq) - 1 as k, true as whole, md5(text) as digest from ({PACKETS})")
def ogg_split_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of many streams, written to a few files page by page, and read again in splits of 20,000 bytes."""
    rows = views.packets(spark, sf_dir).select(F.col("ssrc").alias("stream"), "seq", "b")
    pages = containers.ogg_pages(rows).select((F.col("stream") % 5).alias("id"), F.struct("number", "stream").alias("k"), F.col("page").alias("payload"))
    folder = f"{shared_folder(spark)}/ogg-{uuid.uuid4().hex}"
    files.write_files(containers.join_chunks(pages).select(F.concat(F.col("id").cast("string"), F.lit(".ogg")).alias("name"), "b"), folder)
    found = ogg.packets(ogg.read_pieces(spark, folder, 20_000))
    return found.select("stream", "k", "whole", F.md5("payload").alias("digest"))


@query(ORACLE["flac_metadata"])
def sql_flac_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of ``flac_metadata``'s files, by a table function in SQL."""
    tables.register(spark)
    return spark.sql("select f.id, t.k, t.kind, t.last, t.start, t.size as bytes from {files} f, lateral flac_blocks(f.b) t", files=_flac_files(spark, sf_dir))


@query(f"""select ssrc as stream, count(*) as packets, sum(octet_length(encode(text)))::bigint as bytes, sum(octet_length(encode(text)) // 255 + 1)::bigint as segments from ({PACKETS}) group by ssrc""")
def sql_ogg_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of packets through a table function in SQL, counted by stream."""
    tables.register(spark)
    pages = containers.ogg_pages(views.packets(spark, sf_dir).select(F.col("ssrc").alias("stream"), "seq", "b"))
    return spark.sql("""select t.stream, count_if(t.begins) as packets, cast(sum(octet_length(t.payload)) as bigint) as bytes,
      cast(sum(octet_length(t.payload) div 255 + if(t.ends, 1, 0)) as bigint) as segments from {pages} p, lateral ogg_parts(p.page) t group by t.stream""", pages=pages)


@query("""with e as (select event_id as id, (event_id % 5 + 1)::int as b, (user_id % 7 + 2)::int as n from events),
  l as (select id, b, n, unnest(range(b)) as k from e)
  select id, 'codebook' as part, k::int as k, 0 as kind, (n + k)::int as n, (k + 1)::int as size, list_sum(list_transform(range(n + k), lambda i: case when i % 3 = 2 then 0 else i % 32 + 1 end))::bigint as total from l
  union all select id, 'floor', 0, 1, 1, n - 1, (n * (n - 1) / 2 * 10)::bigint from e
  union all select id, 'residue', 0, b % 3, n, b * 16, 1024 from e
  union all select id, 'mapping', 0, 0, 1, 0, 0 from e
  union all select id, 'mode', k::int, (k % 2)::int, 0, 0, 0 from l""")
def vorbis_setup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third headers of one to five codebooks and as many modes, written and read back; every one cut short by a byte gives nothing."""
    books, n = (F.col("id") % 5 + 1).cast("int"), (F.col("u") % 7 + 2).cast("int")
    numbers = lambda count: F.sequence(F.lit(0), count - 1)
    lengths = lambda k: F.transform(numbers(n + k), lambda i: F.when(i % 3 == 2, 0).otherwise(i % 32 + 1))
    # few bytes an event and much work: as many tasks as a shuffle has, however few the files
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _events(spark, sf_dir).repartition(tasks, "id").select(
        "id", (F.col("u") % 2 + 1).alias("channels"),
        vorbis.setup(
            F.transform(numbers(books), lambda k: vorbis.codebook(k + 1, lengths(k))),
            F.array(vorbis.floor_of(F.transform(F.sequence(F.lit(1), n - 1), lambda i: i * 10))),
            F.array(vorbis.residue(books % 3, books * 16, n)),
            F.transform(numbers(books), lambda k: k % 2 == 1),
        ).alias("setup"),
    )
    tables.register(spark)
    # a header is written once, for itself and for what is left of it when cut
    cut = F.struct((-F.col("id") - 1).alias("id"), F.substring("b", F.lit(1), F.octet_length("b") - 1).alias("b"))
    headers = containers.setup_headers(rows).select("channels", F.inline(F.array(F.struct("id", "b"), cut)))
    return spark.sql("select h.id, t.* from {headers} h, lateral vorbis_setup(h.b, h.channels) t", headers=headers)
