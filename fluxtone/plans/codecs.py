"""Queries over adaptive codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxtone.functions import adaptive
from fluxtone.operators import packet_codecs
from fluxtone.operators.registry import byte_registry, default_registry, from_pcm, to_pcm
from fluxtone.plans import views
from fluxtone.plans.dsp import _alaw_decode_sql, _alaw_encode_sql, _print, _print_sql, _ulaw_decode_sql, _ulaw_encode_sql
from fluxtone.plans.oracle import PCM, array, fold

QUERIES, ORACLE = {}, {}
STEPS, IMA, G726 = array(adaptive.STEPS), array(adaptive.IMA_CHANGE), array(adaptive.G726_CHANGE)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


IMA_STEP = (
    [
        ("size", f"{STEPS}[p_ix + 1]"),
        ("diff", "s - p_value"),
        ("b4", "(abs(diff) >= size)::int"),
        ("rest", "abs(diff) - b4 * size"),
        ("b2", "(rest >= size >> 1)::int"),
        ("rest2", "rest - b2 * (size >> 1)"),
        ("b1", "(rest2 >= size >> 2)::int"),
        ("change", "(size >> 3) + b4 * size + b2 * (size >> 1) + b1 * (size >> 2)"),
        ("low", "b4 * 4 + b2 * 2 + b1"),
    ],
    {"value": "least(greatest(p_value + case when diff < 0 then -change else change end, -32768), 32767)", "ix": f"least(greatest(p_ix + {IMA}[low + 1], 0), 88)", "code": "low + case when diff < 0 then 8 else 0 end"},
)
IMA_ENCODE = fold(PCM, "v", {"value": "0::int", "ix": "0::int", "code": "0::int"}, *IMA_STEP)


@query(f"{IMA_ENCODE} select id, sum(p_code * i)::bigint as fingerprint, string_agg(lower(to_hex(p_code)), '' order by i) as packed from r where i > 0 group by id")
def adpcm_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.pcm(spark, sf_dir).select("id", adaptive.ima_encode(F.col("v")).alias("c"))
    return rows.select("id", _print("c").alias("fingerprint"), adaptive.ima_pack(F.col("c")).alias("packed"))


@query(f"""{IMA_ENCODE}, f2 as (select id, any_value(f.v) as v from f group by id)
  select r.id, sum(p_value::bigint * i)::bigint as fingerprint, max(abs(p_value - f2.v[i])) as worst from r join f2 using (id) where i > 0 group by r.id""")
def adpcm_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decoder follows the encoder's own prediction."""
    rows = views.pcm(spark, sf_dir).withColumn("back", adaptive.ima_decode(adaptive.ima_encode(F.col("v"))))
    return rows.select("id", _print("back").alias("fingerprint"), F.array_max(F.zip_with("v", "back", lambda a, b: F.abs(a - b))).alias("worst"))


def _g726(bits: int) -> str:
    half = 1 << (bits - 1)
    return fold(
        PCM,
        "v",
        {"value": "0::int", "ix": "0::int", "code": "0::int"},
        [("size", f"{STEPS}[p_ix + 1]"), ("diff", "s - p_value"), ("lev", f"least(abs(diff) // size, {half - 1})"), ("back", "(size * lev + size // 2) // 2")],
        {"value": "least(greatest(p_value + case when diff < 0 then -back else back end, -32768), 32767)", "ix": f"least(p_ix + {G726}[least(lev, 7) + 1], 88)", "code": f"case when diff < 0 then {half - 1} - lev else {half} + lev end"},
    )


@query(f"{_g726(4)} select id, sum(p_code * i)::bigint as fingerprint, arg_max(p_ix, i) as last_step from r where i > 0 group by id")
def g726_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.pcm(spark, sf_dir).select("id", adaptive.g726_encode(F.col("v"), 4).alias("c"))
    fold_back = F.transform("c", lambda c: F.least(F.when(c < 8, 7 - c).otherwise(c - 8), F.lit(7)))
    steps = F.aggregate(fold_back, F.lit(0), lambda a, k: F.least(a + F.get(F.array(*[F.lit(v) for v in adaptive.G726_CHANGE]), k), F.lit(88)))
    return rows.select("id", _print("c").alias("fingerprint"), steps.alias("last_step"))


@query(" union all ".join(f"select * from ({_g726(bits)} select {bits} as bits, id, sum(p_value::bigint * i)::bigint as fingerprint from r where i > 0 group by id)" for bits in (2, 3, 5)))
def g726_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded samples at each of the other widths, in one pass over the frames."""
    rows = views.pcm(spark, sf_dir)
    each = F.array(*[F.struct(F.lit(b).alias("bits"), adaptive.g726_decode(adaptive.g726_encode(F.col("v"), b), b).alias("back")) for b in (2, 3, 5)])
    return rows.select("id", F.explode(each).alias("s")).select("s.bits", "id", _print("s.back").alias("fingerprint"))


def _band(name: str, sample: str, bits: int) -> list[tuple[str, str]]:
    half, top = 1 << (bits - 1), (1 << bits) - 1
    return [
        (f"{name}q", f"least(greatest(round_even(({sample} - p_{name}v) / p_{name}s + {half} - 0.5::double, 0), 0), {top})::int"),
        (f"{name}m", f"case when {name}q = 0 then -p_{name}s * {half} else p_{name}s * ({name}q - {half} + 0.5::double) end"),
        (f"{name}k", f"least({name}q, {top} - {name}q)"),
        (f"{name}v2", f"least(greatest(p_{name}v + {name}m, -32768::double), 32767::double)"),
        (f"{name}s2", f"case when {name}k < 8 then greatest(1::double, p_{name}s + {IMA}[{name}k + 1]) else p_{name}s end"),
    ]


G722 = fold(
    f"select id, list_transform(range(len(v) // 2), lambda i: {{'a': v[2 * i + 1], 'b': v[2 * i + 2]}}) as v from ({PCM})",
    "v",
    {"lv": "0::double", "ls": "16::double", "hv": "0::double", "hs": "16::double", "code": "0::int"},
    [*_band("l", "trunc((s.a + s.b) / 2.0::double)", 6), *_band("h", "trunc((s.a - s.b) / 2.0::double)", 2)],
    {"lv": "lv2", "ls": "ls2", "hv": "hv2", "hs": "hs2", "code": "lq * 4 + hq"},
)


@query(f"{G722} select id, sum(p_code * i)::bigint as fingerprint from r where i > 0 group by id")
def g722_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pcm(spark, sf_dir).select("id", adaptive.g722_encode(F.col("v")).alias("c")).select("id", _print("c").alias("fingerprint"))


@query(f"""{G722} select id, sum(least(greatest(round_even(p_lv, 0) + round_even(p_hv, 0), -32768), 32767)::bigint * (2 * i - 1) + least(greatest(round_even(p_lv, 0) - round_even(p_hv, 0), -32768), 32767)::bigint * 2 * i)::bigint as fingerprint,
  (2 * count(*))::int as n from r where i > 0 group by id""")
def g722_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.pcm(spark, sf_dir).select("id", adaptive.g722_decode(adaptive.g722_encode(F.col("v"))).alias("back"))
    return rows.select("id", _print("back").alias("fingerprint"), F.size("back").alias("n"))


@query(f"""{fold(PCM, "v", {"value": "(id * 7 % 2000 - 1000)::int", "ix": "(id % 89)::int", "code": "0::int"}, *IMA_STEP)}
  select id, format('{{:02X}}{{:02X}}{{:02X}}00', ((id * 7 % 2000 - 1000 + 65536) % 65536)::int % 256, ((id * 7 % 2000 - 1000 + 65536) % 65536)::int // 256, (id % 89)::int) || string_agg(format('{{:X}}', p_code), '' order by i) as bytes,
    sum(p_value::bigint * i)::bigint as fingerprint from r where i > 0 group by id""")
def adpcm_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that go on from a state of their own, as bytes with that state before them, and read back."""
    start = ((F.col("id") * 7 % 2000 - 1000).cast("int"), (F.col("id") % 89).cast("int"))
    rows = views.pcm(spark, sf_dir).select("id", adaptive.ima_stream(F.col("v"), start).alias("b"))
    return rows.select("id", F.hex("b").alias("bytes"), _print(adaptive.ima_from_stream(F.col("b"))).alias("fingerprint"))


BIT_HEX = "array_to_string(list_transform(range(len(s) // 8), lambda j: format('{:02X}', list_sum(list_transform(range(8), lambda t: substr(s, (j * 8 + t + 1)::int, 1)::int << (7 - t)::int))::int)), '')"


@query(" union all ".join(f"select {bits} as bits, id, {BIT_HEX} as bytes, fingerprint from ({_g726(bits)} select id, string_agg(lpad(bin(p_code), {bits}, '0'), '' order by i) as s, sum(p_value::bigint * i)::bigint as fingerprint from r where i > 0 group by id)" for bits in (2, 3, 4, 5)))
def g726_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of each width as bytes, the high bit first, and read back."""
    each = F.array(*[F.struct(F.lit(b).alias("bits"), adaptive.g726_stream(F.col("v"), b).alias("b")) for b in (2, 3, 4, 5)])
    rows = views.pcm(spark, sf_dir).select("id", F.explode(each).alias("s")).select("s.bits", "id", "s.b")
    back = F.when(F.col("bits") == 2, adaptive.g726_from_stream(F.col("b"), 2)).when(F.col("bits") == 3, adaptive.g726_from_stream(F.col("b"), 3)).when(F.col("bits") == 4, adaptive.g726_from_stream(F.col("b"), 4)).otherwise(adaptive.g726_from_stream(F.col("b"), 5))
    return rows.select("bits", "id", F.hex("b").alias("bytes"), _print(back).alias("fingerprint"))


STREAM = 50
LONG_PCM = f"select id // {STREAM} as id, flatten(list(v order by id)) as v from ({PCM}) group by 1"
PACKETED = " union all ".join(
    f"select * from ({step.replace(f'as ({PCM})', f'as ({LONG_PCM})')} select '{name}' as codec, id as stream, count(*) as n, sum(p_value::bigint * i)::bigint as fingerprint from r where i > 0 group by id)"
    for name, step in (("ima", IMA_ENCODE), ("g726-3", _g726(3)), ("g726-5", _g726(5)))
)


@query(PACKETED)
def codec_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of fifty frames, coded in one piece, cut into packets of 1, 3, 5 bytes and so on, and decoded packet by packet."""
    frames = views.pcm(spark, sf_dir).groupBy(F.expr(f"id div {STREAM}").alias("stream")).agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("l")).select("stream", F.flatten("l.v").alias("v"))
    out = []
    for name, codec, bits, codes in (("ima", "ima", 4, adaptive.ima_encode(F.col("v"))), ("g726-3", "g726", 3, adaptive.g726_encode(F.col("v"), 3)), ("g726-5", "g726", 5, adaptive.g726_encode(F.col("v"), 5))):
        whole = frames.select("stream", adaptive.pack_codes(codes, bits).alias("b"))
        last = F.floor(F.sqrt(F.octet_length("b") - 1)).cast("int")
        packets = whole.select("stream", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda k: F.substring("b", k * k + 1, 2 * k + 1))).alias("frame", "b"))
        found = packet_codecs.decode(packets, codec, bits)
        before = F.coalesce(F.sum(F.size("v")).over(Window.partitionBy("stream").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        weighed = F.aggregate(F.transform("v", lambda v, i: v.cast("long") * (i + 1 + F.col("before"))), F.lit(0).cast("long"), lambda a, v: a + v)
        out.append(found.withColumn("before", before).groupBy(F.lit(name).alias("codec"), "stream").agg(F.sum(F.size("v")).alias("n"), F.sum(weighed).alias("fingerprint")))
    return out[0].union(out[1]).union(out[2])


def _each_codec(extra: str) -> str:
    """A row for each frame through the codec of its id: codec, codes, samples, fingerprint, and ``extra``."""
    g722 = "sum(least(greatest(round_even(p_lv, 0) + round_even(p_hv, 0), -32768), 32767)::bigint * (2 * i - 1) + least(greatest(round_even(p_lv, 0) - round_even(p_hv, 0), -32768), 32767)::bigint * 2 * i)::bigint"
    law = lambda encode, decode: f"select id, len(v)::int as codes, len(v)::int as samples, {_print_sql('b')} as fingerprint from (select id, v, list_transform(list_transform(v, lambda v: {encode('v')}), lambda c: {decode('c')}) as b from ({PCM}))"
    parts = [
        f"{G722} select id, count(*)::int as codes, (2 * count(*))::int as samples, {g722} as fingerprint from r where i > 0 group by id",
        law(_alaw_encode_sql, _alaw_decode_sql),
        law(_ulaw_encode_sql, _ulaw_decode_sql),
        f"{_g726(4)} select id, count(*)::int as codes, count(*)::int as samples, sum(p_value::bigint * i)::bigint as fingerprint from r where i > 0 group by id",
        f"{IMA_ENCODE} select id, count(*)::int as codes, count(*)::int as samples, sum(p_value::bigint * i)::bigint as fingerprint from r where i > 0 group by id",
    ]
    ids = (2, 6, 7, 8, 26)
    return " union all ".join(f"select id, {c} as codec, codes, samples, fingerprint{extra} from ({sql}) where id % 5 = {k}" for k, (c, sql) in enumerate(zip(ids, parts, strict=True)))


def _by_id(spark, sf_dir, registry) -> DataFrame:
    ids = F.array(*[F.lit(i) for i in registry.ids()])
    return views.pcm(spark, sf_dir).withColumn("codec", F.get(ids, (F.col("id") % len(registry.ids())).cast("int")))


@query(_each_codec(""))
def codec_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame through the codec of its id, and back."""
    registry = default_registry()
    rows = _by_id(spark, sf_dir, registry)
    rows = rows.withColumn("codes", registry.encode(F.col("codec"), F.col("v"))).withColumn("back", registry.decode(F.col("codec"), F.col("codes")))
    return rows.select("id", "codec", F.size("codes").alias("codes"), F.size("back").alias("samples"), _print("back").alias("fingerprint"))


@query(f"select id, codec, case id % 3 when 0 then 'hisilicon' when 1 then 'dahua' else 'uniview' end as chip, samples, fingerprint, (case codec when 8 then codes // 2 when 26 then codes // 2 + 4 else codes end + case when id % 3 = 1 then 6 else 4 end)::int as bytes from ({_each_codec('')})")
def device_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as a vendor's device sends them: encoded by the codec of their id, with the vendor's header, and both taken off again."""
    registry = byte_registry()
    chip = F.get(F.array(F.lit("hisilicon"), F.lit("dahua"), F.lit("uniview")), (F.col("id") % 3).cast("int"))
    rows = _by_id(spark, sf_dir, registry).withColumn("b", from_pcm(registry, F.col("codec"), F.col("v"), chip))
    rows = rows.withColumn("p", to_pcm(registry, F.col("codec"), F.col("b")))
    return rows.select("id", "codec", "p.chip", F.size("p.samples").alias("samples"), _print("p.samples").alias("fingerprint"), F.octet_length("b").alias("bytes"))
