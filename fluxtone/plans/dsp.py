"""Queries over sample frames: conversions, companding, level, mixing, filters, fades, resampling, overlap-add."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxtone.functions import filters, g711, signal
from fluxtone.operators import mixing
from fluxtone.operators.chain import Chain
from fluxtone.plans import views
from fluxtone.plans.oracle import FRAMES, PCM, SERIES, fold

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _print(column: str) -> F.Column:
    """Fingerprint of an integer list: the sum of each value times its place from 1."""
    return F.aggregate(F.transform(column, lambda v, i: v.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)


def _print_sql(column: str) -> str:
    return f"list_sum(list_transform({column}, lambda v, i: v::bigint * i))::bigint"




def _alaw_encode_sql(v: str) -> str:
    m = f"(case when {v} < 0 then -({v}) - 1 else {v} end)"
    seg = f"(case when {m} <= 255 then 0 when {m} <= 511 then 1 when {m} <= 1023 then 2 when {m} <= 2047 then 3 when {m} <= 4095 then 4 when {m} <= 8191 then 5 when {m} <= 16383 then 6 else 7 end)"
    return f"xor(({seg} << 4) | (({m} >> (case when {seg} < 2 then 4 else {seg} + 3 end)) & 15), case when {v} < 0 then 85 else 213 end)"


def _alaw_decode_sql(c: str) -> str:
    x = f"xor({c}, 85)"
    seg = f"(({x} >> 4) & 7)"
    m = f"(case when {seg} = 0 then (({x} & 15) << 4) + 8 else ((({x} & 15) << 4) + 264) << ({seg} - 1) end)"
    return f"(case when {x} & 128 <> 0 then {m} else -{m} end)"


def _ulaw_encode_sql(v: str) -> str:
    q = f"({v} >> 2)"
    m = f"(least(abs({q}), 8159) + 33)"
    seg = f"(case when {m} <= 63 then 0 when {m} <= 127 then 1 when {m} <= 255 then 2 when {m} <= 511 then 3 when {m} <= 1023 then 4 when {m} <= 2047 then 5 when {m} <= 4095 then 6 when {m} <= 8191 then 7 else 8 end)"
    return f"xor(case when {seg} >= 8 then 127 else ({seg} << 4) | (({m} >> ({seg} + 1)) & 15) end, case when {q} < 0 then 127 else 255 end)"


def _ulaw_decode_sql(c: str) -> str:
    x = f"(255 - {c})"
    m = f"((((({x} & 15) << 3) + 132) << (({x} >> 4) & 7)) - 132)"
    return f"(case when {x} & 128 <> 0 then -{m} else {m} end)"


def _roundtrip(spark, sf_dir, encode, decode) -> DataFrame:
    rows = views.pcm(spark, sf_dir).withColumn("back", F.transform("v", lambda v: decode(encode(v))))
    error = F.zip_with("v", "back", lambda a, b: F.abs(a - b))
    rows = rows.select("label", F.array_max(error).alias("worst"), F.aggregate(error, F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), signal.peak(F.col("v")).alias("peak"))
    return rows.groupBy("label").agg(F.count("*").alias("frames"), F.max("worst").alias("max_error"), F.sum("total").alias("total_error"), F.max("peak").alias("peak"))


def _roundtrip_sql(encode, decode) -> str:
    return f"""with l as (select id, label, unnest(v) as v from ({PCM})),
    c as (select *, {encode("v")} as c from l), d as (select *, {decode("c")} as b from c)
    select label, count(distinct id) as frames, max(abs(v - b)) as max_error, sum(abs(v - b))::bigint as total_error, max(abs(v)) as peak from d group by label"""


@query(f"select id, {_print_sql('c')} as fingerprint from (select id, list_transform(v, lambda v: {_alaw_encode_sql('v')}) as c from ({PCM}))")
def alaw_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pcm(spark, sf_dir).select("id", F.transform("v", g711.alaw_encode).alias("c")).select("id", _print("c").alias("fingerprint"))


@query(_roundtrip_sql(_alaw_encode_sql, _alaw_decode_sql))
def alaw_roundtrip_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, g711.alaw_encode, g711.alaw_decode)


@query(f"select id, {_print_sql('c')} as fingerprint from (select id, list_transform(v, lambda v: {_ulaw_encode_sql('v')}) as c from ({PCM}))")
def ulaw_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pcm(spark, sf_dir).select("id", F.transform("v", g711.ulaw_encode).alias("c")).select("id", _print("c").alias("fingerprint"))


@query(_roundtrip_sql(_ulaw_encode_sql, _ulaw_decode_sql))
def ulaw_roundtrip_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, g711.ulaw_encode, g711.ulaw_decode)


@query(f"""select id, {_print_sql('q')} as fingerprint, round(list_max(list_transform(list_zip(x, q), lambda p: abs(p[1] * 4 - p[2] / 32768.0))), 6) as worst
  from (select id, x, list_transform(x, lambda s: least(greatest(trunc(s * 4 * 32767), -32768), 32767)::int) as q from ({FRAMES}))""")
def pcm16_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.frames(spark, sf_dir).withColumn("loud", F.transform("x", lambda s: s * 4)).withColumn("q", signal.float_to_pcm16(F.col("loud")))
    return rows.select("id", _print("q").alias("fingerprint"), F.round(F.array_max(F.zip_with("loud", signal.pcm16_to_float(F.col("q")), lambda a, b: F.abs(a - b))), 6).alias("worst"))


@query(f"""select id, {_print_sql('q')} as fingerprint, round(list_max(list_transform(list_zip(x, q), lambda p: abs(p[1] - (p[2] - 128) / 128.0))), 6) as worst
  from (select id, x, list_transform(x, lambda s: least(greatest(trunc((s + 1) * 127.5), 0), 255)::int) as q from ({FRAMES}))""")
def pcm8_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.frames(spark, sf_dir).withColumn("q", signal.float_to_pcm8(F.col("x")))
    return rows.select("id", _print("q").alias("fingerprint"), F.round(F.array_max(F.zip_with("x", signal.pcm8_to_float(F.col("q")), lambda a, b: F.abs(a - b))), 6).alias("worst"))


@query(f"""select id, len(x) * 2 as stereo, len(x) // 2 as mono, round(list_sum(list_transform(generate_series(1, len(x) // 2), lambda i: (x[2 * i - 1] + x[2 * i]) / 2 * i)), 6) as weighted from ({FRAMES})""")
def mono_stereo_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.frames(spark, sf_dir).select("id", F.size(signal.mono_to_stereo(F.col("x"))).cast("long").alias("stereo"), signal.stereo_to_mono(F.col("x")).alias("m"))
    return rows.select("id", "stereo", F.size("m").cast("long").alias("mono"), F.round(F.aggregate(F.transform("m", lambda s, i: s * (i + 1)), F.lit(0.0), lambda a, v: a + v), 6).alias("weighted"))


@query(f"""select id, round(list_max(list_transform(y, lambda s: abs(s))), 6) as peak, len(list_filter(y, lambda s: abs(s) = 0.8)) as clipped
  from (select id, list_transform(x, lambda s: least(greatest(s * {signal.gain_of_db(12)!r}::double, -0.8::double), 0.8::double)) as y from ({FRAMES}))""")
def gain_clip_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.frames(spark, sf_dir).select("id", signal.volume(F.col("x"), signal.gain_of_db(12), 0.8).alias("y"))
    return rows.select("id", F.round(signal.peak(F.col("y")), 6).alias("peak"), F.size(F.filter("y", lambda s: F.abs(s) == 0.8)).cast("long").alias("clipped"))


@query(f"select stream, count(*) as n, round(sqrt(avg(x * x)), 6) as rms, round(max(abs(x)), 6) as peak from ({SERIES}) group by stream")
def level_rms_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.series(spark, sf_dir).groupBy("stream").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.col("x") * F.col("x"))), 6).alias("rms"), F.round(F.max(F.abs("x")), 6).alias("peak"))


@query(f"""with l as (select id, unnest(x) as x, generate_subscripts(x, 1) - 1 as n from ({FRAMES})),
  u as (select n, id % 7 as mix, 0.5 * x as x, id from l where id % 3 = 0 and n < 40 union all select n, id % 7, x, id from l where id % 3 <> 0)
  select mix, n::int as n, round(sum(x) / (select count(distinct id) from u v where v.mix = u.mix), 6) as y from u group by mix, n""")
def mix_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.frames_long(spark, sf_dir).withColumn("mix", F.col("id") % 7)
    quiet, full = rows.where("id % 3 = 0 and n < 40"), rows.where("id % 3 <> 0")
    out = mixing.mix([(quiet, 0.5), (full, 1.0)], group="mix")
    return out.select("mix", "n", F.round("y", 6).alias("y"))


def _fade_sql() -> str:
    p = "(n / 48.0::double)"
    curves = {"linear": p, "logarithmic": f"log10(1 + 9 * {p})", "cosine": f"((1 - cos(pi() * {p})) / 2)"}
    parts = []
    for kind in ("in", "out"):
        for name, shape in curves.items():
            gain, after = (shape, 1.0) if kind == "in" else (f"1 - {shape}", 0.0)
            parts.append(f"select id, '{kind}' as kind, '{name}' as curve, round(sum(x * case when n >= 48 then {after} else {gain} end * (n + 1)), 6) as weighted from l group by id")
    return f"with l as (select id, unnest(x) as x, generate_subscripts(x, 1) - 1 as n from ({FRAMES})) " + " union all ".join(parts)


@query(_fade_sql())
def fade_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six fades in one pass: a gain column for each, then one aggregation."""
    rows, names = views.frames_long(spark, sf_dir), [(k, c) for k in ("in", "out") for c in ("linear", "logarithmic", "cosine")]
    sums = rows.groupBy("id").agg(*[F.round(F.sum(F.col("x") * signal.fade(F.col("n"), 48, k, c) * (F.col("n") + 1)), 6).alias(f"{k}_{c}") for k, c in names])
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("curve"), F.col(f"{k}_{c}").alias("weighted")) for k, c in names])
    return sums.select("id", F.explode(each).alias("s")).select("id", "s.*")



def _level(column: str) -> list[F.Column]:
    return [F.round(F.aggregate(column, F.lit(0.0), lambda a, v: a + v * v), 6).alias("energy"), F.round(F.get(column, F.size(column) - 1), 6).alias("last")]


def _chain_sql(source: str, chain: list[filters.Biquad]) -> str:
    start = {f"{k}{v}": "0.0::double" for k in range(len(chain)) for v in ("x1", "x2", "y1", "y2")}
    lets, new, s = [], {}, "s"
    for k, f in enumerate(chain):
        lets.append((f"o{k}", f"{f.b0!r}::double * {s} + {f.b1!r}::double * p_{k}x1 + {f.b2!r}::double * p_{k}x2 - {f.a1!r}::double * p_{k}y1 - {f.a2!r}::double * p_{k}y2"))
        new |= {f"{k}x1": s, f"{k}x2": f"p_{k}x1", f"{k}y1": f"o{k}", f"{k}y2": f"p_{k}y1"}
        s = f"o{k}"
    last = len(chain) - 1
    return f"{fold(source, 'x', start, lets, new)} select id, round(sum(p_{last}y1 * p_{last}y1), 6) as energy, round(arg_max(p_{last}y1, i), 6) as last from r where i > 0 group by id"


BIQUADS = {k: filters.Biquad.design(k, 8000, 1200, 0.7071, 6.0 if "shelf" in k or k == "peaking" else 0.0) for k in ("lowpass", "highpass", "bandpass", "notch", "peaking", "lowshelf", "highshelf")}


def _biquad_query(name: str, f: filters.Biquad):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return views.frames(spark, sf_dir).select("id", filters.biquad(F.col("x"), f).alias("y")).select("id", *_level("y"))

    QUERIES[f"biquad_{name}"] = run
    ORACLE[f"biquad_{name}"] = _chain_sql(FRAMES, [f])


for _name, _f in BIQUADS.items():
    _biquad_query(_name, _f)

TONE = filters.tone(44100, 4.0, -3.0, 2.0)
TEN = filters.ten_band(44100, [3, 2, 1, 0, -1, -2, -1, 0, 1, 2])


@query(_chain_sql(FRAMES, TONE))
def eq_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.frames(spark, sf_dir).select("id", filters.equalizer(F.col("x"), TONE).alias("y")).select("id", *_level("y"))


@query(_chain_sql(FRAMES, TEN))
def eq_ten_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.frames(spark, sf_dir).select("id", filters.equalizer(F.col("x"), TEN).alias("y")).select("id", *_level("y"))


@query(f"""select id, (8000 * (1 + id % 6) * 2 * 8 // 8)::int as byte_rate, (160 * (1 + id % 3) * 2 * (8 // 8))::int as frame_bytes, (8000 * (1 + id % 6) * (1 + id % 2) * 16 // 8)::int as before, round(list_sum(x), 6) as total from ({FRAMES})""")
def format_declare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that are said to be of other bits and channels: what follows from the format changes, samples don't."""
    known = signal.audio_format(8000 * (1 + F.col("id") % 6), 1 + F.col("id") % 2, F.lit(16), 160 * (1 + F.col("id") % 3))
    rows = views.frames(spark, sf_dir).withColumn("f", known).withColumn("g", signal.declare(F.col("f"), bits=8, channels=2))
    return rows.select("id", signal.byte_rate(F.col("g")).alias("byte_rate"), signal.bytes_per_frame(F.col("g")).alias("frame_bytes"), signal.byte_rate(F.col("f")).alias("before"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query(f"select id, round(list_sum(list_transform(x, lambda v: least(greatest(v * 4, -1), 1) * 0.5)), 6) as total, round(list_max(list_transform(x, lambda v: abs(least(greatest(v * 4, -1), 1) * 0.5))), 6) as peak from ({FRAMES})")
def processor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Louder, clipped, softer; a fourth step is put in and taken out again."""
    over_x = lambda f: lambda frames: frames.withColumn("x", F.transform("x", f))
    silent = over_x(lambda v: v * 0)
    steps = Chain(silent, over_x(lambda v: v * 4), over_x(lambda v: F.least(F.greatest(v, F.lit(-1.0)), F.lit(1.0)))).add(over_x(lambda v: v * 0.5))
    steps.remove(silent)
    rows = steps(views.frames(spark, sf_dir))
    return rows.select("id", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.round(signal.peak(F.col("x")), 6).alias("peak"))
