"""Queries over levels, gain control and speech."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxtone.functions import filters
from fluxtone.operators import speech
from fluxtone.plans import views
from fluxtone.plans.dsp import _level
from fluxtone.plans.oracle import FRAMES, SERIES, fold

QUERIES, ORACLE = {}, {}
RATE = 8000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _lists(spark, sf_dir) -> DataFrame:
    """A stream's samples in order; one group a stream, as a recurrence needs."""
    rows = views.series(spark, sf_dir).groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("seq", "x"))).alias("l"))
    return rows.select("stream", F.transform("l", lambda s: s["x"]).alias("x"))


LISTS = f"select stream as id, list(x order by seq) as x from ({SERIES}) group by stream"
LAST = "select id as stream, round(sum(p_y * p_y), 6) as energy, round(arg_max(p_y, i), 6) as last from r where i > 0 group by id"


@query(f"{fold(LISTS, 'x', {'y': '0::double'}, [], {'y': '0.99::double * p_y + (1 - 0.99::double) * abs(s)'})} {LAST}")
def ema_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).select("stream", filters.envelope(F.col("x")).alias("y")).select("stream", *_level("y"))


def _agc_sql() -> str:
    attack, release = (math.exp(-1000 / (RATE * ms)) for ms in (10.0, 500.0))
    target, most = 10 ** (-18 / 20), 10.0
    lets = [("e2", "0.99::double * p_e + 0.01::double * s * s"), ("want", f"least({target!r}::double / sqrt(e2), {most!r}::double)"), ("k", f"case when want < p_g then {attack!r}::double else {release!r}::double end"), ("g2", "k * p_g + (1 - k) * want")]
    return f"{fold(LISTS, 'x', {'e': '0.001::double', 'g': '1::double', 'y': '0::double'}, lets, {'e': 'e2', 'g': 'g2', 'y': 's * g2'})} {LAST}"


@query(_agc_sql())
def agc_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).select("stream", filters.automatic_gain(F.col("x"), RATE).alias("y")).select("stream", *_level("y"))


def _compressor_sql() -> str:
    attack, release = (math.exp(-1 / (RATE * ms / 1000)) for ms in (10.0, 100.0))
    lets = [
        ("level", "case when abs(s) > 1e-10 then 20 * log10(abs(s)) else -120.0::double end"),
        ("over_knee", "level - -20.0::double + 3.0::double"),
        ("less", "case when over_knee < 0 then 0.0::double when over_knee > 6 then (level + 20) * 0.75::double else over_knee / 6 * (over_knee / 6) * 6 * 0.75::double / 4 end"),
        ("target", "pow(10.0::double, -less / 20)"),
        ("k", f"case when target < p_e then {attack!r}::double else {release!r}::double end"),
        ("e2", "k * p_e + (1 - k) * target"),
    ]
    return f"{fold(LISTS, 'x', {'e': '0::double', 'y': '0::double'}, lets, {'e': 'e2', 'y': 's * e2'})} {LAST}"


@query(_compressor_sql())
def compressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).select("stream", filters.compressor(F.col("x"), RATE).alias("y")).select("stream", *_level("y"))


BINS = [(b, k) for b, (low, high) in enumerate(speech.BANDS) for k in range(low * 64 // RATE, high * 64 // RATE + 1) if k < 32]
ENERGY = f"""select id, band, sum(re * re + im * im) / (count(*) * 64) as energy from (
  select id, band, k, sum(x * cos(2 * pi() * ((k * n) % 64) / 64)) as re, sum(x * sin(2 * pi() * ((k * n) % 64) / 64)) as im
  from (select id, unnest(x) as x, generate_subscripts(x, 1) - 1 as n from ({FRAMES})) cross join (values {", ".join(f"({b}, {k})" for b, k in BINS)}) b(band, k) group by all) group by id, band"""


@query(f"select id, band, round(energy, 6) as energy from ({ENERGY})")
def subband_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.subband_energy(views.frames_long(spark, sf_dir), 64, RATE).select("id", "band", F.round("energy", 6).alias("energy"))


#: Streams of fifty frames; loudness rises and falls over a stream so that speech and silence both occur.
def _levels(spark, sf_dir) -> DataFrame:
    energy = speech.bands_of(speech.subband_energy(views.frames_long(spark, sf_dir), 64, RATE))
    loud = F.when((F.col("id") / 10).cast("int") % 25 < 4, 16000.0).otherwise(1500.0)
    return energy.select(F.expr("id div 50").alias("stream"), F.col("id").alias("frame"), F.transform("energies", lambda e: e * loud).alias("energies"))


def _vad_sql() -> str:
    source = f"""select id // 50 as id, list(e order by frame) as x from (select id, id as frame, list(energy * case when (id // 10) % 25 < 4 then 16000.0::double else 1500.0::double end order by band) as e from ({ENERGY}) group by id) group by 1"""
    lets, new = [], {}
    for b in range(6):
        speech_level = repr(speech.SPEECH[b] * (1 - 0.15))
        lets.append((f"c{b}", f"case when s[{b + 1}] > {speech_level}::double then 1.0::double when s[{b + 1}] > p_n{b} * 1.2::double then (s[{b + 1}] - p_n{b} * 1.2::double) / ({speech_level}::double - p_n{b} * 1.2::double + 1) else 0.0::double end"))
        new[f"n{b}"] = f"p_n{b} * 0.95::double + s[{b + 1}] * 0.05::double"
    new["p"] = "least(greatest((" + " + ".join(f"c{b}" for b in range(6)) + ") / 6, 0), 1)"
    return fold(source, "x", {**{f"n{b}": f"{speech.NOISE[b]}::double" for b in range(6)}, "p": "0.0::double"}, lets, new)


@query(f"{_vad_sql()} select id as stream, count(*) as frames, round(sum(p_p * i), 4) as weighted, round(max(p_p), 4) as most from r where i > 0 group by id")
def vad_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = speech.speech_probability(_levels(spark, sf_dir)).withColumn("i", F.row_number().over(Window.partitionBy("stream").orderBy("frame")))
    return rows.groupBy("stream").agg(F.count("*").alias("frames"), F.round(F.sum(F.col("probability") * F.col("i")), 4).alias("weighted"), F.round(F.max("probability"), 4).alias("most"))


@query(f"""{_vad_sql()} select id as stream, (sum(speech::int))::bigint as speech, (sum(loud::int))::bigint as above from (
  select id, p_p > 0.5::double - 0.1::double as loud, coalesce(i - last_value(case when p_p > 0.5::double - 0.1::double then i end ignore nulls) over (partition by id order by i rows between unbounded preceding and current row) <= 15, false) as speech from r where i > 0) group by id""")
def vad_hangover(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = speech.speech_decision(speech.speech_probability(_levels(spark, sf_dir)))
    return rows.groupBy("stream").agg(F.sum(F.col("speech").cast("int")).alias("speech"), F.sum((F.col("probability") > 0.5 - 0.1).cast("int")).alias("above"))


def _numbered(spark, sf_dir) -> DataFrame:
    return views.series(spark, sf_dir).select("stream", (F.row_number().over(Window.partitionBy("stream").orderBy("seq")) - 1).cast("long").alias("n"), "x")


TURNS = f"select stream, row_number() over (partition by stream order by seq) - 1 as n, count(*) over (partition by stream) as size, x from ({SERIES})"


def _noise_sql(size: int = 32, db: float = 12.0) -> str:
    """Frames, their spectra as sums of products, the noise as a recursion over frames, and samples as sums over frames."""
    hop, half, keep = size // 2, size // 2, 1 - 10 ** (-db / 20)
    return f"""with recursive s as ({TURNS}),
  v as (select stream, f, n - {hop} * f as j, x * 0.5 * (1 - cos(2 * pi() * (n - {hop} * f) / {size - 1})) as v from (select *, unnest([n // {hop}, n // {hop} - 1]) as f from s) where f >= 0 and {hop} * f + {size} <= size),
  c as (select stream, f, k, sum(v * cos(2 * pi() * (k * j % {size}) / {size})) as re, -sum(v * sin(2 * pi() * (k * j % {size}) / {size})) as im from v cross join range({half + 1}) t(k) group by all),
  m as (select stream, f, list(sqrt(re * re + im * im) order by k) as m from c group by all),
  r as (select distinct stream, -1::bigint as f, list_resize([]::double[], {half + 1}, 0.0::double) as noise from m
    union all select r.stream, r.f + 1, case when r.f + 1 < 10 then list_transform(list_zip(noise, m), lambda p: (p[1] * (r.f + 1) + p[2]) / (r.f + 2))
      when list_sum(m) < 2 * list_sum(noise) then list_transform(list_zip(noise, m), lambda p: 0.9::double * p[1] + 0.1::double * p[2]) else noise end from r join m on r.stream = m.stream and m.f = r.f + 1),
  g as (select c.stream, c.f, k, re, im, sqrt(re * re + im * im) as level, noise[k + 1] as noise from c join r on c.stream = r.stream and c.f = r.f),
  y as (select stream, f * {hop} + j as n, sum(case when k in (0, {half}) then 1 else 2 end / {size}.0::double * greatest(level - {keep!r}::double * noise, 0.01::double * level) / greatest(level, 1e-12::double)
      * (re * cos(2 * pi() * (k * j % {size}) / {size}) - im * sin(2 * pi() * (k * j % {size}) / {size}))) as y from g cross join range({size}) t(j) group by all)
  select s.stream, count(*) as n, round(sum(case when size < {size} then x * x else coalesce(y * y, 0) end), 8) as energy from s left join y on s.stream = y.stream and s.n = y.n group by 1"""


@query(_noise_sql())
def noise_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 32 samples, since streams are short here."""
    out = speech.suppress_noise(_numbered(spark, sf_dir), 12.0, 32)
    return out.groupBy("stream").agg(F.count("*").alias("n"), F.round(F.sum(F.col("y") * F.col("y")), 8).alias("energy"))


def _echo_sql(taps: int = 8) -> str:
    heard = ", ".join(f"coalesce(lag(x, {k}) over w, 0)" for k in range(taps))
    source = f"""select stream as id, list({{'d': d, 'h': h}} order by n) as v from (select stream, n, 0.6::double * x + 0.2::double * coalesce(lag(x, 2) over w, 0) as d, [{heard}] as h from ({TURNS}) window w as (partition by stream order by n)) group by 1"""
    weights = [*speech.FIRST_WEIGHTS, *[0.0] * taps][:taps]
    lets = [
        ("e2", "s.d - list_inner_product(p_w, s.h)"),
        ("power", "list_inner_product(s.h, s.h)"),
        ("a2", "p_a + s.d * s.d"),
        ("b2", "p_b + power"),
        ("c2", "p_c + e2 * e2"),
        ("w2", "case when not (a2 > 0.5::double * b2 and c2 > 0.1::double * b2) and power > 1e-6::double then list_transform(list_zip(p_w, s.h), lambda p: p[1] + 0.1::double / (power + 1e-6::double) * e2 * p[2]) else p_w end"),
    ]
    start = {"w": f"[{', '.join(f'{v}::double' for v in weights)}]", "a": "0::double", "b": "0::double", "c": "0::double", "e": "0::double"}
    return f"{fold(source, 'v', start, lets, {'w': 'w2', 'a': 'a2', 'b': 'b2', 'c': 'c2', 'e': 'e2'})} select id as stream, count(*) as n, round(sum(p_e * p_e), 8) as left from r where i > 0 group by id"


@query(_echo_sql().replace("as left from", 'as "left" from'))
def echo_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The far end is the stream, the near end its echo."""
    far = _numbered(spark, sf_dir)
    echo = (0.6 * F.col("x") + 0.2 * F.coalesce(F.lag("x", 2).over(Window.partitionBy("stream").orderBy("n")), F.lit(0.0))).alias("x")
    out = speech.cancel_echo(far.select("stream", "n", echo), far, 8, rate=0.1)
    return out.groupBy("stream").agg(F.count("*").alias("n"), F.round(F.sum(F.col("y") * F.col("y")), 8).alias("left"))


def _preprocess_sql() -> str:
    f = filters.Biquad.design("highpass", RATE, 80)
    y = f"{f.b0!r}::double * s + {f.b1!r}::double * p_x1 + {f.b2!r}::double * p_x2 - {f.a1!r}::double * p_y1 - {f.a2!r}::double * p_y2"
    return f"{fold(FRAMES, 'x', {k: '0::double' for k in ('x1', 'x2', 'y1', 'y2')}, [('o', y)], {'x1': 's', 'x2': 'p_x1', 'y1': 'o', 'y2': 'p_y1'})} select id, round(sqrt(avg(p_y1 * p_y1)) , 6) as rms, sqrt(avg(p_y1 * p_y1)) > 0.1 as kept from r where i > 0 group by id"


@query(_preprocess_sql())
def voice_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High-pass, then a gate by level; quiet frames are silenced."""
    rows = views.frames(spark, sf_dir).select("id", filters.biquad(F.col("x"), filters.Biquad.design("highpass", RATE, 80)).alias("y"))
    rms = F.sqrt(F.aggregate("y", F.lit(0.0), lambda a, v: a + v * v) / F.size("y"))
    return rows.select("id", F.round(rms, 6).alias("rms"), (rms > 0.1).alias("kept"))


#: Streams of five frames in a row, and what brings their energies to the detector's levels.
CHAIN, SCALE = 5, 6500.0


def _chain_sql() -> str:
    """High-pass over a stream's samples, the detector over its frames, and the gain over the samples of frames with speech."""
    f = filters.Biquad.design("highpass", RATE, 80)
    y = f"{f.b0!r}::double * s + {f.b1!r}::double * p_x1 + {f.b2!r}::double * p_x2 - {f.a1!r}::double * p_y1 - {f.a2!r}::double * p_y2"
    passed = f"""select id, (i - 1) // 64 as frame, (i - 1) % 64 as n, p_y1 as y from (
      {fold(f"select id // {CHAIN} as id, flatten(list(x order by id)) as x from ({FRAMES}) group by 1", "x", {k: "0::double" for k in ("x1", "x2", "y1", "y2")}, [("o", y)], {"x1": "s", "x2": "p_x1", "y1": "o", "y2": "p_y1"})} select id, i, p_y1 from r where i > 0)"""
    energy = f"""select id, frame, band, sum(re * re + im * im) / (count(*) * 64) * {SCALE}::double as energy from (
      select id, frame, band, k, sum(y * cos(2 * pi() * ((k * n) % 64) / 64)) as re, sum(y * sin(2 * pi() * ((k * n) % 64) / 64)) as im
      from passed cross join (values {", ".join(f"({b}, {k})" for b, k in BINS)}) b(band, k) group by all) group by id, frame, band"""
    lets, new = [], {}
    for b in range(6):
        level = repr(speech.SPEECH[b] * (1 - 0.15))
        lets.append((f"c{b}", f"case when s[{b + 1}] > {level}::double then 1.0::double when s[{b + 1}] > p_n{b} * 1.2::double then (s[{b + 1}] - p_n{b} * 1.2::double) / ({level}::double - p_n{b} * 1.2::double + 1) else 0.0::double end"))
        new[f"n{b}"] = f"p_n{b} * 0.95::double + s[{b + 1}] * 0.05::double"
    new["p"] = "least(greatest((" + " + ".join(f"c{b}" for b in range(6)) + ") / 6, 0), 1)"
    detector = fold(f"select id, list(e order by frame) as x from (select id, frame, list(energy order by band) as e from ({energy}) group by all) group by id", "x", {**{f"n{b}": f"{speech.NOISE[b]}::double" for b in range(6)}, "p": "0.0::double"}, lets, new)
    attack, release = (math.exp(-1000 / (RATE * ms)) for ms in (10.0, 500.0))
    gain = fold(
        "select id, list({'v': y, 'f': frame} order by frame, n) as x from passed join heard using (id, frame) where speech group by id",
        "x",
        {"e": "0.001::double", "g": "1.0::double", "o": "0.0::double", "f": "0::bigint"},
        [("e2", "0.99::double * p_e + 0.01::double * s.v * s.v"), ("wanted", f"least({10 ** (-18 / 20)!r}::double / sqrt(e2), 10.0::double)"), ("k", f"case when wanted < p_g then {attack!r}::double else {release!r}::double end"), ("g2", "k * p_g + (1 - k) * wanted")],
        {"e": "e2", "g": "g2", "o": "s.v * g2", "f": "s.f"},
    )
    return f"""with passed as ({passed}), said as (select id, i - 1 as frame, p_p as p from ({detector} select id, i, p_p from r where i > 0)),
      heard as (select *, coalesce(frame - last_value(case when p > 0.4::double then frame end ignore nulls) over (partition by id order by frame rows between unbounded preceding and current row) <= 15, false) as speech from said),
      levelled as (select id, f as frame, sum(o * o) as energy from ({gain} select id, p_o as o, p_f as f from r where i > 0) group by all)
      select h.id as stream, h.frame::bigint as frame, round(p, 5) as probability, speech, round(coalesce(energy, 0), 6) as energy from heard h left join levelled l using (id, frame)"""


@query(_chain_sql())
def voice_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of frames through the whole preprocessing."""
    rows = views.frames(spark, sf_dir).select(F.expr(f"id div {CHAIN}").alias("stream"), (F.col("id") % CHAIN).alias("frame"), "x")
    out = speech.preprocess(rows, RATE, scale=SCALE)
    return out.select("stream", "frame", F.round("probability", 5).alias("probability"), "speech", F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + v * v), 6).alias("energy"))
