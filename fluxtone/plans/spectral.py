"""Queries over spectra, prediction and time stretching."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxtone.functions import fast, signal, spectral
from fluxtone.functions.bits import bits_of
from fluxtone.operators import blocks, granules, prediction, stretch
from fluxtone.plans import views
from fluxtone.plans.oracle import CORRELATED, FRAMES, PCM, SERIES

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


LONG = f"select id, unnest(x) as x, generate_subscripts(x, 1) - 1 as n from ({FRAMES})"
HANN = "0.5 * (1 - cos(2 * pi() * n / 63))"
DFT = f"""select id, k, sum(x * {HANN} * cos(2 * pi() * ((k * n) % 64) / 64)) as re, -sum(x * {HANN} * sin(2 * pi() * ((k * n) % 64) / 64)) as im
  from ({LONG}) cross join (select unnest(range(33)) as k) group by id, k"""


@query(f"select id, k::int as k, round(sqrt(re * re + im * im), 5) as magnitude from ({DFT})")
def dft_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.magnitude(spectral.dft(views.frames_long(spark, sf_dir), 64)).select("id", "k", F.round("magnitude", 5).alias("magnitude"))


@query(f"""with m as (select id, k, sqrt(re * re + im * im) / 32 as level from ({DFT}))
  select k::int as k, count(*) as frames, round(avg(case when level > 1e-6 then greatest(20 * log10(level), -120) else -120 end), 4) as mean_db, round(max(case when level > 1e-6 then greatest(20 * log10(level), -120) else -120 end), 4) as max_db from m group by k""")
def power_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = spectral.magnitude(spectral.dft(views.frames_long(spark, sf_dir), 64)).select("k", spectral.power_db(F.col("magnitude"), 64).alias("db"))
    return level.groupBy("k").agg(F.count("*").alias("frames"), F.round(F.avg("db"), 4).alias("mean_db"), F.round(F.max("db"), 4).alias("max_db"))


@query(f"""select kind, n::int as n, round(w, 6)::double as w, round(level * w, 5) as level from (
  select kind, n, level, case kind when 'hann' then 0.5 * (1 - cos(2 * pi() * n / 63)) when 'hamming' then 0.54 - 0.46 * cos(2 * pi() * n / 63)
  when 'blackman' then 0.42 - 0.5 * cos(2 * pi() * n / 63) + 0.08 * cos(4 * pi() * n / 63) else 1 end as w
  from (select unnest(['hann', 'hamming', 'blackman', 'rectangular']) as kind) cross join (select n, avg(abs(x)) as level from ({LONG}) group by n))""")
def window_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of the places of a frame by each window, and the mean level of all frames there under it."""
    rows = views.frames_long(spark, sf_dir).groupBy("n").agg(F.avg(F.abs("x")).alias("level"))
    each = F.array(*[F.struct(F.lit(k).alias("kind"), signal.window(F.col("n"), 64, k).alias("w")) for k in ("hann", "hamming", "blackman", "rectangular")])
    return rows.select("n", "level", F.explode(each).alias("s")).select("s.kind", F.col("n").cast("int").alias("n"), F.round("s.w", 6).alias("w"), F.round(F.col("level") * F.col("s.w"), 5).alias("level"))


@query(f"select id, 0.0::double as worst, round(list_sum(list_transform(x, lambda s: s * s)), 5) as energy from ({FRAMES})")
def ifft_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transform and back: no error, and the spectrum's energy is the signal's."""
    rows = fast.fft(views.frames(spark, sf_dir).select("id", "x", fast.complex_of(fast.padded(F.col("x"), 64)).alias("s")), "s", 64)
    rows = fast.fft(rows.withColumn("y", F.col("s")), "y", 64, inverse=True).withColumn("y", F.col("y.re"))
    energy = F.aggregate("s", F.lit(0.0), lambda a, v: a + v["re"] * v["re"] + v["im"] * v["im"]) / 64
    return rows.select("id", F.round(F.array_max(F.zip_with("x", "y", lambda a, b: F.abs(a - b))), 6).alias("worst"), F.round(energy, 5).alias("energy"))


@query(f"""select id, round(sum(re * (k + 1)), 4) as re, round(sum(im * (k + 1)), 4) as im from (
  select id, k, sum(x * cos(2 * pi() * ((k * n) % 64) / 64)) as re, -sum(x * sin(2 * pi() * ((k * n) % 64) / 64)) as im from ({LONG}) cross join (select unnest(range(64)) as k) group by id, k) group by id""")
def spectrum_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All complex bins of a frame, by the fast transform."""
    rows = fast.fft(views.frames(spark, sf_dir).select("id", fast.complex_of(fast.padded(F.col("x"), 64)).alias("s")), "s", 64)
    weighted = lambda part: F.round(F.aggregate(F.transform("s", lambda v, k: v[part] * (k + 1)), F.lit(0.0), lambda a, v: a + v), 4).alias(part)
    return rows.select("id", weighted("re"), weighted("im"))


STREAMS = f"select stream % 3 as stream, row_number() over (partition by stream % 3 order by seq) - 1 as n, x * 200 as x from ({SERIES})"
HALF = 960


def _streams(spark, sf_dir):
    order = Window.partitionBy("stream").orderBy("seq")
    return views.series(spark, sf_dir).withColumn("stream", F.col("stream") % 3).select("stream", (F.row_number().over(order) - 1).cast("long").alias("n"), (F.col("x") * 200).alias("x"))


BLOCK_BANDS = ", ".join(f"({b}, {sum(fast.band_widths(HALF, 21)[:b])}, {w})" for b, w in enumerate(fast.band_widths(HALF, 21)))


@query(f"""with s as ({STREAMS}), f as (select stream, max(n) // {HALF} + 1 as frames from s group by stream),
  b as (select s.stream, n // {HALF} + j as frame, n % {HALF} + case when j = 0 then {HALF} else 0 end as n, x from s cross join (values (0), (1)) t(j)),
  w as (select stream, frame, n, x * sin(pi() / 2 * pow(sin(pi() / {2 * HALF} * (n + 0.5)), 2)) as x from b),
  c as (select stream, frame, k, sum(x * cos(pi() / {HALF} * (n + 0.5 + {HALF // 2}) * (k + 0.5))) * 2 / {HALF} as c from w cross join (select unnest(range({HALF})) as k) group by all),
  q as (select stream, frame, band, case when sum(c * c) > 0 then least(greatest(trunc((20 * log10(sqrt(sum(c * c) / width)) + 28) * 2), 0), 63) else 0 end::int as q from c join (values {BLOCK_BANDS}) t(band, low, width) on k >= low and k < low + width group by stream, frame, band, width)
  select stream, frame, bits, weighted from (select stream, frame, string_agg(lpad(bin(q), 6, '0'), '' order by band) || '00000' as bits from q group by stream, frame) join (select stream, frame, round(sum(c * (k + 1)) / {HALF}, 4) as weighted from c group by stream, frame) using (stream, frame)""")
def opus_stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 960 samples along streams, each block with the frame before it: band levels as packed bits, and all coefficients weighed."""
    c = blocks.spectra(_streams(spark, sf_dir), HALF)
    weighted = F.round(F.aggregate(F.transform("c", lambda v, k: v * (k + 1)), F.lit(0.0), lambda a, v: a + v) / HALF, 4)
    frame = spectral.opus_frame(fast.band_levels(F.col("c"), HALF))
    return c.select("stream", "frame", F.substring(bits_of(F.substring(frame, F.lit(2), F.octet_length(frame))), 1, 21 * 6 + 5).alias("bits"), weighted.alias("weighted"))


@query(f"select stream, n, round(x, 6) as x from ({STREAMS})")
def opus_stream_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of streams again from the coefficients of their blocks of 960."""
    own = _streams(spark, sf_dir)
    ends = own.groupBy("stream").agg(F.max("n").alias("last"))
    return blocks.samples(blocks.spectra(own, HALF), HALF).join(ends, "stream").where("n <= last").select("stream", "n", F.round("x", 6).alias("x"))


EDGES = (0, 2, 4, 8, 16, 32)


@query(f"""with w as (select id, n, x * sin(pi() / 2 * pow(sin(pi() / 64 * (n + 0.5)), 2)) as x from ({LONG})),
  c as (select id, k, sum(x * cos(pi() / 32 * (n + 0.5 + 16) * (k + 0.5))) * 2 / 32 as c from w cross join (select unnest(range(32)) as k) group by id, k)
  select id, case when k < 2 then 0 when k < 4 then 1 when k < 8 then 2 when k < 16 then 3 else 4 end as band,
    round(20 * log10(greatest(sqrt(avg(c * c)), 1e-6)), 4) as level from c group by all""")
def mdct_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spectral.mdct(views.frames_long(spark, sf_dir), 32)
    band = F.when(F.col("k") < EDGES[1], 0)
    for b, edge in enumerate(EDGES[2:], 1):
        band = band.when(F.col("k") < edge, b)
    return c.groupBy("id", band.alias("band")).agg(F.round(20 * F.log10(F.greatest(F.sqrt(F.avg(F.col("c") * F.col("c"))), F.lit(1e-6))), 4).alias("level"))


IMDCT = f"""select id, n, y * sin(pi() / 64 * (n + 0.5)) as y from (
  select id, n, sum(c * cos(pi() / 128 * (2 * n + 1 + 32) * (2 * k + 1))) * 2 / 32 as y from (
    select id, k, x as c from (select id, n as k, x from ({LONG})) where k < 32) cross join (select unnest(range(64)) as n) group by id, n)"""


@query(f"select id % 10 as stream, (id * 32 + n)::bigint as n, round(sum(y), 5) as y from ({IMDCT}) group by all")
def imdct_overlap_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 samples of each frame as coefficients; blocks overlap by half."""
    c = views.frames_long(spark, sf_dir).where("n < 32").select("id", F.col("n").alias("k"), F.col("x").alias("c"))
    blocks = spectral.imdct(c, 32).withColumn("stream", F.col("id") % 10)
    return spectral.overlap_add(blocks, 32).select("stream", "n", F.round("y", 5).alias("y"))


@query(f"""select id, sum(r)::bigint as weighted from (select id, n, unnest([v, v - v1, v - 2 * v1 + v2, v - 3 * v1 + 3 * v2 - v3, v - 4 * v1 + 6 * v2 - 4 * v3 + v4]) * (n + 1) as r from (
  select id, n, v, lag(v, 1) over w as v1, lag(v, 2) over w as v2, lag(v, 3) over w as v3, lag(v, 4) over w as v4 from ({CORRELATED}) window w as (partition by id order by n))) group by id""")
def flac_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = prediction.fixed_residuals(views.correlated(spark, sf_dir))
    return r.groupBy("id").agg(F.sum(F.col("residual") * (F.col("n") + 1)).cast("long").alias("weighted"))


ORDERS = f"""with l as (select id, n, v, lag(v, 1) over w as v1, lag(v, 2) over w as v2, lag(v, 3) over w as v3, lag(v, 4) over w as v4 from ({CORRELATED}) window w as (partition by id order by n)),
  e as (select id, n, 0 as ord, v as r from l union all select id, n, 1, v - v1 from l where n >= 1 union all select id, n, 2, v - 2 * v1 + v2 from l where n >= 2
    union all select id, n, 3, v - 3 * v1 + 3 * v2 - v3 from l where n >= 3 union all select id, n, 4, v - 4 * v1 + 6 * v2 - 4 * v3 + v4 from l where n >= 4),
  b as (select id, ord, case when ord = 0 then count(*) * 16 else ord * 16 + sum(((case when r >= 0 then 2 * r else -2 * r - 1 end) >> 4) + 5) + 8 end::bigint as bits from e group by id, ord)"""


@query(ORDERS + " select id, arg_min(ord, (bits, ord)) as ord, min(bits) as bits from b group by id")
def flac_best_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction.best_order(views.correlated(spark, sf_dir))


@query(f"""select id, sum((z >> 4) + 5)::bigint as bits, sum(z)::bigint as folded, true as same from (
  select id, case when r >= 0 then 2 * r else -2 * r - 1 end as z from (select id, v - lag(v) over (partition by id order by n) as r from ({CORRELATED})) where r is not null) group by id""")
def flac_rice_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the first-order residuals, read back."""
    r = prediction.fixed_residuals(views.correlated(spark, sf_dir)).where("ord = 1").withColumn("code", prediction.rice_code(F.col("residual")))
    back = prediction.rice_decode(F.col("code"))
    return r.groupBy("id").agg(F.sum(F.length("code")).cast("long").alias("bits"), F.sum(prediction.zigzag(F.col("residual"))).cast("long").alias("folded"), F.bool_and(back == F.col("residual")).alias("same"))


@query(f"select id, count(*) as n, sum(v * (n + 1))::bigint as weighted, true as same from ({CORRELATED}) group by id")
def flac_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-order residuals and two warm-up samples give the signal back."""
    rows = views.correlated(spark, sf_dir)
    order = Window.partitionBy("id").orderBy("n")
    e = rows.select("id", "n", "v", (F.col("v") - 2 * F.lag("v", 1).over(order) + F.lag("v", 2).over(order)).alias("e"))
    lists = e.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "v", "e"))).alias("l"))
    first = F.transform(F.slice("l", 1, 2), lambda s: s["v"])
    residual = F.transform(F.filter("l", lambda s: s["n"] >= 2), lambda s: s["e"])
    lists = lists.select("id", F.transform("l", lambda s: s["v"]).alias("v"), prediction.restore(first, residual, 2).alias("back"))
    weighted = F.aggregate(F.transform("back", lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    return lists.select("id", F.size("back").cast("long").alias("n"), weighted.alias("weighted"), (F.col("v") == F.col("back")).alias("same"))


@query(f"""with s as (select id, n, x as l, lead(x) over (partition by id order by n) as r from (select id, unnest(v) as x, generate_subscripts(v, 1) - 1 as n from ({PCM}))),
  m as (select id, n, (l + r) >> 1 as mid, l - r as side, l, r from s where n % 2 = 0)
  select id, sum(mid * (n + 1))::bigint as mid, sum(side * (n + 1))::bigint as side, true as same from m group by id""")
def flac_stereo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Middle and side of interleaved pairs, and left and right from them."""
    rows = views.pcm(spark, sf_dir).select("id", F.posexplode("v").alias("n", "l")).withColumn("r", F.lead("l").over(Window.partitionBy("id").orderBy("n"))).where("n % 2 = 0")
    rows = rows.withColumn("mid", F.shiftright(F.col("l") + F.col("r"), 1)).withColumn("side", F.col("l") - F.col("r"))
    whole = F.col("mid") * 2 + F.pmod("side", F.lit(2))
    left, right = F.shiftright(whole + F.col("side"), 1), F.shiftright(whole - F.col("side"), 1)
    return rows.groupBy("id").agg(F.sum(F.col("mid") * (F.col("n") + 1)).cast("long").alias("mid"), F.sum(F.col("side") * (F.col("n") + 1)).cast("long").alias("side"), F.bool_and((left == F.col("l")) & (right == F.col("r"))).alias("same"))


AUTO = f"select a.id, g.lag, sum(a.x * b.x) as r from ({LONG}) a cross join (select unnest(range(21)) as lag) g join ({LONG}) b on a.id = b.id and b.n = a.n + g.lag group by a.id, g.lag"


@query(f"select id, lag::int as lag, round(r, 5) as r from ({AUTO})")
def autocorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction.autocorrelation(views.frames_long(spark, sf_dir), 20).select("id", "lag", F.round("r", 5).alias("r"))


@query(f"select id, arg_max(lag, (r, -lag))::int as lag, round(max(r), 5) as r from ({AUTO}) where lag >= 4 group by id")
def pitch_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction.pitch(views.frames_long(spark, sf_dir), 4, 20).select("id", "lag", F.round("r", 5).alias("r"))


@query(f"""with a as ({AUTO}), p as (select id, max(r) filter (lag = 0) as r0, max(r) filter (lag = 1) as r1, max(r) filter (lag = 2) as r2 from a group by id),
  q as (select id, r0, r1, r2, r1 / r0 as k1, r0 * (1 - (r1 / r0) * (r1 / r0)) as e1 from p), s as (select *, (r2 - k1 * r1) / e1 as k2 from q)
  select id, round(k1 - k2 * k1, 5) as a1, round(k2, 5) as a2, round(e1 * (1 - k2 * k2), 5) as error from s""")
def lpc_levinson(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = prediction.autocorrelation(views.frames_long(spark, sf_dir), 2)
    lists = r.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "r"))), lambda s: s["r"]).alias("r"))
    found = lists.select("id", prediction.levinson(F.col("r"), 2).alias("s"))
    return found.select("id", F.round(F.get("s.a", F.lit(0)), 5).alias("a1"), F.round(F.get("s.a", F.lit(1)), 5).alias("a2"), F.round("s.error", 5).alias("error"))


@query(f"""select id, n::int as sub, least(greatest(trunc((20 * log10(greatest(sqrt(avg(x * x)), 1e-5)) + 60) / 2), 0), 31)::int as gain
  from (select id, n // 16 as n, x from ({LONG})) group by id, n""")
def subframe_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level of each subframe on a 5-bit scale of 2 dB."""
    level = 20 * F.log10(F.greatest(F.sqrt(F.avg(F.col("x") * F.col("x"))), F.lit(1e-5)))
    rows = views.frames_long(spark, sf_dir).groupBy("id", F.expr("n div 16").cast("int").alias("sub")).agg(level.alias("level"))
    return rows.select("id", "sub", F.least(F.greatest(((F.col("level") + 60) / 2).cast("int"), F.lit(0)), F.lit(31)).alias("gain"))


@query(f"""select id, len(y) as n, list_sum(list_transform(y, lambda v, i: v::bigint * i))::bigint as fingerprint from (
  select id, list_transform(range(96), lambda k: case when trunc(k * (2.0::double / 3))::int + 1 >= len(v) then 0
    else trunc(v[trunc(k * (2.0::double / 3))::int + 1] * (1 - (k * (2.0::double / 3) - trunc(k * (2.0::double / 3)))) + v[trunc(k * (2.0::double / 3))::int + 2] * (k * (2.0::double / 3) - trunc(k * (2.0::double / 3))))::int end) as y from ({PCM}))""")
def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.pcm(spark, sf_dir).select("id", signal.resample_linear(F.col("v"), 8000, 12000).alias("y"))
    weighted = F.aggregate(F.transform("y", lambda v, i: v.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    return rows.select("id", F.size("y").cast("long").alias("n"), weighted.alias("fingerprint"))


NUMBERED = f"select stream, row_number() over (partition by stream order by seq) - 1 as n, x from ({SERIES})"


def _numbered(spark, sf_dir):
    return views.series(spark, sf_dir).select("stream", (F.row_number().over(Window.partitionBy("stream").orderBy("seq")) - 1).cast("long").alias("n"), "x")


def _ola_sql(source: str, frame: int, hop_in: int, hop_out: int) -> str:
    return f"""with s as ({source}), e as (select stream, max(n) + 1 as size from s group by stream),
    f as (select stream, unnest(range(greatest(0, ceil((size - {frame}) / {hop_in}.0::double))::bigint)) as f from e)
    select f.stream, (f.f * {hop_out} + s.n - f.f * {hop_in})::bigint as n, round(sum(s.x * 0.5 * (1 - cos(2 * pi() * (s.n - f.f * {hop_in}) / {frame - 1}))), 5) as y
    from f join s on s.stream = f.stream and s.n >= f.f * {hop_in} and s.n < f.f * {hop_in} + {frame} group by all"""


@query(_ola_sql(NUMBERED, 16, 4, 2))
def ola_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stretch.change_speed(_numbered(spark, sf_dir), 1.6, 16).select("stream", "n", F.round("y", 5).alias("y"))


RATIO = stretch.ratio_of_semitones(5)
RESAMPLED = f"""select a.stream, k as n, a.x * (1 - (k * {RATIO!r}::double - a.n)) + coalesce(b.x, a.x) * (k * {RATIO!r}::double - a.n) as x from (
  select stream, unnest(range(floor(size / {RATIO!r}::double)::bigint)) as k from (select stream, max(n) + 1 as size from ({NUMBERED}) group by stream)) g
  join ({NUMBERED}) a on a.stream = g.stream and a.n = floor(g.k * {RATIO!r}::double)::bigint left join ({NUMBERED}) b on b.stream = a.stream and b.n = a.n + 1"""


@query(_ola_sql(RESAMPLED, 16, 4, 4))
def pitch_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stretch.shift_pitch(_numbered(spark, sf_dir), RATIO, 16).select("stream", "n", F.round("y", 5).alias("y"))


@query(f"""select id, round(sum(sign(q) * pow(abs(q)::double, 4.0::double / 3) * pow(2.0::double, (id % 9 - 4) / 4.0::double)) / 1000, 4) as total from (
  select id, unnest(v) // 256 as q from ({PCM})) group by id""")
def requantize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.pcm(spark, sf_dir).select("id", F.explode("v").alias("v")).withColumn("q", F.expr("v div 256"))
    return rows.groupBy("id").agg(F.round(F.sum(spectral.requantize(F.col("q"), F.col("id") % 9 - 4)) / 1000, 4).alias("total"))


def _mdct_sql(half: int) -> str:
    return f"""select id, k, sum(x * cos(pi() / {half} * (n + 0.5 + {half / 2}) * (k + 0.5))) * 2 / {half} as c
      from (select id, n, x * sin(pi() / 2 * pow(sin(pi() / {2 * half} * (n + 0.5)), 2)) as x from ({LONG}) where n < {2 * half}) cross join (select unnest(range({half})) as k) group by id, k"""


def _band_sql(half: int, bands: int) -> str:
    """Bands of the widths that the operator gives them, as a table, and their levels as codes."""
    rows, at = [], 0
    for b in range(bands):
        width = max(1, (b + 1) * half // bands - b * half // bands)
        rows.append((b, at, width))
        at += width
    values = ", ".join(map(str, rows))
    return f"""select id, string_agg(lpad(bin(q), 6, '0'), '' order by band) as s from (
      select id, band, case when coalesce(sum(c * c), 0) > 0 then least(greatest(trunc((20 * log10(sqrt(sum(c * c) / width)) + 28) * 2), 0), 63) else 0 end::int as q
      from (select distinct id from ({LONG})) i cross join (values {values}) b(band, low, width) left join ({_mdct_sql(half)}) m using (id) where m.k >= low and m.k < low + width group by id, band, width) group by id"""


@query(f"""select id, 'x' || md5(s || repeat('0', (case when len(s) % 8 = 0 then 0 else 8 - len(s) % 8 end)::int)) as digest, (1 + len(s || '') // 8 + case when len(s) % 8 > 0 then 1 else 0 end)::int as bytes from (select id, s || '00000' as s from ({_band_sql(32, 21)}))""")
def opus_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band levels of 6 bits as packed frames; the digest is of the bits after the first byte."""
    codes = spectral.band_codes(spectral.mdct(views.frames_long(spark, sf_dir), 32), 32)
    rows = codes.select("id", spectral.opus_frame(F.col("codes")).alias("b"))
    return rows.select("id", F.concat(F.lit("x"), F.md5(bits_of(F.substring("b", F.lit(2), F.octet_length("b"))))).alias("digest"), F.octet_length("b").alias("bytes"))


def _alias_sql() -> str:
    cosine, sine = ([f(c) for c in spectral.BUTTERFLIES] for f in (lambda c: 1 / math.sqrt(1 + c * c), lambda c: c / math.sqrt(1 + c * c)))
    return f"""with c as (select {cosine!r}::double[] as cs, {sine!r}::double[] as ca),
      l as (select id, n, x, n // 18 as band, n % 18 as p, 64 // 18 as bands from ({LONG})),
      b as (select id, n, x, p, case when p >= 10 and band + 1 < bands then 1 when p < 8 and band > 0 and band < bands then -1 else 0 end as side from l)
      select b.id, round(sum((b.n + 1) * case b.side when 1 then b.x * cs[18 - b.p] - o.x * ca[18 - b.p] when -1 then b.x * cs[b.p + 1] + o.x * ca[b.p + 1] else b.x end), 5) as weighted
      from b cross join c left join b o on o.id = b.id and o.n = b.n + case b.side when 1 then 2 * (17 - b.p) + 1 when -1 then -2 * b.p - 1 else 0 end group by b.id"""


@query(_alias_sql())
def mp3_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.frames(spark, sf_dir).select("id", spectral.reduce_alias(F.col("x")).alias("y"))
    return rows.select("id", F.round(F.aggregate(F.transform("y", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v), 5).alias("weighted"))


@query(" union all ".join(f"""select {half} as half, id, round(sum(y * y), 5) as energy, round(sum(y * (n + 1)), 5) as weighted from (
  select id, n, sum(x * cos(pi() / {4 * half} * (2 * n + 1 + {half}) * (2 * k + 1))) as y from (select id, n as k, x from ({LONG}) where n < {half}) cross join (select unnest(range({2 * half})) as n) group by id, n) group by id""" for half in (18, 6)))
def mp3_imdct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long and short blocks of a frame's first lines."""
    lines = views.frames_long(spark, sf_dir).select("id", F.col("n").alias("k"), F.col("x").alias("c"))
    each = [spectral.plain_imdct(lines.where(F.col("k") < half), half).withColumn("half", F.lit(half)) for half in (18, 6)]
    return each[0].union(each[1]).groupBy("half", "id").agg(F.round(F.sum(F.col("y") * F.col("y")), 5).alias("energy"), F.round(F.sum(F.col("y") * (F.col("n") + 1)), 5).alias("weighted"))


@query(f"""select id, round(sum((n + 1) * (m + s)), 6) as aac_left, round(sum((n + 1) * (m - s)), 6) as aac_right, round(sum((n + 1) * (m + s) / sqrt(2)), 6) as mp3_left, round(sum((n + 1) * (m - s) / sqrt(2)), 6) as mp3_right
  from (select a.id, a.n, a.x as m, b.x as s from ({LONG}) a join ({LONG}) b on a.id = b.id and b.n = a.n + 32 where a.n < 32) group by id""")
def mid_side_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of a frame as mid and the second as side lines, to left and right ones: as they are, and over the root of 2."""
    rows = views.frames(spark, sf_dir).select("id", F.slice("x", 1, 32).alias("m"), F.slice("x", 33, 32).alias("s"))
    weigh = lambda v: F.round(F.aggregate(F.transform(v, lambda y, i: y * (i + 1)), F.lit(0.0), lambda a, y: a + y), 6)
    names = [(kind, scale) for kind, scale in (("aac", 1.0), ("mp3", math.sqrt(0.5)))]
    made = [weigh(side).alias(f"{kind}_{name}") for kind, scale in names for name, side in zip(("left", "right"), spectral.left_right(F.col("m"), F.col("s"), scale), strict=True)]
    return rows.select("id", *made)


LPC = f"""with a as ({AUTO}), p as (select id, max(r) filter (lag = 0) as r0, max(r) filter (lag = 1) as r1, max(r) filter (lag = 2) as r2 from a group by id),
  q as (select id, r0, r1, r2, r1 / r0 as k1, r0 * (1 - (r1 / r0) * (r1 / r0)) as e1 from p), s as (select *, (r2 - k1 * r1) / e1 as k2 from q)
  select id, k1 - k2 * k1 as a1, k2 as a2 from s"""


@query(f"""with x as (select id, n, x from ({LONG})),
  r as (select id, n, n // 16 as part, case when n < 2 then 0 else x - (a1 * lag(x, 1) over w + a2 * lag(x, 2) over w) end as r from x join ({LPC}) using (id) window w as (partition by id order by n)),
  g as (select id, part, least(greatest(trunc(20 * log10(greatest(sqrt(sum(r * r) / 16), 1e-6)) + 20), 0), 31)::int as gain,
    string_agg(case when abs(r) > 0.05 then '01' || case when r > 0 then '1' else '0' end || lpad(bin(least(trunc(abs(r) * 3), 3)::int), 2, '0') else '00' end, '' order by n) as heard from r group by id, part),
  c as (select u.id, u.n // 16 as part, d, sum(u.x * v.x) as r from x u cross join (select unnest(range(4, 41)) as d) join x v on v.id = u.id and v.n = u.n - d where d <= u.n // 16 * 16 group by all),
  l as (select id, part, case when max(r) > 0 then arg_max(d, (r, -d)) else 4 end as lag from c group by id, part)
  select id, len(b) + (8 - len(b) % 8) % 8 as bits, md5(b || repeat('0', ((8 - len(b) % 8) % 8)::int)) as digest from (
    select g.id, '{int(1 / 3 * 63 + 0.5):06b}{int(2 / 3 * 63 + 0.5):06b}' || string_agg(lpad(bin(gain), 5, '0') || lpad(bin((coalesce(lag, 4) - 4)::int), 7, '0') || '0100' || heard, '' order by g.part) as b from g left join l on l.id = g.id and l.part = g.part group by g.id)""")
def speex_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of four parts of 16 samples under predictors of order 2, as packed bits."""
    auto = prediction.autocorrelation(views.frames_long(spark, sf_dir), 2).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "r"))), lambda s: s["r"]).alias("r"))
    rows = views.frames(spark, sf_dir).join(auto.select("id", prediction.levinson(F.col("r"), 2)["a"].alias("a")), "id")
    b = rows.select("id", bits_of(prediction.coded_frame(F.col("x"), F.col("a"), 2, 16, 4, 4, 40)).alias("b"))
    return b.select("id", F.length("b").cast("long").alias("bits"), F.md5("b").alias("digest"))


GRANULES = f"select stream, n // 576 as g, n % 576 // 18 as band, n % 18 as k, x, (n // 576 % 4)::int as kind from ({STREAMS})"


@query(f"""with l as ({GRANULES}), i as (select unnest(range(36)) as i),
  w as (select kind, i, case when kind = 1 then case when i < 18 then sin(pi() / 36 * (i + 0.5)) when i < 24 then 1 when i < 30 then sin(pi() / 12 * (i - 18 + 0.5)) else 0 end
    when kind = 3 then case when i < 6 then 0 when i < 12 then sin(pi() / 12 * (i - 6 + 0.5)) when i < 18 then 1 else sin(pi() / 36 * (i + 0.5)) end else sin(pi() / 36 * (i + 0.5)) end as w from i cross join (values (0), (1), (3)) t(kind)),
  z as (select stream, g, band, i, sum(x * cos(pi() / 72 * ((2 * i + 19) * (2 * k + 1))) * w) as z from l join w using (kind) group by all
    union all select stream, g, band, i, sum(x * cos(pi() / 24 * ((2 * (i - 6 - 6 * (k % 3)) + 7) * (2 * (k // 3) + 1))) * sin(pi() / 12 * (i - 6 - 6 * (k % 3) + 0.5))) from l join i on i >= 6 + 6 * (k % 3) and i < 18 + 6 * (k % 3) where kind = 2 group by all),
  s as (select stream, g * 18 + i as t, band, sum(z) * case when band % 2 = 1 and i % 2 = 1 then -1 else 1 end as s from (
      select stream, g, band, i, z from z where i < 18 union all select stream, g + 1, band, i - 18, z from z where i >= 18) where (stream, g) in (select (stream, g) from l) group by stream, g, i, band),
  v as (select stream, t, n, sum(s * cos(pi() / 64 * ((n + 16) * (2 * band + 1)))) as v from s cross join (select unnest(range(64)) as n) group by all),
  y as (select v.stream, v.t + d as t, n % 32 as j, sum(v * sin(pi() / 512 * (n % 32 + 32 * d + 0.5))) as y from v cross join (select unnest(range(16)) as d) where (d % 2 = 0) = (n < 32) and (v.stream, v.t + d) in (select (stream, t) from s) group by all)
  select stream, t // 18 as granule, round(sum(y * y), 3) as energy, round(sum(y * ((t % 18) * 32 + j + 1)) / 576, 4) as weighted from y group by stream, t // 18""")
def mp3_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of granules of all four kinds of blocks, to samples; overlaps and the filter's past go on from granule to granule."""
    rows = blocks.frames(_streams(spark, sf_dir), 576).select("stream", F.col("frame").alias("granule"), (F.col("frame") % 4).cast("int").alias("kind"), F.col("x").alias("lines"))
    y = granules.synthesis(granules.subbands(rows))
    weighted = F.aggregate(F.transform("y", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v) / 576
    return y.select("stream", "granule", F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + v * v), 3).alias("energy"), F.round(weighted, 4).alias("weighted"))
