"""Queries over lossless frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxtone.functions import flac
from fluxtone.operators import lossless
from fluxtone.operators.containers import join_chunks
from fluxtone.plans import views
from fluxtone.plans.oracle import CORRELATED, PCM, registry

QUERIES, ORACLE, query = registry()

MOST = max(flac.ORDERS)
CORRELATED_LISTS = f"select id, list(v order by n) as v from ({CORRELATED}) group by id"
PCM_LISTS = f"select id, list_transform(v, lambda x: x::bigint) as v from ({PCM})"
RICE = "list_min(list_transform(range(0, 15), lambda k: coalesce(list_sum(list_transform({0}, lambda z: z >> k)), 0)::bigint + len({0}) * (k + 1)))"


def subframe_sizes(source: str) -> str:
    """id, kind, low, halvings, bits of the chosen subframe of each row (id, v list) of ``source``; samples have 16 bits."""
    fixed = ", ".join(f"({flac.FIX + o}, [{', '.join(map(str, w))}]::bigint[])" for o, w in flac.FIXED.items())
    return f"""with recursive b0 as ({source}),
  b1 as (select id, v, len(v) as n, list_reduce(v, lambda a, b: a | b) as e from b0),
  b as (select id, n, 16 - low as own, low, list_transform(v, lambda x: x >> low) as s from (select *, case when e = 0 then 0 else bit_count(xor(e, e - 1)) - 1 end::int as low from b1)),
  r as (select id, list_transform(range(0, {MOST + 1}), lambda lag: case when n > lag then list_sum(list_transform(range(1, n - lag + 1), lambda i: s[i] * s[i + lag])) else 0 end::double) as r from b),
  l as (select id, 0 as m, []::double[] as a, r[1] as e from r
    union all select id, m + 1, list_append(list_transform(range(1, m + 1), lambda j: a[j] - k * a[m + 1 - j]), k), e * (1 - k * k) from (
      select l.*, case when e > 0 then (r[m + 2] - list_reduce(list_prepend(0.0::double, list_transform(range(1, m + 1), lambda j: a[j] * r[m + 2 - j])), lambda x, y: x + y)) / e else 0.0 end as k from l join r using (id) where m < {MOST})),
  f as (select id, m, a, list_max(list_filter(range(0, 16), lambda t: list_max(list_transform(a, lambda w: abs(w))) * (1 << t) <= {(1 << (flac.PRECISION - 1)) - 1})) as shift from l where m in {flac.ORDERS}),
  q as (select id, {flac.LPC} + m as kind, list_transform(a, lambda w: floor(w * (1 << shift) + 0.5)::bigint) as q, shift from f where shift is not null
    union all select id, kind, q, 0 from b cross join (values (0, []::bigint[]), (1, []::bigint[]), {fixed}) t(kind, q)),
  o as (select id, kind, n, own, low, len(q) as ord, s,
      case when kind < 8 then []::bigint[] else list_transform(range(len(q) + 1, n + 1), lambda i: s[i] - (coalesce(list_sum(list_transform(range(1, len(q) + 1), lambda j: q[j] * s[i - j])), 0)::bigint >> shift)) end as e
    from q join b using (id) where len(q) < n and (kind <> 0 or len(list_distinct(s)) = 1)),
  z as (select *, list_transform(e, lambda x: case when x >= 0 then 2 * x else -2 * x - 1 end) as z, 8 + low + case kind when 0 then 1 when 1 then n else ord end * own + case when kind > 31 then 9 + ord * {flac.PRECISION} else 0 end as plain from o),
  t as (select *, plain + case when kind >= 8 then 10 + {RICE.format("z")} else 0 end as bits from z),
  c as (select id, arg_min({{'kind': kind, 'n': n, 'low': low, 'ord': ord, 'z': z, 'plain': plain}}, (bits, kind)) as c from t group by id),
  p as (select id, c.kind, c.low, c.plain, h, case when c.kind >= 8 then 6 + list_sum(list_transform(range(0, 1 << h), lambda j: 4 + {RICE.format("c.z[greatest((c.n >> h) * j - c.ord, 0) + 1 : (c.n >> h) * (j + 1) - c.ord]")})) else 0 end::bigint as rest
    from c cross join (select unnest(range(0, {flac.HALVINGS + 1}))::int as h) where h = 0 or (c.kind >= 8 and c.n % (1 << h) = 0 and c.n >> h > c.ord))
  select id, any_value(kind)::int as kind, any_value(low)::int as low, arg_min(h, (rest, h))::int as halvings, (any_value(plain) + min(rest))::bigint as bits from p group by id"""


def _lists(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "v"))).alias("l")).select("id", F.col("l.v").alias("v"))


def _pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pcm(spark, sf_dir).select("id", F.col("v").cast("array<bigint>").alias("v"))


@query(f"select 'pcm' as signal, * from ({subframe_sizes(PCM_LISTS)}) union all select 'correlated', * from ({subframe_sizes(CORRELATED_LISTS)})")
def flac_subframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, wasted bits, partitions and size of each block's subframe, with predictors up to order 32."""
    own, smooth = _pcm(spark, sf_dir).withColumn("signal", F.lit("pcm")), _lists(views.correlated(spark, sf_dir)).withColumn("signal", F.lit("correlated"))
    found = lossless.subframes(own.unionByName(smooth).withColumn("width", F.lit(16)), ["signal", "id"])
    return found.select("signal", "id", "kind", "low", "halvings", F.length("digits").cast("long").alias("bits"))


NUMBERED = "case when id < 128 then 1 when id < 2048 then 2 when id < 65536 then 3 when id < 2097152 then 4 else 5 end"
FRAME_SIZES = f"select id, 4 + {NUMBERED} + 1 + 1 + (bits + 7) // 8 + 2 as size from ({subframe_sizes(CORRELATED_LISTS)})"


@query(f"select id, size::bigint as size, id as number, n, weighted from ({FRAME_SIZES}) join (select id, count(*) as n, sum(v * (n + 1))::bigint as weighted from ({CORRELATED}) group by id) using (id)")
def flac_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of one channel, and the samples read back from their bytes."""
    rows = _lists(views.correlated(spark, sf_dir)).select("id", F.col("id").alias("number"), F.array("v").alias("v"))
    coded = lossless.frames(rows).select("id", F.lit(0).alias("k"), "b")
    sizes = coded.select("id", F.octet_length("b").cast("long").alias("size"), "k", "b")
    back = lossless.read_frames(sizes.select("id", F.col("size").alias("k"), "b"), channels=1)
    weighted = F.aggregate(F.transform(F.get("v", F.lit(0)), lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    return back.select("id", F.col("k").alias("size"), "number", F.col("n").cast("long").alias("n"), weighted.alias("weighted"))


@query(f"""select id, sum(case when i % 2 = 0 then v * (i + 1) else 0 end)::bigint as l, sum(case when i % 2 = 1 then v * (i + 1) else 0 end)::bigint as r, true as smaller
  from (select id, unnest(v) as v, generate_subscripts(v, 1) - 1 as i from ({PCM})) group by id""")
def flac_stereo_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of two channels, the samples of pairs, read back; none is larger than its two channels as they are."""
    side = lambda k: F.filter("v", lambda _, i: i % 2 == k)
    rows = _pcm(spark, sf_dir).select("id", (F.col("id") * 1000).alias("number"), F.array(side(0), side(1)).alias("v"))
    coded = lossless.frames(rows)
    back = lossless.read_frames(coded.select("id", F.octet_length("b").alias("k"), "b"))
    total = lambda c: F.aggregate(F.transform(F.get("v", F.lit(c)), lambda v, i: v * (2 * i + 1 + c)), F.lit(0).cast("long"), lambda a, v: a + v)
    return back.select("id", total(0).alias("l"), total(1).alias("r"), (F.col("k") <= 4 * F.col("n") + 2 + 14).alias("smaller"))


GROUP = 20
BEGIN = "select doc_id as file, strlen(coalesce(text, '')) + 2 as junk from documents"


@query(f"""with s as (select *, id // {GROUP} as file from ({FRAME_SIZES})), k as (select *, row_number() over (partition by file order by id) - 1 as k, coalesce(sum(size) over (partition by file order by id rows between unbounded preceding and 1 preceding), 0) as before from s)
  select file, k::int as k, (coalesce(junk, 2) + before)::int as start, size::int as size, id as number, weighted from k left join ({BEGIN}) using (file)
  join (select id, sum(v * (n + 1))::bigint as weighted from ({CORRELATED}) group by id) using (id)""")
def flac_frame_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of frames after a text that begins with a false mark: the frames found, and their samples."""
    rows = _lists(views.correlated(spark, sf_dir)).select("id", F.col("id").alias("number"), F.array("v").alias("v"))
    coded = lossless.frames(rows).select(F.expr(f"id div {GROUP}").alias("id"), F.col("number").alias("k"), F.col("b").alias("payload"))
    junk = views.payload(spark, sf_dir).select("id", F.concat(F.lit(b"\xff\xf8"), F.coalesce("b", F.lit(b""))).alias("junk"))
    files = join_chunks(coded).join(junk, "id", "left").select("id", F.concat(F.coalesce("junk", F.lit(b"\xff\xf8")), "b").alias("b"))
    spans = lossless.frame_spans(files)
    key = F.struct("k", "start", F.octet_length("b").alias("size"))
    back = lossless.read_frames(spans.select("id", key.alias("k"), "b"), channels=1)
    weighted = F.aggregate(F.transform(F.get("v", F.lit(0)), lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    return back.select(F.col("id").alias("file"), "k.k", "k.start", "k.size", "number", weighted.alias("weighted"))
