"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, the source's target over its size. Within
the source documents are put in an order, the expected copies are summed along it, one random offset is added,
and a document is emitted once for each integer that the sum crosses in it. The order goes by size, so the
sampled documents have sizes like the source's, and the words taken stay within about the size of one document
of the target.

The running sums are two-level: within (source, slot), a slot being a narrow band of sizes cut by a hash of
doc_id into 64, and over the totals of the slots of a source. No task holds a whole source, and all is a
function of the rows: a rerun, or a retried task, gives the same copies.

Defined cases: a null text has size 0; documents of size 0 are never taken; a null source is a source of its
own, the last; rows that are alike (repeated doc_id) are counted apart. Only doc_id, text and source are read, other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxtone.llm.common import row_hash, stored

WORD = "[^\\x20\\x09-\\x0D]+"


def targets(totals: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Water filling over (source, source_size): adds target.

    Sources in code point order, null last, have the weights in turn. Targets are in proportion to weight but
    end at ``most`` times a source's size; what they lose goes to the others by weight. So a target is the
    smaller of its cap and weight * level; sources with the least cap per weight reach their cap first.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = totals.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    # one row per source: a dimension
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = rows.withColumn("level", (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the first source in this order that keeps below its cap sets the level for all
    free = F.min(F.when(F.col("weight") * F.col("level") < F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "level"))).over(everything)
    return filled.withColumn("free", free["level"]).select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("free")), F.col("cap")).alias("target"))


def _unit(column: F.Column) -> F.Column:
    """A number in [0, 1) from the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(column.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def copies(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies."""
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    rows = rows.withColumn("mark", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    digits = F.length(F.bin("size"))
    band = F.when(F.col("size") < 16, F.col("size")).otherwise(digits * 8 + F.expr("shiftright(size, cast(length(bin(size)) - 4 as int))") % 8)
    rows = rows.withColumn("slot", F.concat(F.lpad(band.cast("string"), 4, "0"), F.substring("mark", 1, 1), F.conv(F.substring("mark", 2, 1), 16, 4).substr(1, 1)))
    rows = stored(rows, "sizes")  # every text is read once
    spots = rows.groupBy("source", "slot").agg(F.count("*").alias("docs"), F.sum("size").alias("size"))
    ahead = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    spots = spots.withColumn("ahead", F.coalesce(F.sum("docs").over(ahead), F.lit(0)))
    goal = targets(spots.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    goal = goal.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    goal = goal.withColumn("offset", _unit(F.concat(F.coalesce("source", F.lit("")), F.lit(f"|{seed}"))))
    plan = spots.select(F.col("source").alias("s"), F.col("slot").alias("l"), "ahead").join(goal.withColumnRenamed("source", "t"), F.col("s").eqNullSafe(F.col("t")))
    own = F.row_number().over(Window.partitionBy("source", "slot").orderBy("size", "mark", "doc_id"))
    placed = rows.withColumn("own", own).join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("slot") == F.col("l")))
    turn = F.col("ahead") + F.col("own")
    crossed = F.floor(F.col("offset") + turn * F.col("rate")) - F.floor(F.col("offset") + (turn - 1) * F.col("rate"))
    return placed.select("doc_id", "source", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes of it)."""
    return copies(docs, **how).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with all their columns.

    Rows that share doc_id, source and size are given the copies in turn, in order of a hash of the whole row: a
    retried task gives each the same number again. Rows that are alike in all columns are interchangeable.
    """
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    # one key without nulls for the windows and the join, so that whole rows are shuffled once
    key = lambda i, s, z: F.concat_ws(" ", F.col(z), F.coalesce(F.col(i).cast("string"), F.lit("-")), F.concat(F.lit("s"), F.col(s))).alias("key")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("i"), F.col("source").cast("string").alias("s"), size.alias("z")).select("row", key("i", "s", "z"))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("key").orderBy(row_hash(docs, "row"))))
    # rows of one key have copies that differ by one at most
    taken = copies(docs, **how).select("copies", key("doc_id", "source", "size")).groupBy("key").agg(F.sum("copies").alias("total"), F.count("*").alias("n")).where("total > 0")
    each = F.expr("cast(total div n + if(turn <= total % n, 1, 0) as int)")
    met = rows.join(taken, "key").select("row", each.alias("copies")).where("copies > 0")
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


ORACLE = """
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
         md5(coalesce(doc_id::varchar, '')) as mark from documents),
s as (
  select *, lpad((case when size < 16 then size else length(bin(size)) * 8 + (size >> (length(bin(size)) - 4)::int) % 8 end)::varchar, 4, '0')
            || substr(mark, 1, 1) || case when ('0x' || substr(mark, 2, 1))::int < 4 then ('0x' || substr(mark, 2, 1))::int else ('0x' || substr(mark, 2, 1))::int // 4 end as slot from d),
r as (
  select *, row_number() over (partition by source order by slot, size, mark, doc_id) as turn from s),
t as (
  select *, [3.0, 1.0, 2.0]::double[] as w from (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place from d group by source)),
c as (
  select source, source_size, w[(place % 3 + 1)::int] as weight, 2.0::double * source_size as cap from t),
f as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over o, 0)) / (sum(weight) over () - coalesce(sum(weight) over o, 0)) as level
  from c window o as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
g as (
  select *, (select arg_min(level, cap / weight) from f where weight * level < cap) as free from f),
h as (
  select source, source_size, coalesce(least(cap, weight * free), cap) as target,
         ('0x' || substr(md5(coalesce(source, '') || '|mix'), 1, 8))::bigint / 4294967296.0::double as off from g),
k as (
  select r.doc_id, r.size, h.source_size, h.target, r.turn, h.off,
         case when h.source_size > 0 then h.target / h.source_size else 0.0 end as rate
  from r join h on r.source is not distinct from h.source)
select doc_id, size, source_size, target,
       size * (floor(off + turn * rate) - floor(off + (turn - 1) * rate))::bigint as taken,
       (floor(off + turn * rate) - floor(off + (turn - 1) * rate))::bigint as copies
from k
"""
