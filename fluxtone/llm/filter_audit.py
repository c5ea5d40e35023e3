"""Filter interaction audit: what five filters take away from each other, in every order they can be applied in.

Failure conditions of a text (null: empty; words are maximal runs of characters other than 0x20 and 0x09-0x0D):
A under 100 words; B 100 * distinct words < 80 * words; C 100 * A-Z characters > 10 * code points; D any of
``#$%&*|``; E identical to the text of a smaller doc_id, anywhere in the table.

E comes from partition refinement:

1. A pass over the texts gives each document its code-point length and the hashes of successive blocks, the first
   of ``FIRST`` code points, each next one ``GROWTH`` times as long, so a text of any length has some ten at most.
2. Classes are split by length, then by one more block hash at a time. After each split the documents that are
   alone in their class drop out. They are found by the least doc_id of a class of one, so what is joined is
   keyed by (class, doc_id), and a class that holds a third of all rows is spread over all tasks.
3. The whole texts of the documents left over are read again and compared: grouping by (class, text) combines in
   each task first. In every group of equal texts the rows of the least doc_id pass and the others fail. Where
   texts that differ still share a class (their hashes collide), rows find their group by text instead.

A document's failures are a mask of five bits. Counts by (part, mask) are all that is left of the documents; the
120 orders of five steps are evaluated on the 32 counts of a part.

Defined cases: a row without doc_id never fails E and makes no other row fail; repeated rows of one doc_id don't
make each other fail; the part of a null lang is the empty string; a document is good (toxic) if any row of labels
for its doc_id says so; an empty table has no parts. Only doc_id, text and lang, and doc_id, quality and toxic of
the labels are read, other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxtone.llm.common import drop_stored, small_batches, stored
from fluxtone.llm.textops import parts

FIRST, GROWTH = 128, 8
LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")
UPPER = bytes(range(65, 91))
MARKS = b"#$%&*|"
#: Rows without doc_id are spread over so many tasks when labels are looked up.
SPREAD = 64
FACTS = "doc_id long, part string, mask int, points long, blocks array<long>"


def block_hash(piece: str) -> int:
    return int.from_bytes(blake2b(piece.encode(), digest_size=8).digest(), "little", signed=True)


def blocks(text: str, hasher: Callable[[str], int] = block_hash) -> list[int]:
    """Hashes of a text's successive blocks; equally long texts have equally many."""
    found, at, size = [], 0, FIRST
    while at < len(text):
        found.append(hasher(text[at : at + size]))
        at, size = at + size, size * GROWTH
    return found


def mask_of(data: bytes, points: int) -> int:
    """The bits of A to D for a text in UTF-8 of so many code points."""
    words = data.split()  # bytes split at 0x20 and 0x09-0x0D
    failed = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * (len(data) - len(data.translate(None, UPPER))) > 10 * points, len(data.translate(None, MARKS)) < len(data))
    return sum(1 << i for i, x in enumerate(failed) if x)


def facts(docs: DataFrame, hasher: Callable[[str], int] = block_hash, with_text: bool = False) -> DataFrame:
    """doc_id, part, mask (A to D), points, blocks of every row, and its text if that is wanted."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in parts(batch.column("text")):
                rest = batch.slice(first, len(texts))
                whole = [x.decode() for x in texts]
                columns = [rest.column("doc_id"), rest.column("part"), pa.array([mask_of(x, len(t)) for x, t in zip(texts, whole, strict=True)], pa.int32()), pa.array([len(t) for t in whole], pa.int64()), pa.array([blocks(t, hasher) for t in whole], pa.list_(pa.int64()))]
                names = ["doc_id", "part", "mask", "points", "blocks"]
                yield pa.RecordBatch.from_arrays([*columns, rest.column("text")] if with_text else columns, [*names, "text"] if with_text else names)

    return rows.mapInArrow(each, FACTS + ", text string" if with_text else FACTS)


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good and toxic (0 or 1)."""
    yes = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(yes("quality").alias("good"), yes("toxic").alias("toxic")).withColumn("_turn", F.lit(0))
    turn = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("points", "blocks"), F.lit(SPREAD)) + 1).otherwise(0).cast("int")
    met = rows.withColumn("_id", F.coalesce("doc_id", F.lit(0))).withColumn("_turn", turn).join(known, ["_id", "_turn"], "left")
    return met.select(*rows.columns, F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def _class(depth: F.Column) -> F.Column:
    return F.xxhash64("points", F.slice("blocks", F.lit(1), depth))


def refined(rows: DataFrame) -> DataFrame:
    """The rows of ``facts`` that share length and all block hashes with another, with their class: a written table."""
    live, depth, deepest = rows.where("doc_id is not null"), 0, 1
    while depth <= deepest:  # no more than the blocks of the longest text that is left
        live = live.withColumn("class", _class(F.lit(depth)))
        alone = live.groupBy("class").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1").select("class", "doc_id")
        left = stored(live.join(alone, ["class", "doc_id"], "left_anti"), "classes")
        if depth:
            drop_stored(last)
        live = last = left
        deepest = live.agg(F.max(F.size("blocks"))).first()[0] or 0
        depth += 1
    return live


def failing_copies(docs: DataFrame, rows: DataFrame, labels: DataFrame, hasher: Callable[[str], int] = block_hash) -> DataFrame:
    """Of ``rows``, the labelled facts of ``docs``, those that fail E."""
    live = refined(rows)
    # the whole texts of what is left, by doc_id; classed anew, since rows of one doc_id can have many texts
    texts = docs.withColumn("_id", F.col("doc_id").cast("long")).join(live.select(F.col("doc_id").alias("_id")).distinct(), "_id", "left_semi").drop("_id")
    texts = facts(texts, hasher, with_text=True).withColumn("class", _class(F.size("blocks")))
    groups = stored(texts.groupBy("class", "text").agg(F.min("doc_id").alias("doc_id")).select("class", "doc_id"), "groups")
    failing = live.join(groups, ["class", "doc_id"], "left_anti")
    torn = groups.groupBy("class").agg(F.count("*").alias("texts")).where("texts > 1").select("class")
    if torn.limit(1).count():  # texts that differ share all block hashes
        those = stored(labelled(texts.join(torn, "class", "left_semi"), labels), "torn")
        least = those.groupBy("class", "text").agg(F.min("doc_id").alias("least"))
        more = those.join(least, ["class", "text"]).where("doc_id > least")
        failing = failing.join(torn, "class", "left_anti").select(rows.columns).unionByName(more.select(rows.columns))
    return failing.select(rows.columns)


def masks(docs: DataFrame, labels: DataFrame, hasher: Callable[[str], int] = block_hash) -> DataFrame:
    """part, mask (bits of A to E), docs, good, toxic: how many documents fail just these filters."""
    rows = stored(labelled(facts(docs, hasher), labels), "facts")
    count = lambda df, by, sign: df.groupBy("part", (F.col("mask") + by).alias("mask")).agg((sign * F.count("*")).alias("docs"), (sign * F.sum("good")).alias("good"), (sign * F.sum("toxic")).alias("toxic"))
    copies = count(failing_copies(docs, rows, labels, hasher), 0, 1)
    copies = stored(copies, "copies")  # a row for each part and mask
    minus = copies.select("part", "mask", *[(-F.col(c)).alias(c) for c in ("docs", "good", "toxic")])
    cells = count(rows, 0, 1).union(minus).union(copies.withColumn("mask", F.col("mask") + COPY))
    return cells.groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(c) for c in ("docs", "good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame, hasher: Callable[[str], int] = block_hash) -> DataFrame:
    """One row per part, order of the filters and step: filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    In all orders of the filters each of a document's failing ones comes first of them equally often, so a document
    that fails n filters adds 1/n of the orders to the ``shapley`` of each.
    """
    cells = masks(docs, labels, hasher)
    every, n = range(1 << len(LETTERS)), len(LETTERS)
    cube = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in every]).alias(c)
    orders = list(permutations(range(n)))
    # what each step asks of the masks: own bit, bits of the steps before
    steps = F.array(*[F.struct(F.lit("".join(LETTERS[i] for i in o)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(1 << o[k]).alias("own"), F.lit(sum(1 << i for i in o[:k])).alias("before")) for o in orders for k in range(n)])
    rows = cells.groupBy("part").agg(cube("docs"), cube("good"), cube("toxic")).withColumn("s", F.explode(steps)).select("part", "s.*", "docs", "good", "toxic")
    own, before, masked = F.col("own"), F.col("before"), F.array(*[F.lit(m) for m in every])

    def over(counts: str, want, weight=lambda m: F.lit(1)) -> F.Column:
        found = F.zip_with(F.col(counts), masked, lambda x, m: F.when(want(m), x * weight(m)).otherwise(F.lit(0)))
        return F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x)

    fails, gone = lambda m: m.bitwiseAND(own) != 0, lambda m: m.bitwiseAND(before) != 0
    removed = lambda m: fails(m) & ~gone(m)
    return rows.select(
        "part", "filter_order", "step",
        over("docs", lambda m: ~fails(m) & ~gone(m)).alias("kept"), over("docs", removed).alias("removed"), over("docs", lambda m: fails(m) & gone(m)).alias("redundant"),
        over("docs", lambda m: m == own).alias("unique_fails"), over("good", removed).alias("good_lost"), over("toxic", removed).alias("toxic_lost"),
        over("docs", fails, lambda m: (F.lit(len(orders)) / F.bit_count(m)).cast("long")).alias("shapley"),
    )


ORACLE = """
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (
  select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws, min(doc_id) over (partition by t) as least from d),
m as (
  select doc_id, part,
         (len(ws) < 100)::int + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::int
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::int
         + 8 * (regexp_matches(t, '[#$%&*|]'))::int + 16 * coalesce(doc_id > least, false)::int as mask from w),
c as (
  select part, mask, count(*) as n, sum((doc_id in (select doc_id from labels where quality = 1))::int) as good,
         sum((doc_id in (select doc_id from labels where toxic = 1))::int) as toxic from m group by all),
l(x, b) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o as (
  select p.x || q.x || r.x || s.x || t.x as filter_order, [p.b, q.b, r.b, s.b, t.b] as bits
  from l p, l q, l r, l s, l t where p.b + q.b + r.b + s.b + t.b = 31 and (p.b | q.b | r.b | s.b | t.b) = 31),
k as (
  select filter_order, step::int as step, bits[step] as own, list_sum(bits[1:step - 1])::int as before from o, range(1, 6) g(step)),
r as (
  select part, filter_order, step, own,
         coalesce(sum(n) filter (mask & (own | coalesce(before, 0)) = 0), 0)::bigint as kept,
         coalesce(sum(n) filter (mask & own <> 0 and mask & coalesce(before, 0) = 0), 0)::bigint as removed,
         coalesce(sum(n) filter (mask & own <> 0 and mask & coalesce(before, 0) <> 0), 0)::bigint as redundant,
         coalesce(sum(n) filter (mask = own), 0)::bigint as unique_fails,
         coalesce(sum(good) filter (mask & own <> 0 and mask & coalesce(before, 0) = 0), 0)::bigint as good_lost,
         coalesce(sum(toxic) filter (mask & own <> 0 and mask & coalesce(before, 0) = 0), 0)::bigint as toxic_lost
  from c, k group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, own))::bigint as shapley
from r
"""
