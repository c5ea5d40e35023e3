"""Sharding: longest-processing-time scheduling of groups that must stay together (law ``bytes``).

Groups are documents with equal texts. Sorted by size, the largest first, each goes to the shard with the
least load so far, kept in a heap. A heap needs all its items in one place, so their number is bounded:
a group larger than 1 / (``shards`` * ``FINE``) of all bytes is an item of its own, and there can be no more
than ``shards`` * ``FINE`` of those; all smaller groups are dealt by a hash of their text into
``shards`` * ``FINE`` bundles, which are the other items. So the driver schedules at most 2 * ``shards`` * ``FINE``
items whatever the input, and bundles are so small that loads end up near equal.

A group that is larger than a fair share stays whole, and its shard is larger then; that follows from the
rule that groups stay together.

Slots number the documents of a shard from 0: by a hash bucket of doc_id, then within it, so that no task
holds a whole shard.

Defined cases: a null text is in the group of empty ones, its size is ``OVERHEAD`` bytes; repeated rows count
each; an empty table gives no row. Only doc_id and text are read, other columns may have any name.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxtone.llm.common import stored

OVERHEAD = 16
FINE = 256
SLOT_BUCKETS = 1024


def longest_first(sizes: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Item to shard: items by size, the largest first, each to the least loaded shard; ties by name and number."""
    loads, placed = [(0, s) for s in range(shards)], {}
    for size, item in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, shard = loads[0]
        placed[item] = shard
        heapq.heapreplace(loads, (load + size, shard))
    return placed


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    group = F.sha2(raw, 256)
    bundle = F.concat(F.lit("bundle "), F.pmod(F.xxhash64("group"), F.lit(shards * FINE)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), group.alias("group"))
    rows = stored(rows.withColumn("bundle", bundle), "sizes")
    groups = stored(rows.groupBy("group", "bundle").agg(F.sum("size").alias("size")), "groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    large = groups.where(F.col("size") * (shards * FINE) > total)
    small = groups.where(F.col("size") * (shards * FINE) <= total).groupBy("bundle").agg(F.sum("size").alias("size"))
    # at most shards * FINE rows each
    items = [(r.size, r.item) for r in large.select("size", F.col("group").alias("item")).union(small.select("size", F.col("bundle").alias("item"))).toLocalIterator()]
    placed = longest_first(items, shards)
    places = spark.createDataFrame(list(placed.items()), "item string, shard int")
    own = F.broadcast(places.where("item not like 'bundle %'").select(F.col("item").alias("group"), F.col("shard").alias("own")))
    rest = F.broadcast(places.where("item like 'bundle %'").select(F.col("item").alias("bundle"), F.col("shard").alias("rest")))
    found = rows.join(own, "group", "left").join(rest, "bundle", "left").withColumn("shard", F.coalesce("own", "rest"))
    found = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLOT_BUCKETS)))
    counts = found.groupBy("shard", "bucket").agg(F.count("*").alias("docs"))  # at most shards * SLOT_BUCKETS rows
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "bucket", F.coalesce(F.sum("docs").over(ahead), F.lit(0)).alias("base"))
    turn = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    out = found.withColumn("turn", turn).join(F.broadcast(base), ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("turn") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
