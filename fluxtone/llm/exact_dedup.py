"""Exact deduplication of texts, in combining steps that no group of copies can upset.

Two texts are equal when they are identical after every character of 0x20 and 0x09-0x0D is deleted; a null
text counts as empty. Of equal texts the row with the most code points in its original text stays, then the
smallest doc_id (a null one comes last), then one of the rows that are alike in all of this.

1. Each task combines its own rows by (digest, content): Spark's partial aggregation.
2. The partial winners meet by (digest, salt, content); the salt spreads a hot digest over ``SALTS`` tasks.
3. The salt winners meet by (digest, content), at most ``SALTS`` rows of a group.

Content is a grouping key in each step, so texts whose digests collide stay apart. Rows then find their group
by digest alone where a digest has one content, and by digest and content where it has more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxtone.llm.common import row_hash, stored

SALTS = 64
BLANKS = "[\\x20\\x09-\\x0D]+"


def sha256(content: F.Column) -> F.Column:
    return F.sha2(content.cast("binary"), 256)


def _normalised(docs: DataFrame, digest) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_replace(text, BLANKS, "").alias("content"), F.char_length(text).cast("long").alias("points"))
    return bare.withColumn("digest", digest(F.col("content")))


def exact_groups(rows: DataFrame) -> DataFrame:
    """One row per distinct content: digest, content, keep_id, points of the row that stays, group_size."""
    best = F.min(F.struct((-F.col("points")).alias("minus"), F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("best")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "points"), F.lit(SALTS))).groupBy("digest", "salt", "content").agg(best, F.count("*").alias("size"))
    won = salted.groupBy("digest", "content").agg(F.min("best").alias("best"), F.sum("size").alias("group_size"))
    return won.select("digest", "content", F.col("best.doc_id").alias("keep_id"), (-F.col("best.minus")).alias("keep_points"), "group_size")


def exact_dedup(docs: DataFrame, digest=sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    ``kept`` is true in exactly one row of each group, repeated rows included. Texts of any length, no text and
    an empty table need no special case. Only doc_id and text are read, other columns may have any name.
    """
    rows = _normalised(docs, digest)
    names = exact_groups(rows).groupBy("digest").agg(F.count("*").alias("contents"), F.first("keep_id").alias("keep_id"), F.first("keep_points").alias("keep_points"), F.first("group_size").alias("group_size"))
    names = stored(names, "groups")
    keyed = rows.select("doc_id", "points", "digest", sha256(F.col("content")).alias("text_sha256"))
    found = keyed.join(names.where("contents = 1").drop("contents"), "digest")
    clash = names.where("contents > 1").select("digest")
    if clash.limit(1).count():
        those = rows.join(clash, "digest", "left_semi")
        more = those.join(exact_groups(those), ["digest", "content"])
        found = found.unionByName(more.select("digest", "doc_id", "points", sha256(F.col("content")).alias("text_sha256"), "keep_id", "keep_points", "group_size"))
    turn = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy(F.desc("points")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points")) & (turn == 1)
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    keep = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    content = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), BLANKS, "")
    long = F.char_length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("_id"), sha256(content).alias("_sha"), long.alias("_points"))
    # one key without nulls for the join and the window, so that whole rows are shuffled once
    key = F.concat_ws(" ", "_sha", "_id").alias("_key")
    met = named.select("row", "_points", key).join(keep.select(key), "_key", "left_semi")
    # rows that repeat both doc_id and content: the longest original, as the operator keeps
    turn = F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("_points"), row_hash(docs, "row")))
    return met.withColumn("_turn", turn).where("_turn = 1").select("row.*")


ORACLE = """
with d as (
  select doc_id, length(coalesce(text, '')) as points,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') as content from documents)
select doc_id,
       first_value(doc_id) over (partition by content order by points desc, doc_id) as keep_id,
       count(*) over (partition by content) as group_size,
       row_number() over (partition by content order by points desc, doc_id) = 1 as kept,
       sha256(content) as text_sha256
from d
"""
