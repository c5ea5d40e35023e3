"""Exact top-k search by inner product, a block at a time.

Vectors become integer vectors, floor(256 * x) in each component. Candidates are dealt by ranges of (leading
component, its value) into shards, so that a shard holds vectors of like direction, and a shard is cut into
document-range blocks of ``BLOCK`` vectors in the same order. A block keeps the largest and the smallest value of
each component (its term maxima): their products with a query's components, summed, bound every score in the block
from above. For each query the blocks come in falling order of that bound and are scored through their forward
index (the vectors themselves) until the bound falls below the query's k-th best score so far. Ties go to the
smaller id, so a block whose bound equals that score is still read unless all its ids are larger.

1. Each query meets the shard that it lies in itself, in the task that makes the shard, which gives it k scores. The
   last of them can only be too low.
2. Each query meets the other shards with that score as the start of its k-th best, so that blocks and whole shards
   of other directions fall below at once. Shards return what beats it, k rows a query at most.

The best k of both are the result: all of this is exact. A task has one cell of a grid at a time, a shard and a
batch of queries, whose numbers are the partitions' own; cells are held one after another. The work is queries times
vectors by its nature, less what the bounds leave out.

Defined cases: vectors that are null or hold a null or a non-finite component take no part, as queries or as
candidates; missing components of shorter vectors count as 0; with fewer candidates than k a query gets them
all; a query never gets its own row (the same vec_id); other rows with equal vectors it does; rows without
vec_id take no part. Scores beyond 63 bits are set to the nearest number of 63 bits and a sign.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxtone.llm.common import stored

#: Vectors of a shard at most and at least (small tables have ``SHARDS`` shards), queries of a batch, vectors of a block.
SHARD, LEAST_SHARD, SHARDS, BATCH, BLOCK = 65_536, 1024, 16, 16_384, 128

_NONE = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max


def _ints(v: pa.Array, dims: int) -> np.ndarray:
    """Integer components as doubles, or as Python integers where 256 times a component isn't exact in a double."""
    out = np.zeros((len(v), dims))
    out[np.arange(dims) < np.asarray(v.value_lengths())[:, None]] = np.asarray(v.flatten())
    if out.size and np.abs(out).max() >= 2.0**44:
        return np.array([[int(x) * 256 if abs(x) >= 2.0**53 else int(np.floor(x * 256.0)) for x in r] for r in out], dtype=object).reshape(out.shape)
    return np.floor(out * 256.0)


def _whole(a: np.ndarray) -> np.ndarray:
    """The same numbers as Python integers, which have no largest one."""
    return np.array([[int(v) for v in r] for r in a], dtype=object).reshape(a.shape)


def _most(a: np.ndarray) -> int:
    return int(np.abs(a).max()) if a.size else 0


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T, as 64-bit integers; the operands are doubles only where all sums are exact in them."""
    s = a @ b.T
    return np.clip(s, _NONE + 1, _LAST).astype(np.int64) if s.dtype == object else s.astype(np.int64)


class Shard:
    """Blocks of candidate vectors with bounds."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        vectors = _whole(vectors) if vectors.dtype == object else vectors  # batches may have come in both kinds
        # near vectors next to each other: by the leading component of each, and how large it is
        lead = np.abs(vectors).argmax(axis=1)
        value = vectors[np.arange(len(vectors)), lead]
        order = np.array(sorted(range(len(ids)), key=lambda i: (lead[i], value[i], ids[i]))) if vectors.dtype == object else np.lexsort((ids, value, lead))
        self.ids, self.vectors, self.size = ids[order], vectors[order], _most(vectors)
        cuts = range(0, len(ids), BLOCK)
        self.most = np.array([self.vectors[c : c + BLOCK].max(axis=0) for c in cuts])
        self.least = np.array([self.vectors[c : c + BLOCK].min(axis=0) for c in cuts])
        self.first = np.array([self.ids[c : c + BLOCK].min() for c in cuts])

    def whole(self) -> Shard:
        if self.vectors.dtype != object:
            self.vectors, self.most, self.least = _whole(self.vectors), _whole(self.most), _whole(self.least)
        return self

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids, each queries x k, best first; places without a candidate have the largest id.

        ``start``: scores that the k-th best reaches in any case; what is below them may be left out.
        """
        if queries.dtype == object or self.vectors.dtype == object or _most(queries) * self.size * queries.shape[1] >= 2**53:
            self.whole()
            queries = _whole(queries)
        best, who = np.full((len(queries), k), _NONE), np.full((len(queries), k), _LAST)
        if start is not None:
            best[:] = start[:, None]
        # sums of products are exact here, so bounds need no slack
        bound = np.maximum(queries, 0) @ self.most.T + np.minimum(queries, 0) @ self.least.T
        order = np.argsort(-bound, axis=1, kind="stable")
        live = np.arange(len(queries))
        for turn in range(bound.shape[1]):
            block = order[live, turn]
            near = bound[live, block] >= best[live, -1]  # bounds only fall from here on
            live, block = live[near], block[near]
            if not len(live):
                break
            read = (bound[live, block] > best[live, -1]) | (self.first[block] <= who[live, -1])
            for b in np.unique(block[read]):
                rows = live[read & (block == b)]
                own = self.ids[b * BLOCK : (b + 1) * BLOCK]
                s = np.concatenate([best[rows], _dot(queries[rows], self.vectors[b * BLOCK : (b + 1) * BLOCK])], axis=1)
                i = np.concatenate([who[rows], np.broadcast_to(own, (len(rows), len(own)))], axis=1)
                s[:, k:][i[:, k:] == ids[rows][:, None]] = _NONE
                i[s == _NONE] = _LAST
                top = _top(s, i, k)
                best[rows], who[rows] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        return best, who


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of each row, ties to the smaller id; ~score rises as the score falls."""
    return np.lexsort((ids, ~scores), axis=1)[:, :k]


def _searched(cells: DataFrame, number: int, k: int, dims: int) -> DataFrame:
    """query_id, vec_id, score of each of ``number`` cells' best. ``cells``: cell, kind (0 candidate, 1 query), vec_id, v, start."""
    tasks = min(number, 8 * int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cells.repartitionById(tasks, F.pmod("cell", F.lit(tasks)).cast("int")).sortWithinPartitions("cell", "kind", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, shard = None, [], None
        for batch in batches:
            place, kind, ids, start = (batch[c].to_numpy(zero_copy_only=False) for c in ("cell", "kind", "vec_id", "start"))
            data = _ints(batch["v"], dims)
            cuts = np.flatnonzero((np.diff(place) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(place)], strict=True):
                if place[a] != current:
                    current, held, shard = place[a], [], None
                if kind[a] == 0:
                    held.append((ids[a:b], data[a:b]))
                    continue
                if shard is None and held:
                    shard, held = Shard(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])), []
                if shard is None:
                    continue
                score, who = shard.search(ids[a:b], data[a:b], k, start[a:b])
                real = who != _LAST
                yield pa.record_batch({"query_id": pa.array(np.repeat(ids[a:b], k).reshape(-1, k)[real]), "vec_id": pa.array(who[real]), "score": pa.array(score[real])})

    return dealt.mapInArrow(run, "query_id long, vec_id long, score long")


def _at_home(ranges: DataFrame, k: int, dims: int, query_step: int) -> DataFrame:
    """The vectors of each partition, which is a shard, and what its own queries find in it.

    shard, query_id (null for a vector), vec_id, v (null for a result), score.
    """
    kind = ranges.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, data = TaskContext.get().partitionId(), [], []
        rows = lambda n, query, vec, v, score: pa.RecordBatch.from_arrays([pa.array(np.full(n, number, np.int64)), query, vec, v, score], ["shard", "query_id", "vec_id", "v", "score"])
        for batch in batches:
            n, v = batch.num_rows, batch["v"]
            ids.append(batch["vec_id"].to_numpy())
            data.append(_ints(v, dims))
            yield rows(n, pa.nulls(n, pa.int64()), batch["vec_id"], v, pa.nulls(n, pa.int64()))
        if not ids:
            return
        shard, asked, vectors = Shard(np.concatenate(ids), np.concatenate(data)), np.concatenate(ids), np.concatenate(data)
        for at in range(0, len(asked), BATCH):
            mine = np.flatnonzero(asked[at : at + BATCH] % query_step == 0) + at
            if len(mine):
                score, who = shard.search(asked[mine], vectors[mine], k)
                real = who != _LAST
                found = int(real.sum())
                yield rows(found, pa.array(np.repeat(asked[mine], k).reshape(-1, k)[real]), pa.array(who[real]), pa.nulls(found, v.type), pa.array(score[real]))

    return ranges.mapInArrow(run, f"shard long, query_id long, vec_id long, v {kind}, score long")


def top_k(vectors: DataFrame, k: int = 5, query_step: int = 50) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by ``query_step``: query_id, rank (from 1), vec_id, score."""
    ok = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    narrow = vectors.schema["embedding"].dataType.simpleString() == "array<float>"  # half of a double's bytes
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if narrow else "array<double>").alias("v")).where(ok)
    size = F.transform("v", lambda x: F.abs(x))
    rows = rows.withColumn("lead", F.array_position(size, F.array_max(size))).withColumn("value", F.when(F.col("lead") > 0, F.col("v")[(F.col("lead") - 1).cast("int")]))
    facts = rows.agg(F.count("*"), F.max(F.size("v")), F.count(F.when(F.col("vec_id") % query_step == 0, 1))).first()
    each = min(SHARD, max(LEAST_SHARD, -(-facts[0] // SHARDS)))
    shards, batches, dims = max(1, -(-facts[0] // each)), max(1, -(-facts[2] // BATCH)), max(1, facts[1] or 1)
    # a shard is what one task of the range sort reads; the written table fixes it
    ranges = rows.repartitionByRange(shards, "lead", "value", "vec_id").select("vec_id", "v")
    both = stored(_at_home(ranges, k, dims, query_step), "vectors")
    shards = (both.agg(F.max("shard")).first()[0] or 0) + 1
    rows, home = both.where("query_id is null").select("shard", "vec_id", "v"), both.where("query_id is not null").select("query_id", "vec_id", "score")
    floor = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(_NONE)).alias("start"))
    far = rows.where(F.col("vec_id") % query_step == 0).join(floor, F.col("vec_id") == F.col("query_id"), "left").withColumn("start", F.coalesce("start", F.lit(_NONE)))
    far = far.withColumn("batch", F.pmod(F.xxhash64("vec_id"), F.lit(batches))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("other <> shard")
    cell = lambda s, b: (F.col(s) * batches + F.col(b)).alias("cell")
    mine = rows.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))).select(cell("shard", "batch"), F.lit(0).alias("kind"), "vec_id", "v", F.lit(_NONE).alias("start"))
    away = _searched(mine.unionByName(far.select(cell("other", "batch"), F.lit(1).alias("kind"), "vec_id", "v", "start")), shards * batches, k, dims)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return home.unionByName(away).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
where rank <= 5
"""
