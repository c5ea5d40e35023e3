"""Source divergence audit: how far the terms of a source stray from those of other sources, and of all, in its language.

Terms are maximal runs of letters A-Z (as a-z) and characters from U+0080 on. A lang keeps the V terms that at
least ``LEAST_DOCS`` of its documents have. A group (a source in a lang), and a lang as a whole, gives a kept term
p = 1 + floor(10^9 * (count + 1) / (N + V)), N its occurrences of kept terms. p strays from q by
f(p, q) = floor((p - q)^2 / q). All is computed in integers.

A pair of groups needs the sum of f over all V terms. A term that neither has adds base = f(a, b), where a and b
are what absent terms get in the two, so the sum is V * base and a correction for each term that either has:

* *Heavy* terms, those of more than ``LIGHT`` groups: dense tiles. The groups of a lang are numbered and cut into
  blocks of ``BLOCK``. For a pair of blocks and a chunk of terms numpy fills one matrix a block (absent: a) and
  sums f - base over the terms.
* *Light* terms: from their postings. What a term that only one of the two has adds depends on its p alone, so a
  group's light terms are counted by p, and each such count meets the groups of its lang. For the two groups of
  every pair of a term's postings (``LIGHT`` at most, so a bounded number) what both have is corrected:
  f(p, p') - f(p, b) - f(a, p') + base.

All partial sums are 64-bit integers and are added up by Spark. Terms are counted in each task first, then by
group, then by lang, so that a frequent word or a source that holds most rows is small before it is shuffled.

Defined cases: null text, lang and source count as ''; every row is a document, repeated ones too; a group without
terms takes part with count 0; where a lang keeps no term, pairs have value 0 and there are no terms; an empty
table gives no row. Sums are exact while 10^9 + V is below 3 * 10^9 and counts are below 9 * 10^15. Only text, lang
and source are read, other columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxtone.llm.common import small_batches, stored
from fluxtone.llm.textops import parts

LEAST_DOCS = 3
LIGHT = 8
BLOCK = 512
#: Postings of a block that one tile takes (more where a tile's result would be larger), and cells of its temporaries.
TILE, CELLS = 1 << 16, 1 << 20
#: Counts that a task holds before it hands them on.
HELD = 300_000
SALTS = 16

_FOLD = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, count, docs: summed over what fits in memory."""
    counts: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in counts.items():
            if found:
                n, with_it = len(found), docs[lang, source]
                columns = [pa.array([lang] * n), pa.array([source] * n), pa.array(found.keys(), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64()), pa.array([with_it[t] for t in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "count", "docs"])

    held = 0
    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for first, texts in parts(batch.column("text")):
            for i, data in enumerate(texts, first):
                key, terms = (langs[i], sources[i]), data.translate(_FOLD).split(b" ")
                once = set(terms)
                once.discard(b"")
                own = counts.setdefault(key, Counter())
                before = len(own)
                own.update(filter(None, terms))
                held += len(own) - before
                docs.setdefault(key, Counter()).update(once)
                if held > HELD:
                    yield from handed_on()
                    counts, docs, held = {}, {}, 0
    yield from handed_on()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs of all terms."""
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = rows.mapInArrow(_count, "lang string, source string, term string, count long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: Column, whole: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / whole) by long division, three digits at a time, so that nothing overflows."""
    total, left = F.lit(0).cast("long"), count + 1
    for _ in range(3):
        total = total * 1000 + _div(left * 1000, whole)
        left = (left * 1000) % whole
    return total + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def stray(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def strays(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def kept_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, in_lang (its count in the lang), groups (that have it), lead (true in one of its rows)."""
    own = Window.partitionBy("lang", "term")
    found = term_counts(docs).select("*", F.sum("docs").over(own).alias("in_docs"), F.sum("count").over(own).alias("in_lang"), F.count("*").over(own).alias("groups"), (F.row_number().over(own.orderBy("source")) == 1).alias("lead"))
    return stored(found.where(F.col("in_docs") >= LEAST_DOCS).drop("docs", "in_docs"), "terms")


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per group: lang, source, g (its number in the lang), whole (N + V), lang_whole, terms (V), heavy (terms), absent (p of an absent term, 0 where V is 0)."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.sum(F.col("lead").cast("long")).alias("leads"), F.sum((F.col("lead") & (F.col("groups") > LIGHT)).cast("long")).alias("heavy"))
    by_lang = Window.partitionBy("lang")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    found = named.join(own, ["lang", "source"], "left").select("lang", "source", (F.row_number().over(by_lang.orderBy("source")) - 1).cast("long").alias("g"), zero("n").alias("n"), F.sum(zero("n")).over(by_lang).alias("lang_n"), F.sum(zero("leads")).over(by_lang).alias("terms"), F.sum(zero("heavy")).over(by_lang).alias("heavy"), F.count("*").over(by_lang).alias("size"))
    whole = found.withColumn("whole", F.col("n") + F.col("terms")).withColumn("lang_whole", F.col("lang_n") + F.col("terms"))
    absent = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.greatest("whole", F.lit(1)))).otherwise(0)
    return stored(whole.withColumn("absent", absent).drop("n", "lang_n"), "groups")


PAIRS = "lang string, g long, h long, value long"


def _pairs(lang: str, g: np.ndarray, h: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(h), pa.array(value)], ["lang", "g", "h", "value"])


def _square(lang: str, first_g: int, first_h: int, value: np.ndarray) -> pa.RecordBatch:
    """A matrix of values without the pairs of a group and itself."""
    g, h = np.meshgrid(np.arange(first_g, first_g + value.shape[0]), np.arange(first_h, first_h + value.shape[1]), indexing="ij")
    off = g != h
    return _pairs(lang, g[off], h[off], value[off])


def _numbers(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column as its lengths and all its values."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(whole.value_lengths()), np.asarray(whole.flatten())


def base_pairs(blocks: DataFrame) -> DataFrame:
    """V * base for every pair of groups, both ways."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a, b = np.array(r["absent"], np.int64), np.array(r["other_absent"], np.int64)
                value = r["terms"] * strays(a[:, None], b[None, :]) if r["terms"] else np.zeros((len(a), len(b)), np.int64)
                yield _square(r["lang"], r["block"] * BLOCK, r["other"] * BLOCK, value)

    other = blocks.select("lang", F.col("block").alias("other"), F.col("absent").alias("other_absent"))
    return blocks.join(other, "lang").mapInArrow(each, PAIRS)


def heavy_pairs(postings: DataFrame, blocks: DataFrame) -> DataFrame:
    """Sums of f - base over the heavy terms, by dense tiles."""
    wide = F.least("size", F.lit(BLOCK))
    per_tile = F.greatest((TILE / wide).cast("long"), wide)
    plan = blocks.groupBy("lang").agg(F.count("*").alias("blocks"), F.max(F.ceil(F.col("heavy") / per_tile)).alias("chunks")).where("chunks > 0")
    ends = [F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")]
    numbers = F.expr("sequence(cast(0 as long), blocks - 1)")
    sent = postings.where("block >= 0").join(plan, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks"))).withColumn("other", F.explode(numbers)).select("lang", *ends, "chunk", "block", "term", "g", "p")
    edges = blocks.select("lang", "block", "absent").join(plan, "lang").withColumn("chunk", F.explode(F.expr("sequence(cast(0 as long), chunks - 1)"))).withColumn("other", F.explode(numbers)).select("lang", *ends, "chunk", "block", "absent")

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _pairs("", *[np.zeros(0, np.int64)] * 3).schema.empty_table()
        lang, lo, hi = (right.column(c)[0].as_py() for c in ("lang", "lo", "hi"))
        absent = {b: np.array(a, np.int64) for b, a in zip(right.column("block").to_pylist(), right.column("absent").to_pylist(), strict=True)}
        _, row = np.unique(np.asarray(left.column("term").combine_chunks().dictionary_encode().indices), return_inverse=True)
        block = np.asarray(left.column("block"))
        length, g = _numbers(left.column("g"))
        _, p = _numbers(left.column("p"))
        rows, of = np.repeat(row, length), np.repeat(block, length)
        terms = int(row.max()) + 1
        a, b = absent[lo], absent[hi]
        there, back = np.zeros((len(a), len(b)), np.int64), np.zeros((len(b), len(a)), np.int64)
        base_there, base_back = strays(a[:, None], b[None, :]), strays(b[:, None], a[None, :])
        order = np.argsort(rows, kind="stable")
        rows, of, g, p = rows[order], of[order], g[order], p[order]
        step = max(1, CELLS // (len(a) * len(b)))
        for t in range(0, terms, step):
            s = slice(*np.searchsorted(rows, (t, t + step)))
            n = min(step, terms - t)
            x, y = np.tile(a, (n, 1)), np.tile(b, (n, 1))
            for m, number in ((x, lo), (y, hi)):
                own = of[s] == number
                m[rows[s][own] - t, g[s][own] - number * BLOCK] = p[s][own]
            there += strays(x[:, :, None], y[:, None, :]).sum(0) - n * base_there
            if lo != hi:
                back += strays(y[:, :, None], x[:, None, :]).sum(0) - n * base_back
        found = [_square(lang, lo * BLOCK, hi * BLOCK, there)]
        if lo != hi:
            found.append(_square(lang, hi * BLOCK, lo * BLOCK, back))
        return pa.Table.from_batches(found)

    key = ["lang", "lo", "hi", "chunk"]
    return sent.groupBy(key).cogroup(edges.groupBy(key)).applyInArrow(tile, PAIRS)


def light_pairs(postings: DataFrame) -> DataFrame:
    """Corrections for pairs of groups that share light terms, from pairs of a term's postings."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            langs = whole.column("lang").combine_chunks().dictionary_encode()
            names, lang = langs.dictionary.to_pylist(), np.asarray(langs.indices).astype(np.int64)
            length, g = _numbers(whole.column("g"))
            p, a = _numbers(whole.column("p"))[1], _numbers(whole.column("absent"))[1]
            start, many = np.cumsum(length) - length, int(g.max()) + 1
            keys, values = [], []
            for n in range(2, LIGHT + 1):
                of = np.flatnonzero(length == n)
                if not len(of):
                    continue
                at = start[of][:, None] + np.arange(n)
                for i in range(n):
                    for j in range(n):
                        if i != j:
                            x, y, u, v = p[at[:, i]], p[at[:, j]], a[at[:, i]], a[at[:, j]]
                            keys.append((lang[of] * many + g[at[:, i]]) * many + g[at[:, j]])
                            values.append(strays(x, y) - strays(x, v) - strays(u, y) + strays(u, v))
            if keys:
                distinct, to = np.unique(np.concatenate(keys), return_inverse=True)
                total = np.zeros(len(distinct), np.int64)
                np.add.at(total, to, np.concatenate(values))
                for k, name in enumerate(names):
                    own = distinct // (many * many) == k
                    yield _pairs(name, distinct[own] // many % many, distinct[own] % many, total[own])

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 50_000:
                yield from done(held)
                held, rows = [], 0
        if held:
            yield from done(held)

    return postings.where("block < 0 and size(g) > 1").select("lang", "g", "p", "absent").mapInArrow(each, PAIRS)


def light_singles(light: DataFrame, blocks: DataFrame) -> DataFrame:
    """What light terms add to pairs of groups as if only one of the two had them."""
    # a group's terms by p: as many rows as it has different counts
    by_p = light.groupBy("lang", "g", "p", "absent").agg(F.count("*").alias("n")).withColumn("salt", F.pmod(F.xxhash64("g", "p"), F.lit(SALTS)))
    spread = blocks.select("lang", "block", F.col("absent").alias("others")).withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int, int], list] = {}
            for r in batch.to_pylist():
                b = np.array(r["others"], np.int64)
                p, a, n = r["p"], r["absent"], r["n"]
                there = n * (strays(np.int64(p), b) - strays(np.int64(a), b))
                back = n * (strays(b, np.int64(p)) - strays(b, np.int64(a)))
                own = sums.setdefault((r["lang"], r["g"], r["block"]), [0, 0])
                own[0], own[1] = own[0] + there, own[1] + back
            for (lang, g, block), (there, back) in sums.items():
                h = np.arange(block * BLOCK, block * BLOCK + len(there))
                off = h != g
                here = np.full(off.sum(), g)
                yield _pairs(lang, here, h[off], there[off])
                yield _pairs(lang, h[off], here, back[off])

    return by_p.join(spread, ["lang", "salt"]).mapInArrow(each, PAIRS)


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, g, h, value for all ordered pairs of different groups of a lang."""
    blocks = groups.groupBy("lang", F.floor(F.col("g") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("g", "absent"))).alias("own"), *[F.max(c).alias(c) for c in ("terms", "heavy", "size")])
    blocks = stored(blocks.withColumn("absent", F.col("own.absent")).drop("own"), "blocks")
    rows = kept.join(groups.select("lang", "source", "g", "whole", "absent"), ["lang", "source"]).select("lang", "term", "groups", "g", share(F.col("count"), F.col("whole")).alias("p"), "absent")
    block = F.when(F.col("groups") > LIGHT, F.floor(F.col("g") / BLOCK)).otherwise(-1).cast("long")
    # at most LIGHT or BLOCK entries each
    postings = rows.groupBy("lang", "term", block.alias("block")).agg(F.collect_list(F.struct("g", "p", "absent")).alias("own"))
    postings = stored(postings.select("lang", "term", "block", "own.g", "own.p", "own.absent"), "postings")
    light = postings.where("block < 0").select("lang", F.explode(F.arrays_zip("g", "p", "absent")).alias("own")).select("lang", "own.*")
    everything = base_pairs(blocks).union(heavy_pairs(postings, blocks)).union(light_pairs(postings)).union(light_singles(light, blocks))
    return everything.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, most: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` has all other sources of the lang, part ``term`` the first ``most`` terms that the group has more of than its lang."""
    kept = kept_terms(docs)
    groups = groups_of(docs, kept)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    name = lambda at, to: groups.select("lang", F.col("g").alias(at), F.col("source").alias(to))
    pairs = pair_values(kept, groups).join(name("g", "source"), ["lang", "g"]).join(name("h", "item"), ["lang", "h"])
    p, q = share(F.col("count"), F.col("whole")), share(F.col("in_lang"), F.col("lang_whole"))
    terms = kept.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").withColumn("value", stray(F.col("p"), F.col("q")))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    terms = terms.withColumn("rank", rank).where(F.col("rank") <= most).withColumn("part", F.lit("term"))
    return pairs.withColumn("rank", rank).withColumn("part", F.lit("pair")).select(columns).union(terms.select(columns))


ORACLE = """
with d as (
  select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms
  from documents),
u as (
  select i, lang, source, unnest(terms) as term from d),
k as (
  select lang, term, count(*) as in_lang from u group by all having count(distinct i) >= 3),
c as (
  select lang, source, term, count(*) as n from u join k using (lang, term) group by all),
g as (
  select x.lang, x.source, coalesce(v, 0) as v, coalesce(own, 0) as own, coalesce(lang_own, 0) as lang_own
  from (select distinct lang, source from d) x left join (select lang, count(*) as v, sum(in_lang) as lang_own from k group by all) using (lang)
  left join (select lang, source, sum(n) as own from c group by all) using (lang, source)),
p as (
  select g.lang, g.source, term, coalesce(n, 0) as n,
         (1 + 1000000000::hugeint * (coalesce(n, 0) + 1) // (own + v)::hugeint)::hugeint as p,
         (1 + 1000000000::hugeint * (in_lang + 1) // (lang_own + v)::hugeint)::hugeint as q
  from g join k using (lang) left join c using (lang, source, term)),
v as (
  select a.lang, a.source, 'pair' as part, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
  union all
  select a.lang, a.source, 'pair', b.source, 0 from g a join g b on a.lang = b.lang and a.source <> b.source where a.v = 0
  union all
  select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from p where n > 0 and p > q),
r as (
  select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from v)
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 200
"""
