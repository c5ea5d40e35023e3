"""Similarity self-join on word n-grams: documents whose n-gram sets have a Jaccard index of at least a threshold.

Rows go through these steps, each over all documents:

1. *Counts.* Rows alike in doc_id and text become one row with their number, in each task. Documents are dealt to
   blocks by a hash. A block sends the sorted short hashes of its n-grams, cut
   into ranges and packed, to the tasks that count each range over all blocks, and gets back the counts above
   one. So each n-gram's document frequency is known where its documents are: exactly, but for n-grams that share
   a short hash (which grows with the input; about one n-gram in ``2 ** SPARE_BITS`` has such a partner). They
   give the global rare-first order (count, then hash). Any total order keeps the join exact.
2. *Prefixes.* A document's first ``n - ceil(t n) + 1`` n-grams in that order. Two documents that link must
   share one of them, so n-grams that occur once are left out; most documents have nothing else in their prefix
   and go no further. Documents with equal sets are one node.
3. *Hubs.* Per prefix n-gram, every node is paired with the node in whose prefix it comes first (a combining
   aggregation), so a group of any size makes no more pairs than it has members. What this leaves apart is paired
   with the first node among itself in turn, ``HUB_ROUNDS`` times in all.
4. *The rest.* For n-grams whose nodes are in two or more components by then, the nodes outside the largest are
   joined with all of the n-gram's nodes, in squares of ``SQUARE`` by ``SQUARE`` nodes: no task has a whole group.
5. All these pairs pass length, positional and suffix filters within the join, become distinct, and are verified
   once on whole sets: pairs that were refused are kept and taken out of later ones. What is linked already is not
   paired again: the components, which are the result, can't change by it.

The filters take the shared n-gram for the first one that a pair shares, as one of them is: nothing before it is
common then. The suffix filter bounds from below how many n-grams after it only one of the two has: the hash range
is cut by fixed pivots into ``RANGES`` ranges, and a prefix n-gram carries the parity of the n-grams after it in
each; ranges of unlike parity hold at least one such n-gram.

Defined cases: a null text is an empty one; an empty set links with nothing; texts with fewer than ``k``
words have their whole word sequence as the one n-gram; repeated rows are one node; texts that share a doc_id are
nodes of their own, as are rows without doc_id, which get the smallest doc_id that they reach, or null. There is one
result row per input row. Only doc_id and text are read, other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxtone.llm.common import components, drop_stored, small_batches, stored
from fluxtone.llm.textops import batch_shingles, parts

#: A block has about this much text; up to ``BLOCKS`` blocks they are smaller.
BLOCK_BYTES, BLOCKS = 32 << 20, 64
#: Short hashes have so many bits more than the number of n-grams.
SPARE_BITS = 8
#: Words of 64 ranges each.
RANGE_WORDS = 4
RANGES = 64 * RANGE_WORDS
SQUARE = 2048
HUB_ROUNDS = 3
#: Rows that a task remembers to find repeated ones, and bytes of texts that it holds of those.
KNOWN, HELD = 200_000, 32 << 20

PREFIX = "array<struct<token:long,pos:long,odd:struct<" + ",".join(f"o{w}:long" for w in range(RANGE_WORDS)) + ">>>"


def pack(x: np.ndarray) -> bytes:
    """Sorted numbers: their differences, byte by place, compressed."""
    step = np.diff(x.astype("<u8"), prepend=np.uint64(0))
    wide = max(1, -(-int(step.max()).bit_length() // 8)) if len(step) else 1
    return bytes([wide]) + zstandard.compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    places = np.frombuffer(zstandard.decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    step = np.zeros((places.shape[1], 8), np.uint8)
    step[:, : raw[0]] = places.T
    return np.cumsum(step.reshape(-1).view("<u8"), dtype=np.uint64)


def _squeezed(x: np.ndarray) -> bytes:
    return zstandard.compress(x.astype("<u2").tobytes(), 1)


def _counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), "<u2")


def _level(count: np.ndarray) -> np.ndarray:
    """A count in 16 bits: itself, or by its logarithm where it is large."""
    high = (1 << 15) + np.floor(512 * np.log2(np.maximum(count, 1) / (1 << 15)))
    return np.where(count < 1 << 15, count, np.minimum(high, 65535)).astype(np.uint16)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, copies: the rows of a task, those that repeat one (null and empty texts are alike) put together.

    A row goes on at once when it is new; of a row that comes again the text is held until the end, or until
    ``HELD`` bytes are. So a repeated row makes some two rows a task, whatever its number.
    """
    known: set[tuple[int | None, bytes]] = set()
    held: dict[tuple[int | None, bytes], tuple[bytes, int]] = {}
    size = 0

    def repeats() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.int64()), pa.array([x for x, _ in held.values()], pa.binary()).cast(pa.string()), pa.array([n for _, n in held.values()], pa.int64())], ["doc_id", "text", "copies"])

    for batch in batches:
        for first, texts in parts(batch["text"]):
            rest = batch.slice(first, len(texts))
            new = []
            for i, text in zip(rest["doc_id"].to_pylist(), texts, strict=True):
                key = (i, blake2b(text or b"", digest_size=16).digest())
                new.append(key not in known)
                if new[-1]:
                    if len(known) >= KNOWN:
                        known.clear()
                    known.add(key)
                elif key in held:
                    held[key] = (held[key][0], held[key][1] + 1)
                else:
                    held[key] = (text or b"", 1)
                    size += len(text or b"")
            yield pa.RecordBatch.from_arrays([rest["doc_id"], rest["text"], pa.array(np.ones(len(texts), np.int64))], ["doc_id", "text", "copies"]).filter(pa.array(new, pa.bool_()))
            if size >= HELD:
                yield repeats()
                held, size = {}, 0
    if held:
        yield repeats()


def _dealt(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """doc_id, text, copies, mark, block; bits of a short hash; bits of a range."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, min(BLOCKS, size >> 20), -(-size // BLOCK_BYTES))
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.mapInArrow(_together, "doc_id long, text string, copies long")
    return rows.select("doc_id", "text", "copies", mark.alias("mark"), F.pmod(F.xxhash64("doc_id", mark), F.lit(blocks)).alias("block")), min(63, (size >> 2).bit_length() + SPARE_BITS), (blocks - 1).bit_length()


def _common(dealt: DataFrame, k: int, bits: int, range_bits: int) -> DataFrame:
    """block, part, prints, levels: of the short hashes in a block, those that two or more documents have anywhere."""

    def send(block: pa.Table) -> pa.Table:
        found = []
        for batch in block.select(["text"]).to_batches():
            for _, texts in parts(batch["text"]):
                found += [h >> np.uint64(64 - bits) for h in batch_shingles(texts, k)]
        prints, often = np.unique(np.concatenate(found), return_counts=True)
        cut = np.searchsorted(prints, np.arange(1, 1 << range_bits, dtype=np.uint64) << np.uint64(bits - range_bits)) if range_bits else []
        rows = [(r, pack(p), _squeezed(np.minimum(c, 65535))) for r, (p, c) in enumerate(zip(np.split(prints, cut), np.split(often, cut), strict=True)) if len(p)]
        return pa.table({"part": pa.array([r for r, _, _ in rows], pa.int64()), "block": pa.array([block["block"][0].as_py()] * len(rows), pa.int64()), "prints": pa.array([p for _, p, _ in rows], pa.binary()), "counts": pa.array([c for _, _, c in rows], pa.binary())})

    def tally(got: pa.Table) -> pa.Table:
        lists = [unpack(x.as_py()) for x in got["prints"]]
        every, number = np.unique(np.concatenate(lists), return_inverse=True)
        levels = _level(np.bincount(number, np.concatenate([_counts(x.as_py()) for x in got["counts"]])))[number]
        ends = np.cumsum([len(x) for x in lists])[:-1]
        prints, back = [], []
        for p, v in zip(lists, np.split(levels, ends), strict=True):
            prints.append(pack(p[v > 1]))
            back.append(_squeezed(v[v > 1]))
        return pa.table({"block": got["block"], "part": got["part"], "prints": pa.array(prints, pa.binary()), "levels": pa.array(back, pa.binary())})

    sent = dealt.groupBy("block").applyInArrow(send, "part long, block long, prints binary, counts binary")
    return sent.groupBy("part").applyInArrow(tally, "block long, part long, prints binary, levels binary")


def _prefixes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per row: doc_id, mark (of its text), copies, set size n, a 128-bit name of the set; prefix and text where another document shares a prefix n-gram."""
    dealt, bits, range_bits = _dealt(docs)
    kinds = PREFIX.replace("long", "bigint")

    def run(block: pa.Table, common: pa.Table) -> pa.Table:
        order = np.argsort(common["part"].to_numpy())
        prints, levels = [common["prints"][i].as_py() for i in order], [common["levels"][i].as_py() for i in order]
        prints = np.concatenate([np.zeros(0, np.uint64), *map(unpack, prints)])
        levels = np.concatenate([np.zeros(0, np.uint16), *map(_counts, levels)])
        n, a, b, prefix, kept = [], [], [], [], []
        for batch in block.select(["text"]).to_batches():
            for _, texts in parts(batch["text"]):
                for text, h in zip(texts, batch_shingles(texts, k), strict=True):
                    n.append(len(h))
                    a.append(int((h * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64).astype(np.int64)))
                    b.append(int(((h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64).astype(np.int64)))
                    found = _prefix(h, prints, levels, bits, percent) if len(h) else []
                    prefix.append(found)
                    kept.append(text if found else None)
        return pa.table({"doc_id": block["doc_id"], "mark": block["mark"], "copies": block["copies"], "n": pa.array(n, pa.int64()), "sig_a": pa.array(a, pa.int64()), "sig_b": pa.array(b, pa.int64()), "prefix": pa.array(prefix, _PREFIX_ARROW), "text": pa.array(kept, pa.binary()).cast(pa.string())})

    common = _common(dealt, k, bits, range_bits)
    return dealt.groupBy("block").cogroup(common.groupBy("block")).applyInArrow(run, f"doc_id long, mark long, copies long, n long, sig_a long, sig_b long, prefix {kinds}, text string")


_PREFIX_ARROW = pa.list_(pa.struct([("token", pa.int64()), ("pos", pa.int64()), ("odd", pa.struct([(f"o{w}", pa.int64()) for w in range(RANGE_WORDS)]))]))


def _prefix(h: np.ndarray, prints: np.ndarray, levels: np.ndarray, bits: int, percent: int) -> list[dict]:
    """The n-grams of the prefix of set ``h`` that other documents have too: place in the order, and parities of what follows."""
    n = len(h)
    keep = n - -(-percent * n // 100) + 1
    if not len(prints):
        return []
    short = h >> np.uint64(64 - bits)
    at = np.minimum(np.searchsorted(prints, short), len(prints) - 1)
    level = np.where(prints[at] == short, levels[at], 1)
    first = int((level == 1).sum())
    if first >= keep:
        return []
    order = np.lexsort((h, level))
    tokens = h[order]
    bit = (tokens >> np.uint64(56 - RANGE_WORDS.bit_length() + 1)) % np.uint64(RANGES)
    odd = np.zeros((n + 1, RANGE_WORDS), np.uint64)
    odd[np.arange(n), (bit >> np.uint64(6)).astype(np.intp)] = np.uint64(1) << (bit & np.uint64(63))
    odd = np.bitwise_xor.accumulate(odd[::-1], axis=0)[::-1].view(np.int64)
    return [{"token": int(t), "pos": p, "odd": {f"o{w}": int(o[w]) for w in range(RANGE_WORDS)}} for p, t, o in zip(range(first, keep), tokens[first:keep].view(np.int64), odd[first + 1 : keep + 1], strict=True)]


def _near(x: str, y: str, percent: int) -> F.Column:
    """Length, positional and suffix filters for structs x and y (pos, n, odd) of an n-gram that is the first one they share."""
    length = F.expr(f"least({x}.n, {y}.n) * 100 >= greatest({x}.n, {y}.n) * {percent}")
    need = f"(({percent} * ({x}.n + {y}.n) + {99 + percent}) div {100 + percent})"  # the least intersection of sets that link
    place = F.expr(f"least({x}.n - {x}.pos, {y}.n - {y}.pos) >= {need}")
    apart = " + ".join(f"bit_count({x}.odd.o{w} ^ {y}.odd.o{w})" for w in range(RANGE_WORDS))
    return length & place & F.expr(f"{apart} + {x}.pos + {y}.pos <= {x}.n + {y}.n - 2 * {need}")


def _verified(pairs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs of nodes (a, b), and whether their whole sets are similar enough (near), as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in parts(batch["text_a"]):
                cut = slice(first, first + len(texts))
                keep = []
                for p, q in zip(batch_shingles(texts, k), batch_shingles([x and x.encode() for x in batch["text_b"][cut].to_pylist()], k), strict=True):
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(100 * both >= percent * (len(p) + len(q) - both))
                yield pa.RecordBatch.from_arrays([batch["a"][cut], batch["b"][cut], pa.array(keep, pa.bool_())], names=["a", "b", "near"])

    met = pairs.join(nodes.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    met = met.join(nodes.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    kind = nodes.schema["node"].dataType.simpleString()
    return stored(met.mapInArrow(run, f"a {kind}, b {kind}, near boolean"), "links")


def _pair(x: str, y: str) -> list[F.Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _labelled(entries: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    """``entries`` with the component of the node in column ``node`` as ``label``."""
    named = labels.select(F.col("node").alias("who"), F.col("label").alias(label))
    return entries.join(named, F.col(node) == F.col("who"), "left").withColumn(label, F.coalesce(label, node)).drop("who")


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, mark (xxhash64 of the text), n, group, own, first.

    ``group`` names the component and ``own`` the document's set: structs (none, id, sig) of a smallest doc_id, none
    where there is no doc_id, and a hash of its set; both are null for an empty set. ``first`` is true for the rows of
    the one document that gives the group its name.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(_prefixes(docs, k, percent), "prefixes")
    least = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "mark")
    classes = rows.where("n > 0").groupBy("sig_a", "sig_b").agg(F.min(least).alias("least"))
    name = F.struct(F.col("least.none").alias("none"), F.col("least.id").alias("id"), F.col("sig_a").alias("sig"))
    own = rows.join(classes, ["sig_a", "sig_b"], "left").withColumn("node", F.when(F.col("n") > 0, name)).withColumn("leads", least == F.col("least"))

    nodes = own.where("leads and text is not null").select("node", "n", "text", "prefix", "sig_b").dropDuplicates(["node", "sig_b"])
    nodes = stored(nodes.drop("sig_b"), "nodes")
    entries = nodes.select(F.explode("prefix").alias("p"), "n", "node").select("p.token", F.struct("p.pos", "node", "n", "p.odd").alias("at"))
    hubs = entries.groupBy("token").agg(F.min("at").alias("hub"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    entries = stored(entries.join(hubs, "token"), "entries")
    apart, labels, seen = entries, None, []
    for turn in range(HUB_ROUNDS):
        pairs = apart.where((F.col("at.node") != F.col("hub.node")) & _near("at", "hub", percent)).select(*_pair("at.node", "hub.node")).distinct()
        seen.append(_verified(_unseen(pairs, seen), nodes, k, percent))
        labels = components(seen[-1].where("near"), labels)
        if turn + 1 < HUB_ROUNDS:
            # the nodes outside the components of all hubs so far meet the first of themselves next
            left = _labelled(_labelled(apart, labels, "at.node", "label"), labels, "hub.node", "top").where("label <> top").select("token", "at")
            last, apart = apart, stored(left.join(left.groupBy("token").agg(F.min("at").alias("hub")), "token"), "apart")
            if turn:
                drop_stored(last)
    more = _verified(_unseen(_rest(_labelled(entries, labels, "at.node", "label"), percent), seen), nodes, k, percent)
    for done in (apart, entries, *seen):
        drop_stored(done)
    labels = components(more.where("near"), labels)

    found = own.join(labels.select(F.col("node").alias("who"), "label"), F.col("node") == F.col("who"), "left")
    group = F.coalesce("label", "node")
    named = found.select("doc_id", "mark", "n", group.alias("group"), F.col("node").alias("own"), F.coalesce(F.col("leads") & (F.col("node") == group), F.lit(True)).alias("first"), "copies")
    return named.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copies", "copy")


def _unseen(pairs: DataFrame, seen: list[DataFrame]) -> DataFrame:
    """The pairs that no verification has refused yet; those it linked don't come again."""
    for done in seen:
        pairs = pairs.join(done.where("not near").select("a", "b"), ["a", "b"], "left_anti")
    return pairs


def _rest(entries: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of nodes (a, b) in different components that may link, of all that share a prefix n-gram."""
    sizes = entries.groupBy("token", "label").agg(F.count("*").alias("rows"))
    tops = sizes.groupBy("token").agg(F.max_by("label", "rows").alias("top"), F.sum("rows").alias("rows"), F.count("*").alias("labels")).where("labels > 1")
    met = entries.select("token", "at", "label").join(tops.drop("labels"), "token").withColumn("sides", F.expr(f"cast(1 + (rows - 1) div {SQUARE} as int)"))
    met = met.withColumn("side", F.pmod(F.xxhash64("at.node"), F.col("sides").cast("long")).cast("int"))
    across = F.sequence(F.lit(0), F.col("sides") - 1)
    left = met.where(F.col("label") != F.col("top")).select("token", F.col("side").alias("i"), F.explode(across).alias("j"), F.col("at").alias("x"), F.col("label").alias("p"))
    right = met.select("token", F.explode(across).alias("i"), F.col("side").alias("j"), F.col("at").alias("y"), F.col("label").alias("q"), (F.col("label") == F.col("top")).alias("central"))
    once = (F.col("p") != F.col("q")) & (F.col("central") | (F.col("x.node") < F.col("y.node")))
    return left.join(right, ["token", "i", "j"]).where(once & _near("x", "y", percent)).select(*_pair("x.node", "y.node")).distinct()


def ngram_jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (see the module text).

    Documents link when ``100 * |A and B| >= percent * |A or B|`` for their sets of ``k``-word n-grams.
    """
    found = near_groups(docs, k, percent)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("group.id", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, of one document of each component: the one with the smallest doc_id.

    Rows are dropped by doc_id and text, so texts that share a doc_id are judged apart; rows that share both stay
    or go together.
    """
    gone = stored(near_groups(docs, k, percent).where("not first").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct(), "gone")
    mark = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_id"]) & (mark == gone["_mark"]), "left_anti")
