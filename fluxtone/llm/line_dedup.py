"""Removing runs of lines that occur earlier in the corpus, found by winnowing.

A line's hash is that of its words (A-Z as a-z, blanks aside); lines without a word have none and are passed
over: they neither make nor break a run.

By run, a line goes if and only if it lies in ``run`` or more consecutive lines, of ``least_words`` words or more
in all, that also occur in this order at an earlier place; or is a line of ``long_words`` words or more that does.
Whether a run is repeated is settled by its *tight windows*: for every line the shortest run of enough lines and
words that starts with it, and the shortest that ends with it. A repeated run with enough of both is the union of
the tight windows inside it (lines too near to its end for one that starts there have one that ends there), and
each of them is repeated with it. So it is enough to match tight windows, to whatever place each has come from:
runs of any length come out whole, and no pairs are made or chained. A tight window has at most
``max(run, least_words)`` lines.

By window (the default), ``least_words`` is asked of every ``run`` consecutive lines by themselves instead.

1. In every window the line with the least mixed hash is selected, ties to the last: windows with equal lines
   select the same line of them, whose hash is a guaranteed fingerprint. A row carries a fingerprint and the
   windows that selected it, which extend both ways from it. Long lines are windows of one line.
2. Fingerprints that occur once drop out (an aggregation that combines in each task, then a join).
3. Windows with equal lines share a key (fingerprint, window hash), whose first place in order of (doc_id,
   position) is one combining aggregation; no pairs are made, whatever the size of a group.
4. A window that has an earlier place is a later repeat: its lines go. Overlapping windows make longer runs.

A first place keeps its lines, unless it laps over a later one (a line that a text repeats at once ``run`` times
and more).

Defined cases: a null text has no lines, and stays null (the query counts it as empty); texts without lines of words stay as they are; rows without doc_id
come last in order; repeated rows (one doc_id, one text) are one document, and keep or lose the same lines, so
a repeat of a whole row isn't a repeat of lines; rows that share doc_id but not text are ordered by a hash of
their texts. Only doc_id and text are read, other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxtone.llm.common import small_batches, small_reads, stored
from fluxtone.llm.textops import _BASE, _K, _powers, joined, mix, parts, words


def _lines(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines with words, of all texts in a row: number in the data, hash, word count; bounds of texts in them, first number of each."""
    data, starts = joined(texts)
    at, _, h = words(data)
    feeds = np.flatnonzero(np.frombuffer(data + b"\n", np.uint8) == 10)  # feeds[i] ends line i
    line = np.searchsorted(feeds, at)
    edge = np.flatnonzero(np.diff(line, prepend=-1)) if len(line) else np.zeros(0, np.int64)
    # words of a line by place: each word hash is mixed with its number in the line
    count = np.diff(np.append(edge, len(line)))
    place = np.arange(len(line)) - np.repeat(edge, count)
    total = np.add.reduceat(mix(h + place.astype(np.uint64) * _K[1]), edge) if len(edge) else np.zeros(0, np.uint64)
    hashes, number = mix(total + count.astype(np.uint64)), line[edge]
    first = np.searchsorted(feeds, starts[:-1])  # the number of each text's first line
    return number, hashes, count, np.searchsorted(number, [*first, len(feeds)]), first


def line_hashes(texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: its lines with words by number (parts between line feeds), their hashes, their word counts."""
    number, hashes, count, cut, first = _lines(texts)
    return [(number[a:b] - f, hashes[a:b], count[a:b]) for a, b, f in zip(cut, cut[1:], first, strict=False)]


def _windows(count: np.ndarray, cut: np.ndarray, run: int, least_words: int, long_words: int, by_run: bool) -> tuple[np.ndarray, np.ndarray]:
    """First lines and sizes of the windows to match; none reaches into another text."""
    n = len(count)
    total = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(cut) - 1), np.diff(cut))  # of each line
    at = np.arange(n)
    stop = np.maximum(at + run, np.searchsorted(total, total[:-1] + least_words)) if by_run else at + run
    good = stop <= cut[1:][text]
    if not by_run:
        good[good] &= total[stop[good]] - total[at[good]] >= least_words
    pairs = [np.stack([at, stop], axis=1)[good]]
    if by_run:
        start = np.minimum(at + 1 - run, np.searchsorted(total, total[1:] - least_words, "right") - 1)
        pairs.append(np.stack([start, at + 1], axis=1)[start >= cut[:-1][text]])
    long = np.flatnonzero(count >= long_words)
    pairs.append(np.stack([long, long + 1], axis=1))
    begin, end = np.unique(np.concatenate(pairs), axis=0).T
    return begin, end - begin


def _fingerprints(docs: DataFrame, run: int, least_words: int, long_words: int, by_run: bool) -> DataFrame:
    """A row for each fingerprint: print, doc_id, mark, and the windows that selected it (hash, first line, lines)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power, inverse = _powers(_BASE, 1 << 16), _powers(pow(_BASE, -1, 2**64), 1 << 16)
        for batch in batches:
            for first, texts in parts(batch["text"]):
                _, h, count, cut, _ = _lines(texts)
                begin, size = _windows(count, cut, run, least_words, long_words, by_run)
                if not len(begin):
                    continue
                if len(h) > len(power):
                    power, inverse = _powers(_BASE, 2 * len(h)), _powers(pow(_BASE, -1, 2**64), 2 * len(h))
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[: len(h)], dtype=np.uint64)])
                key = mix((sums[begin + size] - sums[begin]) * inverse[begin] + size.astype(np.uint64) * _K[2]).view(np.int64)
                order, chosen = mix(h), begin.copy()
                least = order[begin]
                for j in range(1, int(size.max())):
                    open_ = np.flatnonzero(size > j)
                    here = order[begin[open_] + j]
                    lower = here <= least[open_]
                    least[open_[lower]], chosen[open_[lower]] = here[lower], begin[open_[lower]] + j
                by = np.argsort(chosen, kind="stable")
                begin, size, key, chosen = begin[by], size[by], key[by], chosen[by]
                edge = np.flatnonzero(np.diff(chosen, prepend=-1))
                own = np.searchsorted(cut, chosen[edge], "right") - 1
                start = begin - cut[np.searchsorted(cut, begin, "right") - 1]
                pick = pa.array(first + own, pa.int64())
                items = pa.StructArray.from_arrays([pa.array(key, pa.int64()), pa.array(start, pa.int64()), pa.array(size, pa.int32())], ["key", "start", "size"])
                yield pa.record_batch({"print": pa.array(h[chosen[edge]].view(np.int64)), "doc_id": batch["doc_id"].take(pick), "mark": batch["mark"].take(pick), "windows": pa.ListArray.from_arrays(pa.array(np.append(edge, len(chosen)), pa.int32()), items)})

    return docs.mapInArrow(find, "print long, doc_id long, mark long, windows array<struct<key:long,start:long,size:int>>")


def repeated_lines(docs: DataFrame, run: int, least_words: int, long_words: int, by_run: bool = False) -> DataFrame:
    """doc_id, mark, spans: the places, among a document's lines with words, of those that go, as ranges apart from each other (first, end)."""
    prints = stored(_fingerprints(docs, run, least_words, long_words, by_run), "prints")
    often = prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print")
    keys = prints.join(often, "print").select("print", "doc_id", "mark", F.explode("windows").alias("w"))
    keys = keys.select("print", F.col("w.key").alias("window"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "w.start", "w.size").alias("at"))
    keys = stored(keys, "windows")
    # repeated rows are one place, so places are counted by their ends
    firsts = keys.groupBy("print", "window").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first <> last").drop("last")
    later = keys.join(firsts, ["print", "window"]).where("at <> first")
    runs = later.groupBy("at.doc_id", "at.mark", "at.start").agg(F.max("at.size").alias("size"))
    # windows that touch or overlap become one range before they are gathered, so that a row holds no line more than once
    text = Window.partitionBy("doc_id", "mark").orderBy("start")
    runs = runs.withColumn("reach", F.max(F.col("start") + F.col("size")).over(text.rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.withColumn("range", F.count(F.when(F.coalesce(F.col("reach") < F.col("start"), F.lit(True)), 1)).over(text.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = runs.groupBy("doc_id", "mark", "range").agg(F.min("start").alias("first"), F.max(F.col("start") + F.col("size")).alias("end"))
    return ranges.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("spans"))


def line_dedup(docs: DataFrame, run: int = 2, least_words: int = 20, long_words: int = 50, by_run: bool = False) -> DataFrame:
    """One row per document: doc_id, text (what is left), n_lines (with words), removed (ranges of line numbers), n_removed."""
    small_batches(docs.sparkSession)
    small_reads(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    gone = repeated_lines(rows, run, least_words, long_words, by_run).select(F.col("doc_id").alias("i"), F.col("mark").alias("m"), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in parts(batch["text"]):
                left, n_lines, removed, n_removed = [], [], [], []
                for raw, (number, _, _), spans in zip(texts, line_hashes(texts), batch["spans"][first : first + len(texts)].to_pylist(), strict=True):
                    n_lines.append(len(number))
                    drop = np.concatenate([number[:0], *[number[x["first"] : x["end"]] for x in spans or []]])
                    n_removed.append(len(drop))
                    edge = np.flatnonzero(np.diff(drop, prepend=-2) != 1)
                    removed.append([{"first": int(drop[a]), "last": int(drop[b - 1])} for a, b in zip(edge, [*edge[1:], len(drop)], strict=False)])
                    if len(drop):
                        out = set(drop.tolist())
                        raw = b"\n".join(x for k, x in enumerate(raw.split(b"\n")) if k not in out)
                    left.append(raw)
                kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
                yield pa.record_batch({"doc_id": batch["doc_id"][first : first + len(texts)], "text": pa.array(left, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "removed": pa.array(removed, kind), "n_removed": pa.array(n_removed, pa.int64())})

    met = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left").select("doc_id", "text", "spans")
    return met.mapInArrow(cut, "doc_id long, text string, n_lines long, removed array<struct<first:long,last:long>>, n_removed long")
