"""Packing token sequences: concatenate and cut.

All documents' token ids are thought of as one long row of ids, cut into windows of ``length``. Where a
document lies follows from two prefix sums: one within the task that tokenised it, one over the token totals
of all tasks (one row a task). A document that crosses window bounds becomes several boundary records, one for
each window that it touches. Only the last window can be short: it is cut into windows of sizes that are
powers of two, which need no padding.

Tokenising is the costly part and happens once: ids go to a written table as 16-bit numbers (32-bit where a
vocabulary is larger), and offsets, cuts and digests come from that table. A retried task writes the same.

Defined cases: a null or empty text is the end id alone; a document of any length is cut as often as needed;
repeated rows are packed each for itself; an empty table gives no row. The order of documents is that of the
input's files. Only doc_id and text are read, other columns may have any name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxtone.llm.common import small_batches, stored
from fluxtone.llm.textops import parts


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: tiktoken's stack gives out within blank runs of some 500,000 characters; texts with runs of this length are not given to it.
LONG_BLANK = re.compile(r"\s{10000}")


@lru_cache(maxsize=4)
def _whole(path: str, added: bool):
    """A function from a text to its ids as the tokenizers library gives them."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = not added
    return lambda text: whole.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=4)
def _encoder(path: str, added: bool):
    """A function from a text to its ids; strings of added tokens get those tokens' ids, or count as ordinary text.

    The vocabulary in the JSON file is given to tiktoken, which cuts and merges as the file says and takes a
    sixth of the time. Texts that it can't do, those with a very long blank run or the string of an added token,
    go to the tokenizers library.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    if file["model"]["type"] != "BPE" or (file.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or file.get("normalizer"):
        return _whole(path, added)
    import public_tokenizers

    # byte-level files write each byte as one printable character: itself, or the next one from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {x["content"] for x in file.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    hard = special if added else set()
    return lambda text: _whole(path, added)(text) if any(x in text for x in hard) or LONG_BLANK.search(text) else fast(text)


def encode(text: str, path: str, added: bool = False) -> list[int]:
    return _encoder(path, added)(text)


def _tokens(docs: DataFrame, path: str, end: int, added: bool) -> DataFrame:
    """doc_id, ids (little-endian 16- or 32-bit), wide, n, task, ahead: ids before it in its task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, texts in parts(batch["text"], 1 << 20):
                ids, n, wide, ahead = [], [], [], []
                for x in texts:
                    found = np.array([*encode((x or b"").decode("utf-8", "replace"), path, added), end], dtype=np.uint32)
                    big = bool(found.max() > 0xFFFF)
                    ids.append(found.tobytes() if big else found.astype(np.uint16).tobytes())
                    wide.append(big)
                    n.append(len(found))
                    ahead.append(total)
                    total += len(found)
                yield pa.record_batch(
                    {
                        "doc_id": batch["doc_id"][first : first + len(texts)],
                        "ids": pa.array(ids, pa.binary()),
                        "wide": pa.array(wide, pa.bool_()),
                        "n": pa.array(n, pa.int64()),
                        "task": pa.array([task] * len(n), pa.int64()),
                        "ahead": pa.array(ahead, pa.int64()),
                    }
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, wide boolean, n long, task long, ahead long")


def windows(start: int, n: int, total: int, length: int) -> list[tuple[int, int, int, int]]:
    """The pieces of ``n`` ids from place ``start`` of ``total``: (start in the document, length, sequence, offset)."""
    out, at, whole = [], start, total // length * length
    while at < start + n:
        if at < whole:
            sequence, offset, stop = at // length, at % length, at - at % length + length
        else:  # the rest: one window for each power of two in it, the largest first
            sequence, begin, left = whole // length, whole, total - whole
            while at >= begin + (size := 1 << (left.bit_length() - 1)):
                sequence, begin, left = sequence + 1, begin + size, left - size
            offset, stop = at - begin, begin + size
        stop = min(stop, start + n)
        out.append((at - start, stop - at, sequence, offset))
        at = stop
    return out


def pack(docs: DataFrame, length: int = 2048, end: int = 1, vocabulary: str | None = None, added: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset (see the module text).

    With ``added``, strings of the vocabulary's added tokens get their ids, as the tokenizers library does by default.
    """
    small_batches(docs.sparkSession)
    ids = stored(_tokens(docs, vocabulary or default_vocabulary(), end, added), "ids")
    totals = ids.groupBy("task").agg(F.sum("n").alias("tokens"))  # one row a task
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    places = totals.select("task", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"), F.sum("tokens").over(everything).alias("total"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("doc_id", "ids", "wide", "n", "at", "total")
            out = []
            for doc_id, raw, wide, n, at, total in zip(*(batch[c].to_pylist() for c in names), strict=True):
                own = np.frombuffer(raw, np.uint32 if wide else np.uint16).astype("<u4")
                out += [(doc_id, s, k, own[s : s + k].tobytes(), n, q, o) for s, k, q, o in windows(at, n, total, length)]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    placed = ids.join(F.broadcast(places), "task")  # a row for each task that tokenised
    placed = placed.select("doc_id", "ids", "wide", "n", (F.col("base") + F.col("ahead")).alias("at"), "total")
    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pieces(docs: DataFrame, **how) -> DataFrame:
    """The pieces with a digest of their ids (CRC-32 of little-endian 32-bit ids) in place of the ids."""
    return pack(docs, **how).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
