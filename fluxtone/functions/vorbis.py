"""The third header of a Vorbis stream: codebooks, floors, residues, mappings and modes.

Its bits are packed the low one first: a field's low bit comes first, and fills a byte from its low end. The
parts to write are columns; the reader is a walk over one header, of the stream's first packets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = b"\x05vorbis"
#: What begins a codebook: three letters, the last one first.
SYNC = 0x564342


def codebook(dimensions: Column, lengths: Column) -> Column:
    """A codebook without values: a length (1 to 32) for each entry, 0 for one that isn't used."""
    return F.struct(dimensions.alias("dimensions"), lengths.alias("lengths"))


def floor_of(posts: Column, bits: int = 8) -> Column:
    """A floor of kind 1: a partition of one class, whose dimension is the number of posts (1 to 8)."""
    return F.struct(posts.alias("posts"), F.lit(bits).alias("bits"))


def residue(kind: Column, size: Column, classes: Column) -> Column:
    """A residue of kind 0 to 2 over lines 0 to 1024, in parts of ``size``, whose ``classes`` have no book."""
    return F.struct(kind.alias("kind"), size.alias("size"), classes.alias("classes"))


def setup(books: Column, floors: Column, residues: Column, modes: Column) -> Column:
    """A setup header of arrays of its parts, one mapping (floor and residue 0, no coupling), and modes as flags of long blocks.

    ``operators.containers.setup_headers`` makes its bytes.
    """
    return F.struct(books.alias("books"), floors.alias("floors"), residues.alias("residues"), modes.alias("modes"))


def _in_turn(at: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where parts of ``sizes`` bits begin that follow one another from their owner's place on, and where each owner's end."""
    each = np.bincount(owner, sizes, len(at)).astype(np.int64)
    before = np.cumsum(each) - each
    return (at - before)[owner] + np.cumsum(sizes) - sizes, at + each


def setup_bytes(parts: pa.StructArray) -> pa.Array:
    """Bytes of setup headers from what ``setup`` holds; null where a part or one of its numbers is.

    The headers' bits lie one after another in one array, and a field is written for all of them at once.
    """
    missing = parts.is_null().to_numpy(zero_copy_only=False).copy()

    def numbers(a: pa.Array, row: np.ndarray) -> np.ndarray:
        missing[row[a.is_null().to_numpy(zero_copy_only=False)]] = True
        return pc.fill_null(a, 0).to_numpy(zero_copy_only=False).astype(np.int64)

    def spread(lists: pa.ListArray, row: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        count = numbers(pc.list_value_length(lists), row)
        return lists.flatten(), count, np.repeat(np.arange(len(count)), count)

    def part(listed: pa.ListArray) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
        values, count, row = spread(listed, every)
        missing[row[values.is_null().to_numpy(zero_copy_only=False)]] = True
        return values.flatten(), count, row

    def write(at: np.ndarray, n: np.ndarray | int, width: int) -> None:
        for j in range(width):
            if not isinstance(n, int):
                bits[at + j] |= (n >> j & 1).astype(np.uint8)
            elif n >> j & 1:
                bits[at + j] = 1

    every, (books, floors, residues, modes) = np.arange(len(parts)), parts.flatten()
    (dimensions, lengths), book_count, book_row = part(books)
    dimensions, (lengths, entry_count, book) = numbers(dimensions, book_row), spread(lengths, book_row)
    lengths = pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    (posts, post_bits), floor_count, floor_row = part(floors)
    post_bits, (posts, post_count, floor) = numbers(post_bits, floor_row), spread(posts, floor_row)
    posts = numbers(posts, floor_row[floor])
    of_residue, residue_count, residue_row = part(residues)
    kind, size, classes = (numbers(a, residue_row) for a in of_residue)
    modes, mode_count, mode_row = spread(modes, every)
    modes = pc.fill_null(modes, False).to_numpy(zero_copy_only=False).astype(np.int64)

    entry_size = np.where(lengths > 0, 1 + 5, 1)
    book_size = 24 + 16 + 24 + 2 + np.bincount(book, entry_size, len(dimensions)).astype(np.int64) + 4
    floor_size = 16 + 5 + 4 + (3 + 2 + 8) + 2 + 4 + post_count * post_bits
    residue_size = 16 + 24 + 24 + 24 + 6 + 8 + 4 * classes
    sizes = 8 * len(MARK) + 8 + (6 + 16) + 6 + 6 + (6 + 16 + 2 + 2 + 3 * 8) + 6 + (1 + 16 + 16 + 8) * mode_count + 1
    for row, size_of in ((book_row, book_size), (floor_row, floor_size), (residue_row, residue_size)):
        sizes += np.bincount(row, size_of, len(parts)).astype(np.int64)
    ends = np.cumsum((sizes + 7) // 8)
    begins = ends - (sizes + 7) // 8
    bits = np.zeros(8 * int(ends[-1]) + 64 if len(ends) else 0, np.uint8)

    at = 8 * begins
    write(at, int.from_bytes(MARK, "little"), 8 * len(MARK))
    write(at + 8 * len(MARK), book_count - 1, 8)
    begin, at = _in_turn(at + 8 * len(MARK) + 8, book_row, book_size)
    write(begin, SYNC, 24)
    write(begin + 24, dimensions, 16)
    write(begin + 40, entry_count, 24)
    write(begin + 64, 2, 2)
    begin, _ = _in_turn(begin + 66, book, entry_size)
    write(begin[lengths > 0], 1 + 2 * (lengths[lengths > 0] - 1 & 31), 6)
    at = at + 6 + 16
    write(at, floor_count - 1, 6)
    begin, at = _in_turn(at + 6, floor_row, floor_size)
    write(begin, 1, 16)
    write(begin + 16, 1, 5)
    write(begin + 25, post_count - 1, 3)
    write(begin + 38, 1, 2)
    write(begin + 40, post_bits, 4)
    begin, _ = _in_turn(begin + 44, floor, post_bits[floor])
    write(begin, posts & (1 << post_bits[floor]) - 1, int(post_bits.max(initial=0)))
    write(at, residue_count - 1, 6)
    begin, at = _in_turn(at + 6, residue_row, residue_size)
    write(begin, kind, 16)
    write(begin + 40, 1024, 24)
    write(begin + 64, size - 1, 24)
    write(begin + 88, classes - 1, 6)
    at = at + 6 + 16 + 2 + 2 + 3 * 8
    write(at, mode_count - 1, 6)
    begin, at = _in_turn(at + 6, mode_row, np.full(len(modes), 1 + 16 + 16 + 8))
    write(begin, modes, 1)
    write(at, 1, 1)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    made = pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(offsets), pa.py_buffer(np.packbits(bits, bitorder="little"))])
    return pc.if_else(pa.array(missing), pa.scalar(None, pa.binary()), made) if missing.any() else made


class _Bits:
    def __init__(self, b: bytes):
        self.value, self.left = int.from_bytes(b, "little"), 8 * len(b)

    def take(self, width: int) -> int:
        if width > self.left:
            raise EOFError
        found = self.value & ((1 << width) - 1)
        self.value, self.left = self.value >> width, self.left - width
        return found


def _codebook(bits: _Bits) -> tuple[int, int, int, int]:
    if bits.take(24) != SYNC:
        raise ValueError
    dimensions, entries, total = bits.take(16), bits.take(24), 0
    if bits.take(1):  # lengths in order
        at, length = 0, bits.take(5) + 1
        while at < entries:
            count = bits.take((entries - at).bit_length())
            at, total, length = at + count, total + count * length, length + 1
    else:
        sparse = bits.take(1)
        for _ in range(entries):
            if not sparse or bits.take(1):
                total += bits.take(5) + 1
    lookup = bits.take(4)
    if lookup > 2:
        raise ValueError
    if lookup:
        bits.take(64)
        width, _ = bits.take(4) + 1, bits.take(1)
        values = entries * dimensions if lookup == 2 else max(n for n in range(entries + 1) if n**dimensions <= entries) if dimensions else 0
        for _ in range(values):
            bits.take(width)
    return lookup, entries, dimensions, total


def _floor(bits: _Bits) -> tuple[int, int, int, int]:
    kind = bits.take(16)
    if kind == 0:
        order, _, _, _, _ = bits.take(8), bits.take(16), bits.take(16), bits.take(6), bits.take(8)
        books = bits.take(4) + 1
        for _ in range(books):
            bits.take(8)
        return kind, order, books, 0
    if kind != 1:
        raise ValueError
    parts = [bits.take(4) for _ in range(bits.take(5))]
    sizes = []
    for _ in range(max(parts, default=-1) + 1):
        sizes.append(bits.take(3) + 1)
        subclasses = bits.take(2)
        if subclasses:
            bits.take(8)
        for _ in range(1 << subclasses):
            bits.take(8)
    bits.take(2)
    width = bits.take(4)
    posts = [bits.take(width) for p in parts for _ in range(sizes[p])]
    return kind, len(parts), len(posts), sum(posts)


def _residue(bits: _Bits) -> tuple[int, int, int, int]:
    kind = bits.take(16)
    if kind > 2:
        raise ValueError
    begin, end, size, classes = bits.take(24), bits.take(24), bits.take(24) + 1, bits.take(6) + 1
    bits.take(8)
    books = 0
    for _ in range(classes):
        low = bits.take(3)
        books += (low | (bits.take(5) << 3 if bits.take(1) else 0)).bit_count()
    for _ in range(books):
        bits.take(8)
    return kind, classes, size, end - begin


def _mapping(bits: _Bits, channels: int) -> tuple[int, int, int, int]:
    if bits.take(16):
        raise ValueError
    submaps = bits.take(4) + 1 if bits.take(1) else 1
    steps = bits.take(8) + 1 if bits.take(1) else 0
    for _ in range(2 * steps):
        bits.take(max(channels - 1, 0).bit_length())
    if bits.take(2):
        raise ValueError
    for _ in range(channels if submaps > 1 else 0):
        bits.take(4)
    for _ in range(3 * submaps):
        bits.take(8)
    return 0, submaps, steps, 0


SETUP = "part string, k int, kind int, n int, size int, total long"


def setup_rows(b: bytes | None, channels: int) -> Iterator[tuple]:
    """part, k, kind, n, size, total of a setup header; none of a header that is cut off or not one.

    Of a codebook n are entries, size dimensions, total the sum of code lengths; of a floor partitions, posts and their
    sum; of a residue classes, the size of a part and all lines; of a mapping submaps and coupling steps; of a mode
    kind tells long blocks, and n is the mapping.
    """
    if b is None or bytes(b[:7]) != MARK:
        return
    bits, rows = _Bits(bytes(b[7:])), []
    try:
        rows += [("codebook", k, *_codebook(bits)) for k in range(bits.take(8) + 1)]
        if any(bits.take(16) for _ in range(bits.take(6) + 1)):
            return
        rows += [("floor", k, *_floor(bits)) for k in range(bits.take(6) + 1)]
        rows += [("residue", k, *_residue(bits)) for k in range(bits.take(6) + 1)]
        rows += [("mapping", k, *_mapping(bits, channels)) for k in range(bits.take(6) + 1)]
        for k in range(bits.take(6) + 1):
            long, window, transform, mapping = bits.take(1), bits.take(16), bits.take(16), bits.take(8)
            if window or transform:
                return
            rows.append(("mode", k, long, mapping, 0, 0))
        if not bits.take(1):
            return
    except (EOFError, ValueError):
        return
    yield from rows
