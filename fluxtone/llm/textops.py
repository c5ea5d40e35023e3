"""Words, word hashes and shingles of many texts at once with numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z count as a-z. All separators are
ASCII, so working on UTF-8 bytes gives the same words as working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: About so many bytes are hashed at a time, which bounds the temporaries whatever a batch holds.
SEGMENT = 1 << 20

_rng = np.random.default_rng(20240607)
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_CODE[65:91] = _CODE[97:123]
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_K = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW, _INV = _powers(_BASE, 2 * SEGMENT), _powers(pow(_BASE, -1, 2**64), 2 * SEGMENT)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _segment_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(buf) > len(_POW):  # a single word longer than two segments
        _POW, _INV = _powers(_BASE, len(buf)), _powers(pow(_BASE, -1, 2**64), len(buf))
    word = np.zeros(len(buf) + 2, dtype=np.int8)
    word[1:-1] = ~_SEP[buf]
    edge = np.flatnonzero(np.diff(word))
    starts, ends = edge[::2], edge[1::2]
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_CODE[buf] * _POW[: len(buf)], dtype=np.uint64, out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * _INV[starts])


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte and 64-bit hash of every word."""
    buf, at, found = np.frombuffer(data, dtype=np.uint8), 0, []
    while at < len(buf):
        end = min(at + SEGMENT, len(buf))
        while end < len(buf) and not _SEP[buf[end - 1]]:
            step = np.flatnonzero(_SEP[buf[end : end + SEGMENT]])
            end = end + int(step[0]) + 1 if len(step) else min(end + SEGMENT, len(buf))
        s, e, h = _segment_words(buf[at:end])
        found.append((s + at, e + at, h))
        at = end
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def joined(texts: list[bytes | None]) -> tuple[bytes, np.ndarray]:
    """The texts with a line feed between any two, and where each starts."""
    texts = [x or b"" for x in texts]
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=starts[1:])
    return b"\n".join(texts), starts


def parts(column: pa.Array, limit: int = 4 * SEGMENT) -> Iterator[tuple[int, list[bytes | None]]]:
    """A text column as lists of UTF-8 texts of about ``limit`` bytes, each with the index of its first row."""
    column = column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column.cast(pa.binary())
    first, held, size = 0, [], 0
    for i, x in enumerate(column.to_pylist()):
        held.append(x)
        size += len(x or b"")
        if size >= limit:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def batch_shingles(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``k`` words; of all words where they are fewer."""
    data, starts = joined(texts)
    at, _, h = words(data)
    bounds = np.searchsorted(at, starts)
    run = np.zeros(max(0, len(h) - k + 1), dtype=np.uint64)
    for j in range(k):
        run += h[j : len(h) - k + 1 + j] * _K[j]
    run = mix(run)
    out = []
    for i in range(len(texts)):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= k:
            out.append(np.unique(run[a : b - k + 1]))
        elif b > a:
            out.append(mix((h[a:b] * _K[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
