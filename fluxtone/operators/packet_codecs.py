"""Codes of a stream in packets, decoded one packet after another: what the decoder has at the end of one begins the next.

A stream cut into packets at any bytes decodes alike, also where a code lies in two of them. Packets are dealt by
stream and read in order, so no task holds a stream.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from fluxtone.functions.adaptive import G726_CHANGE, IMA_CHANGE, STEPS
from fluxtone.operators.speech import _by_frame


class _Packets:
    """Codes of ``bits`` bits, the high bit first, from bytes; the bits that are left wait for the next packet."""

    def __init__(self, bits: int):
        self.bits, self.waiting, self.held, self.value, self.index = bits, 0, 0, 0, 0

    def feed(self, b: bytes | None) -> tuple[list[int]]:
        out = []
        for byte in b or b"":
            self.waiting, self.held = self.waiting << 8 | byte, self.held + 8
            while self.held >= self.bits:
                self.held -= self.bits
                self.follow(self.waiting >> self.held)
                self.waiting &= (1 << self.held) - 1
                out.append(self.value)
        return (out,)

    def follow(self, code: int) -> None:
        change, step = self.change(code, STEPS[self.index])
        self.value = min(max(self.value + change, -32768), 32767)
        self.index = min(max(self.index + step, 0), len(STEPS) - 1)


class _Ima(_Packets):
    def change(self, code: int, size: int) -> tuple[int, int]:
        low = code & 7
        change = (size >> 3) + (size if low & 4 else 0) + (size >> 1 if low & 2 else 0) + (size >> 2 if low & 1 else 0)
        return -change if code & 8 else change, IMA_CHANGE[low]


class _G726(_Packets):
    def change(self, code: int, size: int) -> tuple[int, int]:
        half = 1 << (self.bits - 1)
        level = half - 1 - code if code < half else code - half
        back = (size * level + size // 2) // 2
        return -back if code < half else back, G726_CHANGE[min(level, 7)]


def decode(packets: DataFrame, codec: str, bits: int = 4) -> DataFrame:
    """stream, frame, v array<int> of (stream, frame, b): samples of each packet; codec is ``ima`` (4 bits) or ``g726`` (2 to 5).

    A null packet is an empty one; bits that fill no code at a stream's end are dropped.
    """
    begin = {"ima": lambda: _Ima(4), "g726": lambda: _G726(bits)}[codec]
    return _by_frame(packets, "b", begin, {"v": ("array<int>", pa.list_(pa.int32()))})
