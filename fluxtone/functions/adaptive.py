"""Codecs whose step size adapts: IMA ADPCM, and simple G.722- and G.726-like ones.

Each is a fold over a frame's samples or codes with integer state. ``start`` may bring the state of the frame
before (columns), so a stream can go on; by default each frame starts anew.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxtone.functions.bits import clip16, le, pack_codes, to_be, to_le, u8, unpack_codes, wrap16
from fluxtone.functions.filters import scan

# Step sizes and step changes of the IMA scheme, and of the G.726-like one.
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
IMA_CHANGE = (-1, -1, -1, -1, 2, 4, 6, 8)
G726_CHANGE = (0, 0, 0, 1, 2, 4, 8, 16)


def _pick(values: tuple[int, ...], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at)


def _index(at: Column) -> Column:
    return F.least(F.greatest(at, F.lit(0)), F.lit(len(STEPS) - 1))


def ima_encode(v: Column, start: tuple[Column, Column] | None = None) -> Column:
    """4-bit codes: sign and three successive comparisons with step, step / 2 and step / 4."""
    first, index = start or (F.lit(0), F.lit(0))

    def step(s, x):
        size = _pick(STEPS, s["index"])
        diff = x - s["value"]
        size_a = F.abs(diff)
        bit4 = (size_a >= size).cast("int")
        rest = size_a - bit4 * size
        half = F.shiftright(size, 1)
        bit2 = (rest >= half).cast("int")
        rest = rest - bit2 * half
        quarter = F.shiftright(size, 2)
        bit1 = (rest >= quarter).cast("int")
        change = F.shiftright(size, 3) + bit4 * size + bit2 * half + bit1 * quarter
        code = bit4 * 4 + bit2 * 2 + bit1
        return {"value": clip16(s["value"] + F.when(diff < 0, -change).otherwise(change)), "index": _index(s["index"] + _pick(IMA_CHANGE, code)), "code": code + F.when(diff < 0, 8).otherwise(0)}

    return scan(v, {"value": first.cast("int"), "index": index.cast("int"), "code": F.lit(0)}, step, "code", "int")


def ima_decode(codes: Column, start: tuple[Column, Column] | None = None) -> Column:
    first, index = start or (F.lit(0), F.lit(0))

    def step(s, code):
        size, low = _pick(STEPS, s["index"]), code.bitwiseAND(7)
        change = F.shiftright(size, 3) + F.when(low >= 4, size).otherwise(0) + F.when(low.bitwiseAND(2) > 0, F.shiftright(size, 1)).otherwise(0) + F.when(low.bitwiseAND(1) > 0, F.shiftright(size, 2)).otherwise(0)
        return {"value": clip16(s["value"] + F.when(code >= 8, -change).otherwise(change)), "index": _index(s["index"] + _pick(IMA_CHANGE, low))}

    return scan(codes, {"value": first.cast("int"), "index": index.cast("int")}, step, "value", "int")


def ima_pack(codes: Column) -> Column:
    """Hex of two codes a byte, the first one in the high half; a half left over is 0."""
    digits = F.array_join(F.transform(codes, lambda c: F.lower(F.hex(c))), "")
    return F.when(F.size(codes) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits)


def ima_stream(v: Column, start: tuple[Column, Column] | None = None) -> Column:
    """Bytes of a frame: the state before it (value, low byte first, and step index, a byte of 0), then its codes, two a byte."""
    value, index = start or (F.lit(0), F.lit(0))
    return F.concat(to_le(value.cast("long"), 2), to_be(index.cast("long"), 1), F.lit(b"\x00"), pack_codes(ima_encode(v, start), 4))


def ima_from_stream(b: Column) -> Column:
    """Samples of such bytes, two for each byte of codes; null where the four bytes of the state are not there."""
    start = (wrap16(le(b, 0, 2)).cast("int"), _index(u8(b, 2).cast("int")))
    return F.when(F.octet_length(b) >= 4, ima_decode(unpack_codes(F.substring(b, F.lit(5), F.octet_length(b)), 4), start))


def g726_encode(v: Column, bits: int = 4, start: tuple[Column, Column] | None = None) -> Column:
    half = 1 << (bits - 1)
    first, index = start or (F.lit(0), F.lit(0))

    def step(s, x):
        size = _pick(STEPS, s["index"])
        diff = x - s["value"]
        level = F.least(F.floor(F.abs(diff) / size).cast("int"), F.lit(half - 1))
        back = size * level + F.floor(size / 2).cast("int")
        return {"value": clip16(s["value"] + F.when(diff < 0, -F.floor(back / 2)).otherwise(F.floor(back / 2)).cast("int")), "index": _index(s["index"] + _pick(G726_CHANGE, F.least(level, F.lit(7)))), "code": F.when(diff < 0, half - 1 - level).otherwise(half + level)}

    return scan(v, {"value": first.cast("int"), "index": index.cast("int"), "code": F.lit(0)}, step, "code", "int")


def g726_decode(codes: Column, bits: int = 4, start: tuple[Column, Column] | None = None) -> Column:
    half = 1 << (bits - 1)
    first, index = start or (F.lit(0), F.lit(0))

    def step(s, code):
        size = _pick(STEPS, s["index"])
        level = F.when(code < half, half - 1 - code).otherwise(code - half)
        back = F.floor((size * level + F.floor(size / 2)) / 2).cast("int")
        return {"value": clip16(s["value"] + F.when(code < half, -back).otherwise(back)), "index": _index(s["index"] + _pick(G726_CHANGE, F.least(level, F.lit(7))))}

    return scan(codes, {"value": first.cast("int"), "index": index.cast("int")}, step, "value", "int")


def g726_stream(v: Column, bits: int = 4, start: tuple[Column, Column] | None = None) -> Column:
    """Bytes of a frame's codes, the high bit first."""
    return pack_codes(g726_encode(v, bits, start), bits)


def g726_from_stream(b: Column, bits: int = 4, start: tuple[Column, Column] | None = None) -> Column:
    return g726_decode(unpack_codes(b, bits), bits, start)


def _band(s: Column, name: str, code: Column, bits: int) -> dict[str, Column]:
    """A band's new state after a code: prediction moved by the code's level, step changed."""
    levels = 1 << bits
    size, value = s[f"{name}_size"], s[f"{name}_value"]
    moved = F.when(code == 0, -size * (levels // 2)).otherwise(size * (code - levels // 2 + 0.5))
    fold = F.least(code, levels - 1 - code)
    return {f"{name}_value": F.least(F.greatest(value + moved, F.lit(-32768.0)), F.lit(32767.0)), f"{name}_size": F.when(fold < 8, F.greatest(F.lit(1.0), size + _pick(IMA_CHANGE, fold))).otherwise(size)}



def _g722_start() -> dict[str, Column]:
    return {"low_value": F.lit(0.0), "low_size": F.lit(16.0), "high_value": F.lit(0.0), "high_size": F.lit(16.0)}


def _quantize(s: Column, name: str, sample: Column, bits: int) -> Column:
    levels = 1 << bits
    wanted = F.rint((sample - s[f"{name}_value"]) / s[f"{name}_size"] + levels / 2 - 0.5).cast("int")
    return F.least(F.greatest(wanted, F.lit(0)), F.lit(levels - 1))


def pairs(v: Column) -> Column:
    return F.when(F.size(v) < 2, F.array().cast("array<struct<a:int,b:int>>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int") - 1), lambda i: F.struct(F.get(v, i * 2).alias("a"), F.get(v, i * 2 + 1).alias("b"))))


def g722_encode(v: Column) -> Column:
    """A byte for each pair of samples: 6 bits of half the sum, 2 bits of half the difference."""

    def step(s, p):
        low = _quantize(s, "low", ((p["a"] + p["b"]) / 2.0).cast("int"), 6)
        high = _quantize(s, "high", ((p["a"] - p["b"]) / 2.0).cast("int"), 2)
        return {**_band(s, "low", low, 6), **_band(s, "high", high, 2), "code": low * 4 + high}

    return scan(pairs(v), {**_g722_start(), "code": F.lit(0)}, step, "code", "int")


def g722_decode(codes: Column) -> Column:
    """Two samples for each byte, interleaved."""

    def step(s, code):
        new = {**_band(s, "low", F.shiftright(code, 2), 6), **_band(s, "high", code.bitwiseAND(3), 2)}
        low, high = F.rint(new["low_value"]).cast("int"), F.rint(new["high_value"]).cast("int")
        return {**new, "both": clip16(low + high) * 65536 + (clip16(low - high) + 32768)}

    both = scan(codes, {**_g722_start(), "both": F.lit(0)}, step, "both", "int")
    return F.flatten(F.transform(both, lambda c: F.array(F.shiftright(c, 16), c.bitwiseAND(65535) - 32768)))
