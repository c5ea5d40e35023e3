"""Numbers in binary columns. Positions count from 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def u8(b: Column | str, at: int | Column) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(b, at + 1, F.lit(1))), 16, 10).cast("long")


def be(b: Column | str, at: int, size: int) -> Column:
    """Unsigned big-endian number of up to 7 bytes."""
    return F.conv(F.hex(F.substring(b, at + 1, size)), 16, 10).cast("long")


def le(b: Column | str, at: int, size: int) -> Column:
    return sum((u8(b, at + i) * (1 << (8 * i)) for i in range(size)), F.lit(0).cast("long"))


def to_be(n: Column, size: int) -> Column:
    """The low ``size`` bytes of a number, the high one first."""
    return F.unhex(F.lpad(F.hex(n.bitwiseAND((1 << (8 * size)) - 1)), 2 * size, "0"))


def to_le(n: Column, size: int) -> Column:
    return F.concat(*[to_be(F.shiftright(n, 8 * i), 1) for i in range(size)])


def from_hex(digits: Column) -> Column:
    """Unsigned number of up to 15 hexadecimal digits."""
    return F.conv(digits, 16, 10).cast("long")


def _groups(count: Column) -> Column:
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def octets(b: Column) -> Column:
    """The bytes of a binary as numbers."""
    # bytes are found by place at once; characters of a string are not
    return let(b, lambda b: F.transform(_groups(F.octet_length(b)), lambda i: from_hex(F.hex(F.substring(b, i + 1, F.lit(1)))).cast("int")))


def from_octets(values: Column) -> Column:
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))


def pack_codes(codes: Column, bits: int) -> Column:
    """Codes of ``bits`` bits each one after another, the high bit first; zeros fill the last byte.

    Eight codes fill ``bits`` bytes, so they are put together eight at a time.
    """

    def pack(codes: Column) -> Column:
        eight = lambda g: sum((F.shiftleft(F.coalesce(F.get(codes, g * 8 + j), F.lit(0)).cast("long"), bits * (7 - j)) for j in range(8)), F.lit(0).cast("long"))
        digits = F.array_join(F.transform(_groups(F.ceil(F.size(codes) / 8).cast("int")), lambda g: F.lpad(F.hex(eight(g)), 2 * bits, "0")), "")
        return F.unhex(F.substring(digits, F.lit(1), (F.ceil(F.size(codes) * bits / 8) * 2).cast("int")))

    return let(codes, pack)


def unpack_codes(b: Column, bits: int) -> Column:
    """As many whole codes of ``bits`` bits as there are, the high bit first."""

    def unpack(b: Column) -> Column:
        count = F.floor(F.octet_length(b) * 8 / bits).cast("int")
        number = lambda g: from_hex(F.rpad(F.hex(F.substring(b, g * bits + 1, F.lit(bits))), 2 * bits, "0"))
        eight = lambda g: F.array(*[field(number(g), bits * (7 - j), bits).cast("int") for j in range(8)])
        return F.slice(F.flatten(F.transform(_groups(F.ceil(count / 8).cast("int")), eight)), F.lit(1), count)

    return let(b, unpack)


def to_bits(n: Column, width: int) -> Column:
    """The low ``width`` bits of a number as digits."""
    return F.lpad(F.bin(n.cast("long").bitwiseAND((1 << width) - 1)), width, "0")


def bits_of(b: Column) -> Column:
    return F.array_join(F.transform(octets(b), lambda v: to_bits(v, 8)), "")


def from_bits(digits: Column) -> Column:
    """Bytes of a string of binary digits, filled up with zeros."""
    return pack_codes(F.transform(F.filter(F.split(digits, ""), lambda d: d != ""), lambda d: d.cast("int")), 1)


def bits_at(digits: Column, at: int | Column, width: int) -> Column:
    """Number of ``width`` digits from place ``at``; null where there are fewer."""
    at = F.lit(at) if isinstance(at, int) else at
    found = F.substring(digits, at.cast("int") + 1, F.lit(width))
    return F.when(F.length(found) == width, F.conv(found, 2, 10).cast("long"))


def wrap16(n: Column) -> Column:
    return (n + 32768).bitwiseAND(65535) - 32768


def clip16(n: Column) -> Column:
    return F.least(F.greatest(n, F.lit(-32768)), F.lit(32767))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is made once: what a function over an array's elements reads is made again for each of them."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def joined(parts: Column) -> Column:
    """The binaries of an array one after another, in time in proportion to their size; null ones are left out."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def field(n: Column, shift: int, width: int) -> Column:
    """``width`` bits of a number, ``shift`` bits from its low end."""
    return F.shiftright(n, shift).bitwiseAND((1 << width) - 1)


def shifted_left(n: Column, by: int | Column) -> Column:
    return F.call_function("shiftleft", n, F.lit(by) if isinstance(by, int) else by)


def shifted_right(n: Column, by: int | Column) -> Column:
    """Rounds down, also below 0."""
    return F.call_function("shiftright", n, F.lit(by) if isinstance(by, int) else by)
