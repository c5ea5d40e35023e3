"""G.711 companding, sample by sample.

Encoding finds the segment of a magnitude from its leading bit in closed form; decoding is arithmetic on the
code, so neither needs a table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _top_bit(n: Column) -> Column:
    """Number of bits below the leading one of a positive number."""
    return F.length(F.bin(n.cast("long"))) - 1


def alaw_encode(v: Column) -> Column:
    """16-bit sample to A-law code: sign, 3-bit segment, 4-bit step, alternate bits inverted."""
    m = F.when(v < 0, -v - 1).otherwise(v).cast("int")
    segment = F.greatest(_top_bit(F.greatest(m, F.lit(1))) - 7, F.lit(0))
    low = F.shiftright(m, 4)
    high = F.floor(m / F.pow(F.lit(2.0), segment + 3)).cast("int")
    code = segment * 16 + F.when(segment < 2, low).otherwise(high).bitwiseAND(15)
    return F.when(v < 0, code.bitwiseXOR(0x55)).otherwise(code.bitwiseXOR(0xD5)).cast("int")


def alaw_decode(code: Column) -> Column:
    c = code.bitwiseXOR(0x55)
    mantissa, segment = c.bitwiseAND(15) * 16, F.shiftright(c, 4).bitwiseAND(7)
    m = F.when(segment == 0, mantissa + 8).otherwise(((mantissa + 0x108) * F.pow(F.lit(2.0), segment - 1)).cast("int"))
    return F.when(c.bitwiseAND(0x80) != 0, m).otherwise(-m).cast("int")


def ulaw_encode(v: Column) -> Column:
    """16-bit sample to mu-law code. The magnitude is quartered, clipped and biased; -1 is like any other sample."""
    q = F.shiftright(v, 2)
    m = F.least(F.when(q < 0, -q).otherwise(q), F.lit(8159)) + 33
    segment = F.greatest(_top_bit(m) - 5, F.lit(0))
    code = F.when(segment >= 8, F.lit(127)).otherwise(segment * 16 + F.floor(m / F.pow(F.lit(2.0), segment + 1)).cast("int").bitwiseAND(15))
    return F.when(q < 0, code.bitwiseXOR(0x7F)).otherwise(code.bitwiseXOR(0xFF)).cast("int")


def ulaw_decode(code: Column) -> Column:
    c = F.lit(255) - code
    m = ((c.bitwiseAND(15) * 8 + 0x84) * F.pow(F.lit(2.0), F.shiftright(c, 4).bitwiseAND(7))).cast("int") - 0x84
    return F.when(c.bitwiseAND(0x80) != 0, -m).otherwise(m).cast("int")
