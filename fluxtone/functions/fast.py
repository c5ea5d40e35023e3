"""Fast transforms of whole blocks held in array columns, one step of the transform a column.

A block of n samples takes n times the sum of its factors, where the sum form takes n times n, and no row is made for
a sample or a bin. Complex numbers are structs (re, im).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPLEX = "array<struct<re:double,im:double>>"


def factors(size: int) -> list[int]:
    """Fours first, then primes from the smallest on."""
    found, left = [], size
    for f in (4, 2, 3, 5, 7):
        while left % f == 0:
            found, left = [*found, f], left // f
    f = 11
    while left > 1:
        while left % f == 0:
            found, left = [*found, f], left // f
        f += 2
    return found


def _complex(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def complex_of(x: Column) -> Column:
    """Real samples as complex ones."""
    return F.transform(x, lambda v: _complex(v.cast("double"), F.lit(0.0)))


def _turned(v: Column, angle: Column) -> Column:
    c, s = F.cos(angle), F.sin(angle)
    return _complex(v["re"] * c - v["im"] * s, v["re"] * s + v["im"] * c)


def padded(x: Column, size: int) -> Column:
    """The first ``size`` samples, with zeros after shorter ones."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.get(x, i), F.lit(0.0)))


def _joined(at: str, size: int, radix: int, done: int, sign: float):
    """The element at place ``i`` after a step that joins ``radix`` transforms of ``done`` samples each."""
    apart, long = size // (done * radix), done * radix

    def element(i: Column) -> Column:
        j, k = F.floor(i / long).cast("int"), i % long
        re = im = None
        for q in range(radix):
            v = F.get(at, (k % done) + done * (j + apart * q))
            if q:
                v = _turned(v, sign * 2 * math.pi * ((k * (q * apart)) % size) / size)
                re, im = re + v["re"], im + v["im"]
            else:
                re, im = v["re"], v["im"]
        return _complex(re, im)

    return element


def fft(rows: DataFrame, at: str, size: int, inverse: bool = False) -> DataFrame:
    """The blocks of ``size`` complex samples in column ``at`` transformed; the inverse is divided by the size.

    A step joins ``radix`` transforms of every ``size / done``-th sample into ones that are ``radix`` times as long.
    They are laid out so that the last step leaves the bins in order.
    """
    done = 1
    for radix in factors(size):
        rows = rows.withColumn(at, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), _joined(at, size, radix, done, 1.0 if inverse else -1.0)))
        done *= radix
    if inverse:
        rows = rows.withColumn(at, F.transform(at, lambda v: _complex(v["re"] / size, v["im"] / size)))
    return rows


def dct4(rows: DataFrame, at: str, size: int) -> DataFrame:
    """Sums of x[n] * cos(pi / size * (n + 1/2) * (k + 1/2)) of an even number of samples, by a transform of half as many complex ones."""
    x, half = F.col(at), size // 2
    angle = lambda n: -math.pi * (8 * n + 1) / (8 * size)
    pairs = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda n: _turned(_complex(F.get(x, 2 * n), F.get(x, size - 1 - 2 * n)), angle(n)))
    rows = fft(rows.withColumn(at, pairs), at, half)
    rows = rows.withColumn(at, F.transform(at, lambda v, k: _turned(v, angle(k))))
    place = lambda i: F.floor(i / 2).cast("int")
    return rows.withColumn(at, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i % 2 == 0, F.get(F.col(at), place(i))["re"]).otherwise(-F.get(F.col(at), place(size - 1 - i))["im"])))


def mdct(rows: DataFrame, at: str, half: int) -> DataFrame:
    """2 * half samples to ``half`` sums of x[n] * cos(pi / half * (n + 1/2 + half / 2) * (k + 1/2)), half being a multiple of 4.

    The block's quarters are folded onto half its length, then a transform of a quarter of it does.
    """
    x, quarter = F.col(at), half // 2
    low = lambda n: -F.get(x, 3 * quarter - 1 - n) - F.get(x, 3 * quarter + n)
    high = lambda n: F.get(x, n - quarter) - F.get(x, 3 * quarter - 1 - n)
    folded = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda n: F.when(n < quarter, low(n)).otherwise(high(n)))
    return dct4(rows.withColumn(at, folded), at, half)


def imdct(rows: DataFrame, at: str, half: int) -> DataFrame:
    """``half`` coefficients to 2 * half sums of c[k] * cos(pi / half * (n + 1/2 + half / 2) * (k + 1/2))."""
    rows, quarter = dct4(rows, at, half), half // 2
    u = lambda i: F.get(F.col(at), i)
    unfolded = lambda n: F.when(n < quarter, u(n + quarter)).when(n < 3 * quarter, -u(3 * quarter - 1 - n)).otherwise(-u(n - 3 * quarter))
    return rows.withColumn(at, F.transform(F.sequence(F.lit(0), F.lit(2 * half - 1)), unfolded))


def slope(n: Column, half: int) -> Column:
    """The power-complementary window of 2 * half samples: its squares at n and n + half sum to 1."""
    return F.sin(F.lit(math.pi / 2) * F.pow(F.sin(math.pi / (2 * half) * (n + 0.5)), 2))


def shaped(x: Column, half: int) -> Column:
    return F.transform(x, lambda v, n: v * slope(n, half))


def band_widths(half: int, bands: int) -> list[int]:
    return [max(1, (b + 1) * half // bands - b * half // bands) for b in range(bands)]


def band_levels(c: Column, half: int, bands: int = 21) -> Column:
    """Codes of 6 bits of bands' levels, twice the dB above -28; a silent band has -100 dB. Bands past the end are silent."""
    codes, at = [], 0
    for width in band_widths(half, bands):
        power = F.aggregate(F.slice(c, F.lit(at + 1), F.lit(width)), F.lit(0.0), lambda a, v: a + v * v)
        level = F.when(power > 0, 20 * F.log10(F.sqrt(power / width))).otherwise(-100.0)
        codes.append(F.least(F.greatest(((level + 28) * 2).cast("int"), F.lit(0)), F.lit(63)))
        at += width
    return F.array(*codes)
