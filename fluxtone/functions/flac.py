"""Columns of lossless frames: integer predictors, Rice codes in partitions, headers and checksums.

A block of samples is an array<long>, a stream of bits a string of binary digits (``bits.from_bits`` and ``bits_of``
go between those and bytes). Predictors are sums of weighted earlier samples, shifted right: the fixed ones have
small weights and no shift, the others weights from the block's autocorrelation, rounded to ``PRECISION`` bits.
All that decides what is written is computed in integers, or in doubles one operation after another.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxtone.functions.bits import bits_at, bits_of, from_bits, from_octets, let, octets, shifted_left, shifted_right, to_bits
from fluxtone.functions.filters import scan

# Weights of the samples before, by order of the fixed predictors.
FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}
# Codes of sample rates, and of sample sizes, in a frame's header; 0 leaves either to the stream's header.
RATES = {88200: 1, 176400: 2, 192000: 3, 8000: 4, 16000: 5, 22050: 6, 24000: 7, 32000: 8, 44100: 9, 48000: 10, 96000: 11}
SIZES = {8: 1, 12: 2, 16: 4, 20: 5, 24: 6, 32: 7}
# Kinds of subframes; orders are added to FIX (from 0) and LPC (from 1).
CONSTANT, VERBATIM, FIX, LPC = 0, 1, 8, 31
#: Orders that are tried, bits of a weight, and the most times that a block is halved into partitions.
ORDERS = (1, 2, 4, 8, 16, 32)
PRECISION, HALVINGS = 12, 3
ESCAPE = 15
#: Bits of Rice parameters, by the method in a residual's first two bits.
WIDTHS = (4, 5)


def crc_table(polynomial: int, width: int) -> list[int]:
    """The checksum of each byte value, the high bit first."""
    table = []
    for value in range(256):
        crc = value << (width - 8)
        for _ in range(8):
            crc = (crc << 1) ^ (polynomial if crc >> (width - 1) & 1 else 0)
            crc &= (1 << width) - 1
        table.append(crc)
    return table


def _crc(b: Column, polynomial: int, width: int) -> Column:
    table, mask = F.array(*[F.lit(v) for v in crc_table(polynomial, width)]), (1 << width) - 1
    step = lambda crc, v: shifted_left(crc, 8).bitwiseAND(mask).bitwiseXOR(F.get(table, shifted_right(crc, width - 8).bitwiseXOR(v)))
    return F.aggregate(octets(b), F.lit(0), step)


def crc8(b: Column) -> Column:
    return _crc(b, 0x07, 8)


def crc16(b: Column) -> Column:
    return _crc(b, 0x8005, 16)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)


def _weighted(weights: Column, values: Column) -> Column:
    return total(F.zip_with(weights, values, lambda a, b: a * b))


def _numbers(first: int | Column, last: Column) -> Column:
    """first to last; empty where last is less."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def autocorrelations(v: Column, lags: int) -> Column:
    """array<double> of the sums of products of samples 0 to ``lags`` apart, exact in integers."""
    apart = lambda v, lag: F.when(F.size(v) > lag, _weighted(F.slice(v, F.lit(1), F.size(v) - lag), F.slice(v, lag + 1, F.size(v)))).otherwise(0).cast("double")
    return let(v, lambda v: F.transform(F.sequence(F.lit(0), F.lit(lags)), lambda lag: apart(v, lag)))


def predictors(r: Column, order: int) -> Column:
    """array<array<double>>: the weights of orders 1 to ``order`` for autocorrelations 0 to ``order``, by Levinson's recursion."""
    none = F.array().cast("array<double>")
    start = F.struct(none.alias("a"), F.get(r, F.lit(0)).alias("error"), F.array().cast("array<array<double>>").alias("all"))

    def merge(s: Column, i: Column) -> Column:
        done = F.aggregate(F.transform(s["a"], lambda w, j: w * F.get(r, i - 1 - j)), F.lit(0.0), lambda x, y: x + y)
        found = let(F.when(s["error"] > 0, (F.get(r, i) - done) / s["error"]).otherwise(0.0), lambda k: F.struct(k.alias("k"), F.array_append(F.zip_with(s["a"], F.reverse(s["a"]), lambda x, y: x - k * y), k).alias("a")))
        return let(found, lambda f: F.struct(f["a"].alias("a"), (s["error"] * (1 - f["k"] * f["k"])).alias("error"), F.array_append(s["all"], f["a"]).alias("all")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(order)), start, merge, lambda s: s["all"])


def quantised(a: Column, precision: int = PRECISION) -> Column:
    """struct<q array<long>, shift int>: weights as integers, the largest of 0 to 15 bits of shift that they fit with; null where none does."""
    most = (1 << (precision - 1)) - 1

    def fit(a: Column) -> Column:
        high = F.array_max(F.transform(a, F.abs))
        shift = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(15)), lambda s: high * shifted_left(F.lit(1), s) <= most))
        return let(shift, lambda s: F.when(s.isNotNull(), F.struct(F.transform(a, lambda w: F.floor(w * shifted_left(F.lit(1), s) + 0.5).cast("long")).alias("q"), s.alias("shift"))))

    return let(a, fit)


def residual(v: Column, q: Column, shift: Column) -> Column:
    """What a predictor leaves of all samples but the first ones, as many as it has weights."""
    order = F.size(q)
    newest_first = lambda i: F.reverse(F.slice(v, i + 1, order))
    return F.transform(F.slice(v, order + 1, F.size(v)), lambda x, i: x - shifted_right(_weighted(q, newest_first(i)), shift))


def restore(first: Column, left: Column, q: Column, shift: Column) -> Column:
    """The samples again from the first ones and a predictor's residual, for any order."""
    start = {"x": F.lit(0).cast("long"), "past": F.reverse(first)}

    def step(s: Column, e: Column) -> dict[str, Column]:
        x = e + shifted_right(_weighted(q, s["past"]), shift)
        return {"x": x, "past": F.slice(F.concat(F.array(x), s["past"]), F.lit(1), F.size(q))}

    return F.concat(first, scan(left, start, step, "x", "long"))


def zigzag(v: Column) -> Column:
    return F.when(v >= 0, 2 * v).otherwise(-2 * v - 1)


def parameter(z: Column) -> Column:
    """struct<bits, k>: the least size of the Rice codes of zigzag numbers, and the parameter (0 to 14) that has it."""
    size = lambda z, k: total(F.transform(z, lambda v: shifted_right(v, k))) + F.size(z) * (k + 1)
    return let(z, lambda z: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(ESCAPE - 1)), lambda k: F.struct(size(z, k).alias("bits"), k.alias("k")))))


def _cut(z: Column, order: Column, halvings: Column) -> Column:
    """Residuals by partition: a block in equal parts, of which the first lacks the samples that have no residual."""
    part = shifted_right(F.size(z) + order, halvings)
    start = lambda j: F.greatest(part * j - order, F.lit(0))
    return F.transform(F.sequence(F.lit(0), shifted_left(F.lit(1), halvings) - 1), lambda j: F.slice(z, start(j) + 1, part * (j + 1) - order - start(j)))


def partitions(z: Column, order: Column, most: int = HALVINGS) -> Column:
    """struct<bits, halvings, k array<int>>: how often a block is halved for the least size, with each partition's parameter."""

    def of(z: Column, halvings: Column) -> Column:
        found = F.transform(_cut(z, order, halvings), parameter)
        return let(found, lambda f: F.struct((total(F.transform(f, lambda p: p["bits"] + WIDTHS[0])) + 6).alias("bits"), halvings.alias("halvings"), F.transform(f, lambda p: p["k"]).alias("k")))

    def best(z: Column) -> Column:
        n = F.size(z) + order
        fits = lambda h: ((n % shifted_left(F.lit(1), h)) == 0) & (shifted_right(n, h) > order)
        allowed = F.filter(F.sequence(F.lit(0), F.lit(most)), lambda h: (h == 0) | fits(h))
        return F.array_min(F.transform(allowed, lambda h: of(z, h)))

    return let(z, best)


def code(z: Column, k: Column) -> Column:
    """A Rice code as digits: the quotient in zeros, a one, and ``k`` digits of the rest."""
    low = F.when(k > 0, F.lpad(F.bin(z.bitwiseAND(shifted_left(F.lit(1), k) - 1)), k, "0")).otherwise("")
    return F.concat(F.repeat(F.lit("0"), shifted_right(z, k).cast("int")), F.lit("1"), low)


def residual_digits(z: Column, order: Column, plan: Column) -> Column:
    """The coded residual: method, halvings, and each partition's parameter and codes."""
    part = lambda own, k: F.concat(to_bits(k, WIDTHS[0]), F.array_join(F.transform(own, lambda v: code(v, k)), ""))
    return F.concat(F.lit("00"), to_bits(plan["halvings"], 4), F.array_join(F.zip_with(_cut(z, order, plan["halvings"]), plan["k"], part), ""))


def signed(v: Column, width: Column) -> Column:
    """The low ``width`` bits (1 to 62) of a number as digits."""
    return F.lpad(F.bin(v.bitwiseAND(shifted_left(F.lit(1).cast("long"), width) - 1)), width, "0")


def wasted(v: Column) -> Column:
    """Low bits that are 0 in all samples; 0 for a block of zeros."""
    every = F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    return let(every, lambda e: F.when(e == 0, 0).otherwise(F.bit_count(e.bitwiseXOR(e - 1)) - 1).cast("int"))


def codes(rest: Column, pattern: Column, count: Column) -> Column:
    """The first ``count`` codes; a code begins where the one before it ends, as any digit begins one."""
    return F.slice(F.regexp_extract_all(rest, pattern, F.lit(0)), F.lit(1), count)


def after(rest: Column, digits: Column | int) -> Column:
    return F.substring(rest, (F.lit(digits) if isinstance(digits, int) else digits) + 1, F.length(rest))


def to_signed(digits: Column) -> Column:
    """The number of a string of digits whose first is the sign; null for no digits."""
    plain = F.conv(digits, 2, 10).cast("long")
    return F.when(F.length(digits) > 0, plain - F.when(F.substring(digits, 1, 1) == "1", shifted_left(F.lit(1).cast("long"), F.length(digits))).otherwise(0))


def decoded(code: Column, k: Column) -> Column:
    low = F.when(k > 0, F.conv(F.substring(code, F.length(code) - k + 1, k), 2, 10).cast("long")).otherwise(0)
    z = shifted_left((F.length(code) - 1 - k).cast("long"), k) + low
    return F.when(z % 2 == 0, shifted_right(z, 1)).otherwise(-shifted_right(z + 1, 1))


def coded_number(n: Column) -> Column:
    """A number below 2^36 in the one to seven bytes of the long form of UTF-8."""
    later = lambda count: [shifted_right(n, 6 * (count - 1 - i)).bitwiseAND(63).bitwiseOR(128) for i in range(count)]
    found = F.when(n < 128, F.array(n))
    for count in range(1, 7):
        lead = (0xFF << (7 - count)) & 0xFF
        room = 5 * count + 6 if count < 6 else 36
        found = found.when(n < 1 << room, F.array(shifted_right(n, 6 * count).bitwiseOR(lead), *later(count)))
    return from_octets(found)


def head(number: Column, samples: Column, layout: Column, rate: int, width: int) -> Column:
    """A frame's header without its checksum."""
    small, n = samples <= 256, (samples - 1).cast("long")
    fields = F.concat(F.lit("1111111111111000"), F.when(small, "0110").otherwise("0111"), F.lit(f"{RATES.get(rate, 0):04b}"), to_bits(layout, 4), F.lit(f"{SIZES.get(width, 0):03b}0"))
    return F.concat(from_bits(fields), coded_number(number), F.unhex(F.when(small, F.lpad(F.hex(n), 2, "0")).otherwise(F.lpad(F.hex(n), 4, "0"))))


def frame_head(b: Column) -> Column:
    """struct<number, samples, rate, layout, width, size> of bytes that begin with a frame's header; null where its checksum or a field is wrong.

    ``number`` is the frame's number, or where frames have unlike sizes its first sample's; ``rate`` and ``width`` are
    null where the stream's header has them; ``size`` is that of the header with its checksum.
    """

    def fields(o: Column) -> Column:
        at = lambda i: F.get(o, F.lit(i) if isinstance(i, int) else i)
        lead = at(4)
        extra = F.when(lead < 0x80, 0)  # a lead byte of 10xxxxxx or 11111111 is none
        for count in range(1, 7):
            extra = extra.when(lead.between((0xFF << (7 - count)) & 0xFF, ((0xFF << (6 - count)) & 0xFF) - 1 if count < 6 else 0xFE), count)
        block, rate, layout, width = shifted_right(at(2), 4), at(2).bitwiseAND(15), shifted_right(at(3), 4), shifted_right(at(3), 1).bitwiseAND(7)

        def rest(extra: Column) -> Column:
            low = F.when(extra == 0, lead).otherwise(lead.bitwiseAND(shifted_left(F.lit(1), F.greatest(6 - extra, F.lit(0))) - 1))
            number = F.aggregate(F.slice(o, 6, extra), low.cast("long"), lambda a, x: a * 64 + x.bitwiseAND(63))
            after = 5 + extra
            one, two = at(after), at(after) * 256 + at(after + 1)
            samples = F.when(block == 1, 192).when(block.between(2, 5), shifted_left(F.lit(576), F.greatest(block - 2, F.lit(0)))).when(block == 6, one + 1).when(block == 7, two + 1).when(block >= 8, shifted_left(F.lit(256), F.greatest(block - 8, F.lit(0))))
            after = after + F.when(block == 6, 1).when(block == 7, 2).otherwise(0)
            known = F.element_at(F.create_map(*[F.lit(x) for r, c in RATES.items() for x in (c, r)]), rate)
            spelled = F.when(rate == 12, at(after) * 1000).when(rate == 13, at(after) * 256 + at(after + 1)).when(rate == 14, (at(after) * 256 + at(after + 1)) * 10)
            bits = F.element_at(F.create_map(*[F.lit(x) for w, c in SIZES.items() for x in (c, w)]), width)
            size = after + F.when(rate == 12, 1).when(rate.between(13, 14), 2).otherwise(0) + 1
            right = (at(0) == 0xFF) & (at(1).bitwiseAND(0xFE) == 0xF8) & samples.isNotNull() & (rate != 15) & (layout <= 10) & (width != 3) & (at(3).bitwiseAND(1) == 0) & extra.isNotNull() & F.forall(F.slice(o, 6, extra), lambda x: x.between(0x80, 0xBF))
            return F.when(right & (F.size(o) >= size), F.struct(number.alias("number"), samples.cast("int").alias("samples"), F.coalesce(known, spelled).alias("rate"), layout.alias("layout"), bits.alias("width"), size.cast("int").alias("size")))

        return let(extra, rest)

    found = let(octets(F.substring(b, 1, 16)), fields)
    # the checksum over a header with its own is 0
    return let(found, lambda h: F.when(crc8(F.substring(b, F.lit(1), h["size"])) == 0, h))
