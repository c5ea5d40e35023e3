"""Linear prediction over long-form integer or real signals (id, n, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxtone.functions.bits import from_bits, to_bits
from fluxtone.functions.filters import scan
from fluxtone.functions.flac import FIXED, zigzag

RICE = 4


def fixed_residuals(rows: DataFrame) -> DataFrame:
    """id, n, ord, residual for orders 0 to 4, all from one window; the first ``ord`` samples have no residual."""
    order = Window.partitionBy("id").orderBy("n")
    before = rows.select("id", "n", "v", *[F.lag("v", k).over(order).alias(f"v{k}") for k in range(1, 5)])
    each = [F.struct(F.lit(p).alias("ord"), (F.col("v") - sum((w * F.col(f"v{k}") for k, w in enumerate(ws, 1)), F.lit(0).cast("long"))).alias("residual")) for p, ws in FIXED.items()]
    return before.select("id", "n", F.explode(F.array(*each)).alias("r")).select("id", "n", "r.*").where("n >= ord")


def rice_bits(v: Column, parameter: int = RICE) -> Column:
    """Length of a Rice code: unary quotient, stop bit, remainder."""
    return F.shiftright(zigzag(v), parameter) + 1 + parameter


def rice_code(v: Column, parameter: int = RICE) -> Column:
    """The code as a string of bits."""
    z = zigzag(v).cast("long")
    return F.concat(F.repeat(F.lit("0"), F.shiftright(z, parameter).cast("int")), F.lit("1"), F.lpad(F.bin(z.bitwiseAND((1 << parameter) - 1)), parameter, "0"))


def rice_decode(code: Column, parameter: int = RICE) -> Column:
    quotient = F.length(F.regexp_extract(code, "^0*", 0))
    z = quotient.cast("long") * (1 << parameter) + F.conv(F.substring(code, quotient + 2, F.lit(parameter)), 2, 10).cast("long")
    return F.when(z % 2 == 0, z / 2).otherwise(-(z + 1) / 2).cast("long")


def best_order(rows: DataFrame) -> DataFrame:
    """id, ord, bits: the fixed predictor with the least estimated size; verbatim samples count 16 bits."""
    sizes = fixed_residuals(rows).groupBy("id", "ord").agg(F.when(F.col("ord") == 0, F.count("*") * 16).otherwise(F.col("ord") * 16 + F.sum(rice_bits(F.col("residual"))) + 8).cast("long").alias("bits"))
    return sizes.groupBy("id").agg(F.min(F.struct("bits", "ord")).alias("best")).select("id", "best.ord", "best.bits")


def autocorrelation(rows: DataFrame, lags: int) -> DataFrame:
    """id, lag, r for lags 0 to ``lags``: a join of each sample with the ones shortly after it, by position."""
    ahead = rows.select("id", F.col("n").alias("m"), F.col("x").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"))
    met = ahead.select("id", "lag", "a", (F.col("m") + F.col("lag")).alias("n")).join(rows.select("id", "n", "x"), ["id", "n"])
    return met.groupBy("id", "lag").agg(F.sum(F.col("a") * F.col("x")).alias("r"))


def pitch(rows: DataFrame, least: int, most: int) -> DataFrame:
    """id, lag, r: the lag of the largest autocorrelation, ties to the smaller."""
    found = autocorrelation(rows, most).where(F.col("lag") >= least)
    return found.groupBy("id").agg(F.max(F.struct("r", (-F.col("lag")).alias("minus"))).alias("b")).select("id", (-F.col("b.minus")).alias("lag"), "b.r")


def levinson(r: Column, order: int) -> Column:
    """struct<a array<double>, error double>: predictor coefficients of autocorrelations 0 to ``order``."""
    start = F.struct(F.array().cast("array<double>").alias("a"), F.get(r, F.lit(0)).alias("error"))

    def merge(s: Column, i: Column) -> Column:
        a = s["a"]
        done = F.aggregate(F.transform(a, lambda v, j: v * F.get(r, i - 1 - j)), F.lit(0.0), lambda x, y: x + y)
        k = F.when(s["error"] > 0, (F.get(r, i) - done) / s["error"]).otherwise(0.0)
        turned = F.zip_with(a, F.reverse(a), lambda x, y: x - k * y)
        return F.struct(F.array_append(turned, k).alias("a"), (s["error"] * (1 - k * k)).alias("error"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(order)), start, merge)


def restore(first: Column, residual: Column, order: int) -> Column:
    """Samples from ``order`` warm-up samples and the residuals of a fixed predictor."""
    weights = FIXED[order]
    if not order:
        return residual
    start = {f"v{k}": F.get(first, F.lit(order - k)).cast("long") for k in range(1, order + 1)}

    def step(s: Column, e: Column) -> dict[str, Column]:
        v = e + sum((w * s[f"v{k}"] for k, w in enumerate(weights, 1)), F.lit(0).cast("long"))
        return {"v1": v, **{f"v{k}": s[f"v{k - 1}"] for k in range(2, order + 1)}}

    return F.concat(first, scan(residual, start, step, "v1", "long"))


# Bits of a line frequency, a gain, a lag, the share of the past, and a sample's parts.
LINE, GAIN, LAG, SHARE, HEARD, SIGN, SIZE = 6, 5, 7, 4, 2, 1, 2


def coded_frame(x: Column, a: Column, order: int = 10, sub: int = 40, parts: int = 4, least: int = 20, most: int = 147) -> Column:
    """Bytes of a frame of ``parts`` times ``sub`` samples under predictor ``a``: evenly spaced line frequencies, then for
    each part the level and the lag of what is left, a fixed share, and for each sample whether it is heard, its sign and size.
    """
    left = F.transform(x, lambda v, i: F.when(i < order, 0.0).otherwise(v - sum((F.get(a, F.lit(k)) * F.get(x, i - k - 1) for k in range(order)), F.lit(0.0))))
    digits = ["".join(f"{int((i + 1) / (order + 1) * 63 + 0.5):0{LINE}b}" for i in range(order))]

    def sample(r: Column) -> Column:
        size = F.least((F.abs(r) * 3).cast("int"), F.lit(3))
        return F.when(F.abs(r) > 0.05, F.concat(F.lit("01"), F.when(r > 0, "1").otherwise("0"), to_bits(size, SIZE))).otherwise("00")

    words = [F.lit("".join(digits))]
    for s in range(parts):
        own, at = F.slice(left, s * sub + 1, sub), s * sub
        rms = F.sqrt(F.aggregate(own, F.lit(0.0), lambda t, r: t + r * r) / sub)
        gain = (20 * F.log10(F.greatest(rms, F.lit(1e-6))) + 20).cast("int")
        lag = F.lit(least)
        if at >= least:
            match = lambda d, at=at: F.aggregate(F.sequence(F.lit(0), F.lit(sub - 1)), F.lit(0.0), lambda t, i: t + F.get(x, i + at) * F.get(x, i + at - d))
            found = F.array_max(F.transform(F.sequence(F.lit(least), F.lit(min(most, at))), lambda d: F.struct(match(d).alias("r"), (-d).alias("minus"))))
            lag = F.when(found["r"] > 0, -found["minus"]).otherwise(least)
        words += [to_bits(F.least(F.greatest(gain, F.lit(0)), F.lit(31)), GAIN), to_bits(F.least(lag - least, F.lit(127)), LAG), F.lit(f"{4:0{SHARE}b}"), F.array_join(F.transform(own, sample), "")]
    return from_bits(F.concat(*words))
