"""Sample arithmetic on array columns, position by position."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxtone.functions.bits import clip16


def pcm16_to_float(v: Column) -> Column:
    return F.transform(v, lambda s: s / 32768.0)


def float_to_pcm16(x: Column) -> Column:
    """Full scale 32767, clipped, truncated toward zero."""
    return F.transform(x, lambda s: clip16((s * 32767).cast("int")))


def pcm8_to_float(v: Column) -> Column:
    return F.transform(v, lambda s: (s - 128) / 128.0)


def float_to_pcm8(x: Column) -> Column:
    return F.transform(x, lambda s: F.least(F.greatest(((s + 1) * 127.5).cast("int"), F.lit(0)), F.lit(255)))


def mono_to_stereo(x: Column) -> Column:
    return F.flatten(F.transform(x, lambda s: F.array(s, s)))


def stereo_to_mono(x: Column) -> Column:
    """Mean of each interleaved pair; a sample left over is dropped."""
    pairs = F.floor(F.size(x) / 2).cast("int")
    return F.when(pairs < 1, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), pairs - 1), lambda i: (F.get(x, i * 2) + F.get(x, i * 2 + 1)) / 2))


def gain_of_db(db: float) -> float:
    return 10 ** (db / 20)


def db_of_gain(gain: float) -> float:
    return 20 * math.log10(max(gain, 1e-4))


def volume(x: Column, gain: float, limit: float = 1.0, mute: bool = False) -> Column:
    """Gain, then a hard clip at the peak limit."""
    if mute:
        return F.transform(x, lambda s: F.lit(0.0))
    return F.transform(x, lambda s: F.least(F.greatest(s * max(gain, 0.0), F.lit(-limit)), F.lit(limit)))


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, lambda s: F.abs(s)))


def fade(n: Column, length: int, kind: str = "in", curve: str = "linear") -> Column:
    """Gain at position ``n`` of a fade of ``length`` samples. After it a fade-in passes all, a fade-out nothing."""
    p = n / F.lit(float(length))
    shape = {"linear": p, "logarithmic": F.log10(1 + 9 * p), "cosine": (1 - F.cos(F.lit(math.pi) * p)) / 2}[curve]
    gain, after = (shape, 1.0) if kind == "in" else (1 - shape, 0.0)
    return F.when(n >= length, F.lit(after)).otherwise(gain)


def window(n: Column, size: int, kind: str = "hann") -> Column:
    """Symmetric window of ``size`` at position ``n``."""
    a = 2 * math.pi * n / (size - 1)
    if kind == "hann":
        return 0.5 * (1 - F.cos(a))
    if kind == "hamming":
        return 0.54 - 0.46 * F.cos(a)
    if kind == "blackman":
        return 0.42 - 0.5 * F.cos(a) + 0.08 * F.cos(2 * a)
    return F.lit(1.0)


def semitones_to_ratio(semitones: float) -> float:
    return 2 ** (semitones / 12)


def resample_linear(v: Column, rate_in: int, rate_out: int) -> Column:
    """Integer samples at another rate: between the two nearest, truncated; 0 where there is no next sample."""
    n, step = F.size(v), rate_in / rate_out
    count = F.floor(n * rate_out / rate_in).cast("int")

    def at(k: Column) -> Column:
        i = F.floor(k * step).cast("int")
        f = k * step - i
        return F.when(i + 1 >= n, 0).otherwise((F.get(v, i) * (1 - f) + F.get(v, i + 1) * f).cast("int"))

    return F.when(count < 1, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), at))


def audio_format(rate: Column, channels: Column, bits: Column, samples: Column) -> Column:
    """What is said of a stream's samples: rate, channels, bits of a sample, and samples of a frame."""
    return F.struct(rate.cast("int").alias("rate"), channels.cast("int").alias("channels"), bits.cast("int").alias("bits"), samples.cast("int").alias("samples"))


def declare(known: Column, **changes: int | Column) -> Column:
    """The format with other values: only what is said of the samples changes, they pass as they are."""
    for name, value in changes.items():
        known = known.withField(name, value if isinstance(value, Column) else F.lit(value))
    return known


def byte_rate(known: Column) -> Column:
    return F.floor(known["rate"] * known["channels"] * known["bits"] / 8).cast("int")


def bytes_per_frame(known: Column) -> Column:
    return (known["samples"] * known["channels"] * F.floor(known["bits"] / 8)).cast("int")
