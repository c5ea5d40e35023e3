"""Recurrences over the samples of a frame: filters and gain control.

No window frame expresses a value that depends on its own last value, so each is a fold over the frame's array
whose state is a struct. Coefficients are computed once, when the plan is built.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxtone.functions.bits import let


@dataclass(frozen=True)
class Biquad:
    b0: float
    b1: float
    b2: float
    a1: float
    a2: float

    @classmethod
    def design(cls, kind: str, rate: float, frequency: float, q: float = 0.7071, gain_db: float = 0.0) -> Biquad:
        """Cookbook designs: lowpass, highpass, bandpass, notch, peaking, lowshelf, highshelf."""
        w = 2 * math.pi * frequency / rate
        c, alpha, a = math.cos(w), math.sin(w) / (2 * q), 10 ** (gain_db / 40)
        s = 2 * math.sqrt(a) * alpha
        pass_band = (1 + alpha, -2 * c, 1 - alpha)
        forms = {
            "lowpass": ((1 - c) / 2, 1 - c, (1 - c) / 2, *pass_band),
            "highpass": ((1 + c) / 2, -(1 + c), (1 + c) / 2, *pass_band),
            "bandpass": (alpha, 0.0, -alpha, *pass_band),
            "notch": (1.0, -2 * c, 1.0, *pass_band),
            "peaking": (1 + alpha * a, -2 * c, 1 - alpha * a, 1 + alpha / a, -2 * c, 1 - alpha / a),
            "lowshelf": (a * (a + 1 - (a - 1) * c + s), 2 * a * (a - 1 - (a + 1) * c), a * (a + 1 - (a - 1) * c - s), a + 1 + (a - 1) * c + s, -2 * (a - 1 + (a + 1) * c), a + 1 + (a - 1) * c - s),
            "highshelf": (a * (a + 1 + (a - 1) * c + s), -2 * a * (a - 1 + (a + 1) * c), a * (a + 1 + (a - 1) * c - s), a + 1 - (a - 1) * c + s, 2 * (a - 1 - (a + 1) * c), a + 1 - (a - 1) * c - s),
        }
        b0, b1, b2, a0, a1, a2 = forms[kind]
        return cls(b0 / a0, b1 / a0, b2 / a0, a1 / a0, a2 / a0)


#: Values that a fold appends to one array; appending copies an array, so a long one is made of parts.
PART = 256


def scan(x: Column, start: dict[str, Column], step: Callable[[Column, Column], dict[str, Column]], out: str, kind: str = "double") -> Column:
    """Fold over an array that keeps every value of the state field ``out``.

    A fold over parts of ``PART`` values holds a fold within each part, and moves a part's values to the whole when the
    next part begins.
    """
    none = F.array().cast(f"array<{kind}>").alias("out")
    first = F.struct(F.array().cast(f"array<array<{kind}>>").alias("parts"), F.struct(none, *[v.alias(k) for k, v in start.items()]).alias("now"))

    def merge(state: Column, s: Column) -> Column:
        new = step(state, s)
        return F.struct(F.array_append(state["out"], new[out].cast(kind)).alias("out"), *[new[k].alias(k) for k in start])

    def whole(x: Column) -> Column:
        def part(state: Column, at: Column) -> Column:
            now = F.aggregate(F.slice(x, at + 1, F.lit(PART)), F.struct(none, *[state["now"][k].alias(k) for k in start]), merge)
            return F.struct(F.array_append(state["parts"], state["now"]["out"]).alias("parts"), now.alias("now"))

        places = F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1, F.lit(PART))).otherwise(F.array().cast("array<int>"))
        return F.when(x.isNotNull(), F.aggregate(places, first, part, lambda state: F.flatten(F.array_append(state["parts"], state["now"]["out"]))))

    return let(x, whole)


def zero() -> Column:
    return F.lit(0.0)


def biquad(x: Column, f: Biquad) -> Column:
    def step(s, v):
        y = f.b0 * v + f.b1 * s["x1"] + f.b2 * s["x2"] - f.a1 * s["y1"] - f.a2 * s["y2"]
        return {"x1": v, "x2": s["x1"], "y1": y, "y2": s["y1"]}

    return scan(x, {k: zero() for k in ("x1", "x2", "y1", "y2")}, step, "y1")


# The presets' frequencies in Hz.
TEN_BANDS = (31, 62, 125, 250, 500, 1000, 2000, 4000, 8000, 16000)
TONE_BANDS = (("lowshelf", 300.0), ("peaking", 1000.0), ("highshelf", 3000.0))


def tone(rate: float, bass_db: float, mid_db: float, treble_db: float) -> list[Biquad]:
    return [Biquad.design(kind, rate, f, 1.0, db) for (kind, f), db in zip(TONE_BANDS, (bass_db, mid_db, treble_db), strict=True)]


def ten_band(rate: float, gains_db: list[float]) -> list[Biquad]:
    return [Biquad.design("peaking", rate, f, 1.4, g) for f, g in zip(TEN_BANDS, gains_db, strict=True) if f < rate / 2]


def equalizer(x: Column, filters: list[Biquad]) -> Column:
    for f in filters:
        x = biquad(x, f)
    return x


def compressor(x: Column, rate: float, threshold: float = -20.0, ratio: float = 4.0, knee: float = 6.0, attack_ms: float = 10.0, release_ms: float = 100.0, makeup_db: float = 0.0) -> Column:
    """Gain by level in dB with a soft knee, smoothed by attack or release; the smoothed gain starts at 0."""
    attack, release = (math.exp(-1 / (rate * ms / 1000)) for ms in (attack_ms, release_ms))
    makeup, slope = 10 ** (makeup_db / 20), 1 - 1 / ratio

    def step(s, v):
        level = F.when(F.abs(v) > 1e-10, 20 * F.log10(F.abs(v))).otherwise(-120.0)
        over = level - threshold + knee / 2
        less = F.when(over < 0, 0.0).when(over > knee, (level - threshold) * slope).otherwise(over / knee * (over / knee) * knee * slope / 4)
        target = F.pow(F.lit(10.0), -less / 20)
        k = F.when(target < s["env"], attack).otherwise(release)
        env = k * s["env"] + (1 - k) * target
        return {"env": env, "y": v * env * makeup}

    return scan(x, {"env": zero(), "y": zero()}, step, "y")


def automatic_gain(x: Column, rate: float, target_db: float = -18.0, most_db: float = 20.0, attack_ms: float = 10.0, release_ms: float = 500.0) -> Column:
    """Gain toward a target level: power envelope, wanted gain within a limit, attack or release smoothing."""
    attack, release = (math.exp(-1000 / (rate * ms)) for ms in (attack_ms, release_ms))
    target, most = 10 ** (target_db / 20), 10 ** (most_db / 20)

    def step(s, v):
        env = 0.99 * s["env"] + 0.01 * v * v
        wanted = F.least(F.lit(target) / F.sqrt(env), F.lit(most))
        k = F.when(wanted < s["gain"], attack).otherwise(release)
        gain = k * s["gain"] + (1 - k) * wanted
        return {"env": env, "gain": gain, "y": v * gain}

    return scan(x, {"env": F.lit(0.001), "gain": F.lit(1.0), "y": zero()}, step, "y")


def envelope(x: Column, keep: float = 0.99) -> Column:
    return scan(x, {"e": zero()}, lambda s, v: {"e": keep * s["e"] + (1 - keep) * F.abs(v)}, "e")
