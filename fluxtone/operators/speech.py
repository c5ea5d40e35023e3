"""Speech analytics over frames and streams in long form."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxtone.functions.filters import Biquad

# Band edges in Hz, least speech levels and first noise levels.
BANDS = ((80, 250), (250, 500), (500, 1000), (1000, 2000), (2000, 3000), (3000, 4000))
SPEECH = (200.0, 180.0, 160.0, 140.0, 120.0, 100.0)
NOISE = (120.0, 100.0, 90.0, 80.0, 70.0, 60.0)
HANGOVER = 15
# Frames that make the first noise, and the echo filter's first weights.
FIRST_FRAMES = 10
FIRST_WEIGHTS = (0.5, 0.3, 0.15)


def subband_energy(frames: DataFrame, size: int, rate: int) -> DataFrame:
    """id, band, energy: mean power of the band's bins over the frame's size. A band without bins has 0."""
    bins = [(b, k) for b, (low, high) in enumerate(BANDS) for k in range(low * size // rate, high * size // rate + 1) if k < size // 2]
    count = {b: sum(c == b for c, _ in bins) for b in range(len(BANDS))}
    pairs = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(k).alias("k")) for b, k in bins])
    rows = frames.where(F.col("n") < size).select("id", "n", "x", F.explode(pairs).alias("p")).select("id", "n", "x", "p.*")
    angle = 2 * math.pi * ((F.col("k") * F.col("n")) % size) / size
    lines = rows.groupBy("id", "band", "k").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(F.col("x") * F.sin(angle)).alias("im"))
    sums = lines.groupBy("id", "band").agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("e"))
    each = F.get(F.array(*[F.lit(float(count[b])) for b in range(len(BANDS))]), F.col("band"))
    return sums.select("id", "band", (F.col("e") / (each * size)).alias("energy"))


class _Detector:
    """Speech against noise by bands: holds the noise levels, which follow the energy slowly from frame to frame."""

    def __init__(self, aggressiveness: int):
        self.noise, self.over, self.speech = np.array(NOISE), 1 + 0.2 * aggressiveness, np.array(SPEECH) * (1 - 0.15 * aggressiveness)

    def probability(self, energy: np.ndarray) -> float:
        noise = self.noise * self.over
        score = np.where(energy > self.speech, 1.0, np.where(energy > noise, (energy - noise) / (self.speech - noise + 1), 0.0))
        self.noise = self.noise * 0.95 + energy * 0.05
        return float(min(max(score.sum() / len(BANDS), 0.0), 1.0))


def _by_frame(frames: DataFrame, column: str, begin: Callable[[], Any], out: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """stream, frame and the columns of ``out`` (a SQL type and an Arrow type each): each stream's frames in order
    through an object of its own, whose ``feed(list)`` gives the columns' values. No task holds a whole stream."""
    dealt = frames.select("stream", "frame", column).repartition("stream").sortWithinPartitions("stream", "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, worker = None, None
        for batch in batches:
            made = []
            for stream, x in zip(batch["stream"].to_pylist(), batch[column].to_pylist(), strict=True):
                if worker is None or stream != current:
                    current, worker = stream, begin()
                made.append(worker.feed(x))
            if made:
                values = [pa.array(v, kind) for v, (_, kind) in zip(zip(*made, strict=True), out.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch["stream"], batch["frame"], *values], names=["stream", "frame", *out])

    kinds = [f"{c} {dealt.schema[c].dataType.simpleString()}" for c in ("stream", "frame")]
    return dealt.mapInArrow(run, ", ".join([*kinds, *(f"{c} {kind}" for c, (kind, _) in out.items())]))


class _Listener(_Detector):
    def feed(self, energies: list[float]) -> tuple[float]:
        return (self.probability(np.array(energies, float)),)


def speech_probability(rows: DataFrame, aggressiveness: int = 1) -> DataFrame:
    """stream, frame, probability of (stream, frame, energies array of 6 bands).

    A band scores 1 above its speech level and rises linearly above the noise level; the probability is the mean score.
    """
    return _by_frame(rows, "energies", lambda: _Listener(aggressiveness), {"probability": ("double", pa.float64())})


def speech_decision(probabilities: DataFrame, aggressiveness: int = 1, hangover: int = HANGOVER) -> DataFrame:
    """Adds speech: above the bar, or at most ``hangover`` frames after one that is."""
    order = Window.partitionBy("stream").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    turn = F.row_number().over(Window.partitionBy("stream").orderBy("frame"))
    rows = probabilities.withColumn("turn", turn).withColumn("over", F.col("probability") > 0.5 - 0.1 * aggressiveness)
    last = F.last(F.when(F.col("over"), F.col("turn")), ignorenulls=True).over(order)
    return rows.withColumn("speech", F.coalesce(F.col("turn") - last <= hangover, F.lit(False))).drop("turn", "over")


def _along(rows: DataFrame, columns: list[str], begin: Callable[[], Any]) -> DataFrame:
    """stream, n, y: each stream's rows in order of n through an object of its own, some thousand rows at a time.

    ``begin()`` gives an object whose ``feed(n, *values)`` and ``finish()`` return pairs of places and results; it
    holds what a stream's later samples need, so no task holds a whole stream.
    """
    dealt = rows.select("stream", "n", *columns).repartition("stream").sortWithinPartitions("stream", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, worker = None, None

        def out(n: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch({"stream": pa.array([current] * len(n), pa.int64()), "n": pa.array(n, pa.int64()), "y": pa.array(y, pa.float64())})

        for batch in batches:
            streams, n = batch["stream"].to_numpy(), batch["n"].to_numpy()
            values = [batch[c].to_numpy(zero_copy_only=False).astype(float) for c in columns]
            cuts = [0, *(np.flatnonzero(np.diff(streams)) + 1), len(streams)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if worker is None or streams[a] != current:
                    if worker is not None:
                        yield out(*worker.finish())
                    current, worker = streams[a], begin()
                yield out(*worker.feed(n[a:b], *(v[a:b] for v in values)))
        if worker is not None:
            yield out(*worker.finish())

    return dealt.mapInArrow(run, "stream long, n long, y double")


class _Suppressor:
    """Spectral subtraction: holds the samples and sums of the frames that are not done, and the noise."""

    def __init__(self, keep: float, size: int, rate: float):
        self.keep, self.size, self.rate, self.frames = keep, size, rate, 0
        self.window = 0.5 * (1 - np.cos(2 * np.pi * np.arange(size) / (size - 1)))
        self.n, self.x, self.sums, self.noise = np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(size // 2 + 1)

    def feed(self, n: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.n, self.x, self.sums = np.concatenate([self.n, n]), np.concatenate([self.x, x]), np.concatenate([self.sums, np.zeros(len(x))])
        done, hop = 0, self.size // 2
        while done + self.size <= len(self.x):
            self._frame(done)
            done += hop
        out = self.n[:done], self.sums[:done]
        self.n, self.x, self.sums = self.n[done:], self.x[done:], self.sums[done:]
        return out

    def _frame(self, at: int) -> None:
        spectrum = np.fft.rfft(self.x[at : at + self.size] * self.window)
        level = np.abs(spectrum)
        if self.frames < FIRST_FRAMES:
            self.noise = (self.noise * self.frames + level) / (self.frames + 1)
        elif level.sum() < 2 * self.noise.sum():
            self.noise = (1 - self.rate) * self.noise + self.rate * level
        self.frames += 1
        left = np.maximum(level - self.keep * self.noise, 0.01 * level)
        self.sums[at : at + self.size] += np.fft.irfft(spectrum * left / np.maximum(level, 1e-12), self.size)

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        return self.n, self.sums if self.frames else self.x


def suppress_noise(rows: DataFrame, db: float = 12.0, size: int = 512, rate: float = 0.1) -> DataFrame:
    """stream, n, y: spectral subtraction with half-overlapped frames.

    The noise is the mean magnitude of the first ten frames; then it follows, by ``rate``, the frames whose magnitudes
    sum to less than twice its own. Of each magnitude the noise, as strong as ``db`` says (more takes away more), is
    taken away; a hundredth of the magnitude stays. Streams shorter than a frame pass as they are.
    """
    keep = 1 - 10 ** (-db / 20)
    return _along(rows, ["x"], lambda: _Suppressor(keep, size, rate))


class _Canceller:
    """Adaptive filter: holds its weights, the last far samples and the running energies."""

    def __init__(self, taps: int, rate: float, bar: float):
        self.taps, self.rate, self.bar = taps, rate, bar
        self.weights, self.past, self.sums = np.zeros(taps), np.zeros(taps - 1), np.zeros(3)
        self.weights[: len(FIRST_WEIGHTS)] = FIRST_WEIGHTS[:taps]

    def feed(self, n: np.ndarray, d: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.concatenate([self.past, x]), np.zeros(len(d))
        near, far, left = self.sums
        for i in range(len(d)):
            heard = x[i : i + self.taps][::-1]
            y[i] = e = d[i] - self.weights @ heard
            power = heard @ heard
            near, far, left = near + d[i] * d[i], far + power, left + e * e
            talk = near > self.bar * far and left > 0.1 * far
            if not talk and power > 1e-6:
                self.weights += self.rate / (power + 1e-6) * e * heard
        self.sums, self.past = (near, far, left), x[len(x) - self.taps + 1 :]
        return n, y

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(0, np.int64), np.zeros(0)


def cancel_echo(near: DataFrame, far: DataFrame, taps: int = 256, rate: float = 0.5, bar: float = 0.5) -> DataFrame:
    """stream, n, y: what is left of the near end after an adaptive filter of the far end.

    Both ends are joined on (stream, n), missing far samples are 0. The weights hold still while the near end talks
    over the echo: while the energy of the near end so far is above ``bar`` times that of the far end in the filter,
    and that of what is left above a tenth of it; and where the far end is silent. No noise is added to silence.
    """
    met = near.select("stream", "n", F.col("x").alias("d")).join(far.select("stream", "n", "x"), ["stream", "n"], "left").fillna({"x": 0.0})
    return _along(met, ["d", "x"], lambda: _Canceller(taps, rate, bar))


class _Preprocessor:
    """High-pass, speech detection and gain of one stream: holds the filter's, the detector's and the gain's state."""

    def __init__(self, rate: int, aggressiveness: int, vad: bool, agc: bool, silence: bool, scale: float):
        self.vad, self.agc, self.silence, self.scale, self.rate = vad, agc, silence, scale, rate
        self.filter, self.detector, self.bar = Biquad.design("highpass", rate, 80), _Detector(aggressiveness), 0.5 - 0.1 * aggressiveness
        self.past, self.since = [0.0] * 4, None
        self.power, self.gain = 0.001, 1.0
        self.attack, self.release = (math.exp(-1000 / (rate * ms)) for ms in (10.0, 500.0))

    def feed(self, x: list[float] | None) -> tuple[list[float], float, bool, float]:
        y = self._filtered(np.array(x or [], float))
        probability, speech = self._heard(y) if self.vad else (0.0, True)
        y = np.zeros(len(y)) if self.silence and not speech else self._levelled(y) if self.agc else y
        return y.tolist(), probability, speech, self.gain

    def _filtered(self, x: np.ndarray) -> np.ndarray:
        f, (x1, x2, y1, y2), out = self.filter, self.past, np.zeros(len(x))
        for i, v in enumerate(x):
            out[i] = f.b0 * v + f.b1 * x1 + f.b2 * x2 - f.a1 * y1 - f.a2 * y2
            x1, x2, y1, y2 = v, x1, out[i], y1
        self.past = [x1, x2, y1, y2]
        return out

    def _heard(self, y: np.ndarray) -> tuple[float, bool]:
        size, energy = len(y), np.zeros(len(BANDS))
        power = np.abs(np.fft.fft(y)) ** 2 if size else np.zeros(0)
        for b, (low, high) in enumerate(BANDS):
            bins = [k for k in range(low * size // self.rate, high * size // self.rate + 1) if k < size // 2]
            energy[b] = power[bins].sum() / (len(bins) * size) * self.scale if bins else 0.0
        probability = self.detector.probability(energy)
        self.since = 0 if probability > self.bar else None if self.since is None else self.since + 1
        return probability, self.since is not None and self.since <= HANGOVER

    def _levelled(self, y: np.ndarray) -> np.ndarray:
        out, target, most = np.zeros(len(y)), 10 ** (-18 / 20), 10 ** (20 / 20)
        for i, v in enumerate(y):
            self.power = 0.99 * self.power + 0.01 * v * v
            wanted = min(target / math.sqrt(self.power), most)
            k = self.attack if wanted < self.gain else self.release
            self.gain = k * self.gain + (1 - k) * wanted
            out[i] = v * self.gain
        return out


def preprocess(frames: DataFrame, rate: int = 8000, aggressiveness: int = 1, vad: bool = True, agc: bool = True, silence: bool = True, scale: float = 1.0) -> DataFrame:
    """stream, frame, y, probability, speech, gain of (stream, frame, x array): what a voice goes through before it is coded.

    A high-pass at 80 Hz; detection of speech, which lasts ``HANGOVER`` frames on, and zeros for frames without it;
    gain toward a level, which stands still meanwhile. Each step can be left out: without ``vad`` all frames are
    speech, without ``silence`` others pass too. ``scale`` brings energies to the detector's levels. A frame updates
    the detector's noise once. All state goes on from frame to frame, and no task holds a whole stream.
    """
    out = {"y": ("array<double>", pa.list_(pa.float64())), "probability": ("double", pa.float64()), "speech": ("boolean", pa.bool_()), "gain": ("double", pa.float64())}
    return _by_frame(frames, "x", lambda: _Preprocessor(rate, aggressiveness, vad, agc, silence, scale), out)


def bands_of(energy: DataFrame) -> DataFrame:
    """id, energies: the six bands as an array."""
    return energy.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "energy"))), lambda s: s["energy"]).alias("energies"))


