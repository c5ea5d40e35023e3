"""Recurrences along streams whose rows come in micro-batches: what the next samples need is kept as state by stream.

The rows of a batch are put in order of seq; those of a later batch come after them (``jobs.reorder`` brings rows in
order that don't). A stream's state is a few numbers, whatever its length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fluxtone.operators.speech import HANGOVER, NOISE, _Detector


def carried(rows: DataFrame, out: str, state: str, begin: Callable[[], tuple], step: Callable[[tuple, pd.DataFrame], tuple[tuple, dict]]) -> DataFrame:
    """stream, seq and the columns ``out`` of a streaming (stream, seq, ...): ``step`` takes what is kept (first ``begin()``) and
    a batch's rows in order, and gives what to keep and the columns' values."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("seq", kind="stable")
        now, values = step(kept.get if kept.exists else begin(), pdf)
        kept.update(now)
        yield pd.DataFrame({"stream": key[0], "seq": pdf["seq"].to_numpy(), **values})

    return rows.groupBy("stream").applyInPandasWithState(run, f"stream long, seq long, {out}", state, "append", GroupStateTimeout.NoTimeout)


def gain(rows: DataFrame, rate: float, target_db: float = -18.0, most_db: float = 20.0, attack_ms: float = 10.0, release_ms: float = 500.0) -> DataFrame:
    """stream, seq, y of a streaming (stream, seq, x): gain toward a level, as ``filters.automatic_gain`` gives whole signals."""
    attack, release = (math.exp(-1000 / (rate * ms)) for ms in (attack_ms, release_ms))
    target, most = 10 ** (target_db / 20), 10 ** (most_db / 20)

    def step(kept: tuple, pdf: pd.DataFrame) -> tuple[tuple, dict]:
        power, level = kept
        y = []
        for v in pdf["x"]:
            power = 0.99 * power + 0.01 * v * v
            wanted = min(target / math.sqrt(power), most)
            k = attack if wanted < level else release
            level = k * level + (1 - k) * wanted
            y.append(v * level)
        return (power, level), {"y": y}

    return carried(rows, "y double", "power double, level double", lambda: (0.001, 1.0), step)


def speech(rows: DataFrame, aggressiveness: int = 1, hangover: int = HANGOVER) -> DataFrame:
    """stream, seq, probability, speech of a streaming (stream, seq, energies array of 6 bands), as the batch detector gives whole streams.

    ``speech`` lasts ``hangover`` frames on after one above the bar.
    """
    bar = 0.5 - 0.1 * aggressiveness

    def step(kept: tuple, pdf: pd.DataFrame) -> tuple[tuple, dict]:
        noise, since = kept
        detector = _Detector(aggressiveness)
        detector.noise = detector.noise * 0 + noise
        heard, found = [], []
        for energies in pdf["energies"]:
            heard.append(detector.probability(energies))
            since = 0 if heard[-1] > bar else since if since < 0 else since + 1
            found.append(0 <= since <= hangover)
        return (list(map(float, detector.noise)), since), {"probability": heard, "speech": found}

    return carried(rows, "probability double, speech boolean", "noise array<double>, since long", lambda: (list(NOISE), -1), step)
