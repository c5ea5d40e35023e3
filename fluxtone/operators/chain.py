"""Steps over frames, one after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Step = Callable[[DataFrame], DataFrame]


class Chain:
    """A list of steps from DataFrame to DataFrame; each one reads what the one before it gives.

    Steps can be put in and taken out anywhere, the first one included: the chain is put together when it is applied.
    """

    def __init__(self, *steps: Step) -> None:
        self.steps = list(steps)

    def add(self, step: Step) -> Chain:
        self.steps.append(step)
        return self

    def remove(self, step: Step) -> bool:
        """Takes out a step; false where it isn't in the chain."""
        if step not in self.steps:
            return False
        self.steps.remove(step)
        return True

    def __call__(self, frames: DataFrame) -> DataFrame:
        for step in self.steps:
            frames = frames.transform(step)
        return frames
