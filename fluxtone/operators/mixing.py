"""Mixing long-form signals (id, n, x)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mix(inputs: list[tuple[DataFrame, float]], group: str, normalize: bool = True) -> DataFrame:
    """Sum of gain times sample by (group, n), over the number of sources of the group where normalised.

    Sources that have ended add nothing, so a mix is as long as its longest source. The sums combine in each
    task; the number of sources is one row a group.
    """
    rows = reduce(DataFrame.unionByName, [d.select(group, "id", "n", (F.col("x") * gain).alias("x")) for d, gain in inputs])
    sums = rows.groupBy(group, "n").agg(F.sum("x").alias("y"))
    if not normalize:
        return sums
    many = rows.groupBy(group).agg(F.countDistinct("id").alias("sources"))
    return sums.join(many, group).select(group, "n", (F.col("y") / F.col("sources")).alias("y"))
