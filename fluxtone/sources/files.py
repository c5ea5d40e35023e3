"""Files in and out. A row holds a whole file, so this suits files that fit in a task's memory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxtone.functions.headers import sniff


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """id, name, kind, b of the files under a path in any store that Spark reads."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select(F.xxhash64("path").alias("id"), F.col("path").alias("name"), sniff(F.col("content"), F.col("path")).alias("kind"), F.col("content").alias("b"))


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes each (name, b) to a file of its own in a folder that all executors share; returns their number.

    A file is written under another name and then renamed, so a retried task leaves whole files only.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for pdf in batches:
            for name, b in zip(pdf["name"], pdf["b"], strict=True):
                draft = f"{base}/.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(b)
                store.move(draft, f"{base}/{name}")
            yield pd.DataFrame({"n": [len(pdf)]})

    return rows.select("name", "b").mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0
