"""The line operator in a driver of little memory: tables of long texts, texts of very many lines."""

import os
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

REPO = str(Path(__file__).parents[2])
RUN = """
import sys
from pyspark.sql import SparkSession, functions as F
from fluxtone.llm.line_dedup import line_dedup

spark = SparkSession.builder.master("local[1]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
found = line_dedup(spark.read.parquet(sys.argv[1]), 2, 20, 50, by_run=True)
ranges = F.sum(F.size("removed")).alias("ranges")
print("FOUND", *found.agg(F.count("*"), F.sum("n_lines"), F.sum("n_removed"), ranges, F.sum(F.length("text"))).first())
"""


def long_texts():
    heads = [" ".join(f"w{i // 2}" for _ in range(20)) for i in range(4000)]
    left = sum(len(x) + 1 + 40_000 for x in heads[::2])
    return [f"{x}\n{'x' * 40_000}" for x in heads], (4000, 8000, 4000, 2000, left)


def many_lines(n=600_000):
    text = "\n".join(map(str, range(n)))
    return [text, text, f"own\n{text}\nown"], (3, 3 * n + 2, 2 * n, 2, len(text) + len("own\nown"))


@pytest.mark.parametrize("made", [long_texts, many_lines])
def test_little_memory_is_enough(tmp_path, made):
    texts, want = made()
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), tmp_path / "docs.parquet")
    env = os.environ | {"PYTHONPATH": REPO, "PYSPARK_SUBMIT_ARGS": "--driver-memory 600m pyspark-shell", "PYSPARK_PYTHON": sys.executable}
    ran = subprocess.run([sys.executable, "-c", RUN, str(tmp_path / "docs.parquet")], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert f"FOUND {' '.join(map(str, want))}" in ran.stdout, ran.stderr[-2000:]
