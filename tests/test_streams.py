"""The reordering query with fewer slots than a stream has rows ahead of their turn."""

import pytest

from conftest import SF
from fluxtone.plans import streams
from fluxtone.streaming import jobs


@pytest.mark.parametrize("slots", [0, 2])
def test_reorder_loses_nothing_with_few_slots(spark, monkeypatch, slots):
    monkeypatch.setattr(streams, "SLOTS", slots)
    per_stream = {}
    for r in streams.stream_reorder(spark, SF).collect():
        per_stream.setdefault(r.stream, []).append((r.seq, r.place))
    want = {r.user_id: r["count"] for r in spark.read.parquet(f"{SF}/events.parquet").groupBy("user_id").count().collect()}
    assert {s: len(x) for s, x in per_stream.items()} == want
    assert all(sorted(x) == [(i, i) for i in range(len(x))] for x in per_stream.values())


def test_numbers_over_many_blocks_with_repeats(spark):
    rows = [(s, q, float(q), -1) for s in (1, 2) for q in range(s, 400, 7)]
    got = jobs.in_order(spark.createDataFrame(rows + rows[::5], "stream long, seq long, x double, place long").repartition(3), width=16)
    assert sorted((r.stream, r.seq, r.place) for r in got.collect()) == [(s, q, i) for s in (1, 2) for i, q in enumerate(range(s, 400, 7))]


def _arrivals(spark, tmp_path, lots):
    for i, rows in enumerate(lots):
        spark.createDataFrame(rows, "stream long, seq long, t long, x double").selectExpr("stream", "seq", "timestamp_seconds(t) as t", "x").coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
    return spark.readStream.schema("stream long, seq long, t timestamp, x double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def test_jitter_waits_in_time_and_no_longer(spark, tmp_path):
    lots = [
        [(1, 0, 100, 0.0), (1, 2, 102, 2.0), (2, 1, 100, 1.0)],
        [(1, 1, 101, 1.0), (1, 1, 101, 9.0), (1, 5, 105, 5.0), (3, 0, 105, 0.0)],  # in time, a repeat; 3 and 4 are missing
        [(3, 1, 120, 1.0)],  # time passes
        [(3, 2, 121, 2.0)],  # stream 2 gives up 0, stream 1 gives up 3 and 4, though nothing of theirs comes
        [(1, 4, 119, 4.0), (1, 3, 121, 3.0), (1, 6, 121, 6.0)],  # too late: given up; 6 goes on
        [(3, 9, 125, 9.0)],  # waits to the end
    ]
    out = jobs.finish(jobs.jitter(_arrivals(spark, tmp_path, lots), 10), "jitter").collect()
    got = sorted((r.stream, r.seq, r.x, r.place, r.missing) for r in out)
    assert got == [(1, 0, 0.0, 0, 0), (1, 1, 1.0, 1, 0), (1, 2, 2.0, 2, 0), (1, 5, 5.0, 3, 2), (1, 6, 6.0, 4, 0), (2, 1, 1.0, 0, 1), (3, 0, 0.0, 0, 0), (3, 1, 1.0, 1, 0), (3, 2, 2.0, 2, 0)]


def test_a_cluster_without_a_shared_folder_fails_and_a_local_one_sets_nothing(spark):
    class Far:
        master = "spark://somewhere:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext = Far()  # noqa: N815
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        jobs.shared_folder(Session())
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert jobs.shared_folder(spark).startswith(("file:", "/")) and spark.conf.get("spark.checkpoint.dir", None) == before
