"""Shared helpers: table access, tables in the shared scratch folder, the label fold and connected components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where all run in one process.

    On a cluster without that setting there is no such folder, and this fails.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_folder()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='fluxtone-')}"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of some hundred texts: the default of 10,000 rows holds too much memory when texts are long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 500:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def small_reads(spark: SparkSession) -> None:
    """Parquet batches of some hundred texts: a reader holds its batch on the heap, and grows it by doubling."""
    if int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) > 256:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "256")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone by then
        if spark.sparkContext._jsc is not None:
            remove(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes the rows as Parquet to the shared folder and reads them back.

    A lost executor costs nothing that is already written. The files go when the driver ends, or
    earlier through ``drop_stored``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(remove_at_exit, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_path = path
    return back


def drop_stored(df: DataFrame) -> None:
    remove(df.sparkSession, df._stored_path)


def row_hash(docs: DataFrame, struct: str) -> F.Column:
    """64-bit hash of a row of ``docs`` held in the column ``struct``; maps, which have no hash, are left out."""
    return F.xxhash64(*[F.col(f"{struct}.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])


def held_out() -> F.Column:
    """True for the fold that no model here may learn from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Smallest reachable node for each node of an undirected graph.

    ``edges`` (a long, b long); ``labels`` (node, label) may hold a start from an earlier call.
    Returns (node, label). Each round gives a node the least label among its own, its neighbours'
    and its label's label, so stars and chains alike end after about log(length) rounds. A round is
    two aggregations with map-side combining, which a hub of any degree does not upset, and its
    result is a written table.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    nodes = both.select(F.col("a").alias("node")).distinct()
    if labels is None:
        now = nodes.select("node", F.col("node").alias("label"))
    else:
        now = labels.select("node", "label").union(nodes.join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
    now = stored(now, "labels")
    while True:
        near = both.join(now, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "label")
        root = now.alias("x").join(now.alias("y"), F.col("x.label") == F.col("y.node")).select(F.col("x.node").alias("node"), F.col("y.label").alias("label"))
        # what a node learns goes to its old label too, so that whole trees move at once
        hook = near.alias("n").join(now.alias("m"), "node").select(F.col("m.label").alias("node"), F.col("n.label").alias("label"))
        new = stored(now.union(near).union(root).union(hook).groupBy("node").agg(F.min("label").alias("label")), "labels")
        moved = new.alias("x").join(now.alias("y"), "node").where("x.label <> y.label").limit(1).count()
        drop_stored(now)
        now = new
        if not moved:
            drop_stored(both)
            return now
