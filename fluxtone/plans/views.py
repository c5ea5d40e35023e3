"""Signal views over the shared tables: every ordering key is a column.

frames      id, x array<double>, label     one 64-sample frame per embedding
pcm         id, v array<int>, label        frames as 16-bit samples
series      stream, seq, t, x              events as one signal per user
payload     id, b binary                   documents as bytes
packets     ssrc, seq, marker, b           conversation turns as packets; a marker ends a frame
lossy       stream, seq, x                 series with lost and repeated packets
correlated  id, n, v                       pcm integrated twice, so that predictors have something to predict
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


def frames_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("id", F.posexplode("x").alias("n", "x"))


def pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("id", F.transform("x", lambda x: (x * 32767).cast("int")).alias("v"), "label")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("t"), (F.col("value") / 1000).alias("x"))


def payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.encode("text", "utf-8").alias("b"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("ssrc"), F.col("turn").alias("seq"), (F.col("role") == "assistant").alias("marker"), F.encode("text", "utf-8").alias("b"))


def lossy(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("stream").orderBy("seq")).cast("long")
    numbered = series(spark, sf_dir).select("stream", turn.alias("seq"), "x")
    heard = numbered.where("seq % 10 <> 3")
    return heard.unionByName(heard.where("seq % 17 = 5"))


def correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    so_far = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    long = pcm(spark, sf_dir).select("id", F.posexplode("v").alias("n", "v")).select("id", "n", F.col("v").cast("long").alias("v"))
    for _ in range(2):
        long = long.withColumn("v", F.sum("v").over(so_far)).withColumn("v", F.expr("v div 64"))
    return long
