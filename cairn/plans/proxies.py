"""The driver's tables, and views of them that stand for tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("track"), F.col("event_id").alias("ix"), F.col("ts").cast("timestamp").alias("ts"), F.expr("50 + (event_id * 37 % 5000) / 1000e0").alias("lat"), F.expr("-5 + (event_id * 91 % 6000) / 1000e0").alias("lon"), F.col("value").alias("ele"))
