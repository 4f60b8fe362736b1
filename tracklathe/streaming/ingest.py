"""Trajectory points from a growing folder, without duplicates, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def points(spark: SparkSession, folder: str, schema: T.StructType, key: str = "flight_id", time: str = "timestamp", lateness: str = "10 minutes") -> DataFrame:
    """New files as a stream; a key and time is let through once while within ``lateness``."""
    return spark.readStream.schema(schema).parquet(folder).withWatermark(time, lateness).dropDuplicatesWithinWatermark([key, time])


def minute_means(stream: DataFrame, value: str, key: str = "flight_id", time: str = "timestamp") -> DataFrame:
    """Mean and count of a value by key and minute."""
    return stream.groupBy(F.window(time, "1 minute"), key).agg(F.avg(value).alias("mean"), F.count(value).alias("n")).select(F.col("window.start").alias("minute"), key, "mean", "n")
