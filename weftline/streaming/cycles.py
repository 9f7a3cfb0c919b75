"""Cycles as a stream: metrics of assignments in event-time windows, late rows within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, glob: str = "events.parquet") -> DataFrame:
    """The events table as a stream of files."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)


def windowed_metrics(assignments: DataFrame, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """ts, rel_type, confidence -> a row for each window and type. What is kept is one row of sums for each open window."""
    timed = assignments.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    c = F.col("confidence")
    g = timed.groupBy(F.window("ts", every), "rel_type").agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean"), F.max(c).alias("high"), F.count_if(c >= 0.9).alias("excellent"))
    return g.select(F.dayofmonth("window.start").alias("cycle"), "rel_type", "n", "mean", "high", "excellent")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and returns its memory table; for tests and small reports."""
    spark = stream.sparkSession
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
