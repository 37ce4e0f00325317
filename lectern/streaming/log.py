"""Pipeline events as a stream: an append-only log, stage status, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG = "ts timestamp, pair_id string, stage string, status string, ms long, info string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(LOG).json(path)


def append_log(events: DataFrame, path: str, checkpoint: str):
    """Writes a stream of events to a Parquet log once each; returns the running query."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stage_status(log: DataFrame) -> DataFrame:
    """The latest status of each stage of each pair."""
    last = Window.partitionBy("pair_id", "stage").orderBy(F.desc("ts"))
    return log.withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn")


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window; in a stream, events later than the watermark are dropped."""
    src = events.withWatermark(ts, late) if events.isStreaming else events
    return src.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
