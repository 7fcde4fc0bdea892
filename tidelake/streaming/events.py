"""Structured Streaming over event time: windows with watermarks and deduplication (keyed state: `notices`; merges of micro-batches: `sources.versioned`).

`run_available` reads what there is, writes with a checkpoint to a table, and stops: the same query as a daily job that catches
up where it left off, or, with another trigger, a continuous one.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read(spark: SparkSession, path: str, schema: str = EVENTS, files: int = 1) -> DataFrame:
    """A stream of the parquet files of a folder, or of one file, with ts as a UTC timestamp."""
    folder, _, name = path.rstrip("/").rpartition("/")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", name if name.endswith(".parquet") else "*.parquet")
    return s.parquet(folder if name.endswith(".parquet") else path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, width: str = "2 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def dedup(events: DataFrame, keys: Sequence[str], late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def run_available(stream: DataFrame, table: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Processes all that is there into a parquet table beside the checkpoint and returns it. Each micro-batch has a folder of
    its own, which a second attempt overwrites; in complete mode the last one is the table."""
    spark, path = stream.sparkSession, f"{checkpoint.rstrip('/')}-rows"

    def save(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch-{k:09d}")

    q = stream.writeStream.outputMode(mode).foreachBatch(save).queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    batches = sorted(s.getPath().toString() for s in fs.listStatus(folder)) if fs.exists(folder) else []
    if not batches:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(batches[-1:] if mode == "complete" else batches))


def due(last_success: str | None, now: pd.Timestamp, hour: int = 0, minute: int = 5) -> bool:
    """A daily run is due: after the time of day, and not yet today."""
    today = now.strftime("%Y-%m-%d")
    return (now.hour, now.minute) >= (hour, minute) and last_success != today
