"""Streams: calendar windows over event time, late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int | None = None) -> DataFrame:
    """New parquet files of a folder, with the schema of a table like them."""
    reader = spark.readStream.schema(like.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def tumbling(events: DataFrame, time_col: str, key: str, value: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """window_start, key, n, total of events (a stream or a table) per window of ``width``."""
    timed = events.withColumn("_time", F.col(time_col).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_time", delay)
    made = timed.groupBy(F.window("_time", width).alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))
    return made.select(F.col("w.start").alias("window_start"), "key", "n", "total")


def sessions(events: DataFrame, time_col: str, key: str, gap: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """key, session_start, session_end, n: bursts of a key's events without a pause of ``gap``."""
    timed = events.withColumn("_time", F.col(time_col).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_time", delay)
    made = timed.groupBy(F.session_window("_time", gap).alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return made.select("key", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def run_to_path(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> None:
    """Read what is there, write the result as Parquet, each batch's whole result in place of the last (complete) or beside it (append), and stop.

    Appended batches go to folders named by their number, so one that is run again after a failure
    replaces what it wrote the first time; read_batches reads them all.
    """

    def sink(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={batch}")

    query = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_batches(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What a stream appended so far, with the columns of ``like``."""
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)
