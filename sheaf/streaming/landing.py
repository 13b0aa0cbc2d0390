"""Streams: files that land in a folder, and events by window, session and first occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import udf
from ..sources.files import stream_files


def landed_documents(spark: SparkSession, path: str, delay: str = "1 hour") -> DataFrame:
    """Files as they land, each content once within the delay, detected and converted."""
    files = stream_files(spark, path).withColumn("digest", F.sha2("content", 256)).withWatermark("modificationTime", delay)
    once = files.dropDuplicatesWithinWatermark(["digest"])
    return once.select("path", "name", "length", "digest", udf.detect(F.col("content"), F.col("name")).alias("format"), udf.to_markdown(F.col("content"), F.col("name")).alias("converted"))


def windowed(events: DataFrame, length: str, delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums of `value` by event type and window of `ts`; late events count up to the delay."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    known = events.withWatermark("ts", delay) if events.isStreaming else events
    return known.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"), F.max("value").alias("largest")).select(F.col("w.start").alias("window_start"), "event_type", "n_events", "total", "largest")


def sessions(events: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    """Sessions of a user: events less than the gap apart."""
    known = events.withWatermark("ts", delay) if events.isStreaming else events
    return known.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n_events")).select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n_events")


def run_available(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what there is and ends; the result is written below the folder, which executors share.

    A batch that is tried again overwrites what it wrote. In complete mode the last batch has the whole result.
    """
    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result" if mode == "complete" else f"{folder}/result/batch={n}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/result")
