"""Streams over events, and corpus reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import landing
from .registry import query, table


def _folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, as in tests, one of this machine, which only a local master shares."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="sheaf-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS total, max(value) AS largest FROM events GROUP BY 1, 2")
def events_tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = landing.windowed(table(spark, sf_dir, "events"), "1 hour")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n_events FROM events GROUP BY 1, 2")
def events_tumbling_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = landing.run_available(landing.windowed(_stream(spark, sf_dir), "1 hour"), _folder(spark))
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_events")


@query("SELECT time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes' * k AS window_start, event_type, count(*) AS n_events FROM events, range(2) r(k) GROUP BY 1, 2")
def events_sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = landing.windowed(table(spark, sf_dir, "events"), "1 hour", slide="30 minutes")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_events")


@query("SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n_events FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def events_session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = landing.sessions(table(spark, sf_dir, "events"), "30 minutes")
    return out.withColumn("session_start", F.col("session_start").cast("timestamp_ntz")).withColumn("session_end", F.col("session_end").cast("timestamp_ntz"))


@query("SELECT user_id, event_type FROM events GROUP BY 1, 2")
def events_dedup_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = _stream(spark, sf_dir).withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type")
    return landing.run_available(once, _folder(spark), mode="append")


@query("SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS n, sum(n_chars)::BIGINT AS chars, grouping_id(lang, source) AS level FROM documents GROUP BY CUBE (lang, source)")
def corpus_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").cube("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().alias("level")).select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("source"), "n", "chars", "level")


@query("SELECT source, count(*) AS files, count(DISTINCT md5(text)) AS texts, max(n_chars) AS longest FROM documents GROUP BY source")
def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.countDistinct(F.md5(F.col("text").cast("binary"))).alias("texts"), F.max("n_chars").alias("longest"))


@query("SELECT doc_id, n_chars, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 3")
def longest_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    order = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, sf_dir, "documents").withColumn("k", F.row_number().over(order)).where("k <= 3").select("doc_id", "n_chars", "source")


@query("SELECT lang, 'img' || doc_id // 10 AS name, 'img' || doc_id // 10 || CASE WHEN k > 1 THEN '_' || (k - 1) ELSE '' END || '.png' AS file_name FROM (SELECT *, row_number() OVER (PARTITION BY lang, doc_id // 10 ORDER BY doc_id) AS k FROM documents)")
def image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import named_images

    rows = table(spark, sf_dir, "documents").select("lang", F.concat(F.lit("img"), F.floor(F.col("doc_id") / 10).cast("string")).alias("name"), F.lit("png").alias("format"), "doc_id")
    return named_images(rows, folder="lang").select("lang", "name", "file_name")
