"""Query and click logs as streams: click success by an interval join, sessions and counts with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as X


def log_stream(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON lines of a folder as they arrive, with event time `ts`; unparseable lines are left out."""
    fields = {"query_log": schema.QUERY_LOG, "click_log": schema.CLICK_LOG}[kind]
    rows = spark.readStream.schema(fields).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("ts", F.timestamp_micros(X.iso_micros(F.col("timestamp")))).where(F.col("ts").isNotNull() & F.col("request_id").isNotNull())


def successful_queries(queries: DataFrame, clicks: DataFrame, seconds: int = 30, late: str = "10 minutes") -> DataFrame:
    """Clicks within `seconds` of their query, joined as they arrive; state older than the watermark is dropped."""
    q = queries.withWatermark("ts", late).select(F.col("request_id").alias("q_id"), F.col("ts").alias("q_ts"), "mode")
    c = clicks.withWatermark("ts", late).select("request_id", F.col("ts").alias("c_ts"), "clicked_rank")
    return q.join(c, F.expr(f"q_id = request_id AND c_ts >= q_ts AND c_ts <= q_ts + interval {seconds} seconds"))


def sessions(queries: DataFrame, gap: str = "30 seconds", late: str = "10 minutes", by: str = "selected_lang") -> DataFrame:
    """Sessions of queries that follow each other within the gap: start, end and how many."""
    return queries.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("queries")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "queries")


def traffic(queries: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Queries and empty results by hour and mode; a request counts once, however often it arrives within the watermark."""
    once = queries.withWatermark("ts", late).dropDuplicatesWithinWatermark(["request_id"])
    return once.groupBy(F.window("ts", window).alias("w"), "mode").agg(F.count("*").alias("queries"), F.count_if(F.col("result_count") == 0).alias("empty")).select(F.col("w.start").alias("start"), "mode", "queries", "empty")


def upsert_stream(stream: DataFrame, store, alias: str, keys: list[str], version: list[str], checkpoint: str, buckets: int = 64):
    """Merge each micro-batch into the dataset behind an alias, latest version wins; a batch is published whole or not at all.

    The dataset lies in buckets of its keys, and a batch rewrites those it touches.
    """

    def merge(batch: DataFrame, _: int) -> None:
        store.merge_buckets(batch.dropDuplicates(), alias, keys, version, buckets)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)
