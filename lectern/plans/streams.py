"""Streaming counterparts of batch operators, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.plans.registry import query
from lectern.runtime import shared_dir
from lectern.sources.tables import table
from lectern.streaming import corpus, rate_limit


def _once(spark, d, name, columns, partitions):
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    table(spark, d, name, *columns).repartition(partitions).write.parquet(f"{base}/in")
    return base


@query("stream_incremental_scan", "SELECT doc_id, length(text) AS chars FROM documents")
def stream_incremental_scan(spark, d):
    base = _once(spark, d, "documents", ["doc_id", "text"], 4)
    stream = corpus.read_growing(spark, f"{base}/in", "doc_id long, text string", 2)
    corpus.run_available(stream, f"{base}/out", f"{base}/state", lambda b: b.select("doc_id", F.length("text").alias("chars")))
    return spark.read.parquet(f"{base}/out").select("doc_id", "chars")


@query("stream_window_counts", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(spark, d):
    base = _once(spark, d, "events", ["event_id", "ts", "event_type"], 1)
    stream = corpus.read_growing(spark, f"{base}/in", "event_id long, ts timestamp_ntz, event_type string").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counts = stream.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    rows = counts.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")
    corpus.run_updates(rows, f"{base}/out", f"{base}/state")
    return corpus.latest(spark, f"{base}/out", ["hour", "event_type"])


@query("stream_rate_limit")
def stream_rate_limit(spark, d):
    """The limiter as a stateful stream."""
    base = _once(spark, d, "events", ["event_id", "ts", "user_id"], 1)
    stream = corpus.read_growing(spark, f"{base}/in", "event_id long, ts timestamp_ntz, user_id long").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    out = rate_limit.decide_stream(stream, 3, 3600.0)
    out.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")
