"""Queries that drive trained models through Structured Streaming, and one-pass quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklore.catalogue import register
from ranklore.operators import scalar_hash as H
from ranklore.plans.workspace import fresh_path
from ranklore.queries.scalar_hash import _hash_sql
from ranklore.queries.tables import table
from ranklore.streaming import apply as A


@register(
    "streaming_hash_apply",
    _hash_sql("events", "value", 64, False, 32) + "SELECT event_id, h.hash::BIGINT AS hash FROM events JOIN h ON h.x = events.value",
)
def streaming_hash_apply(spark, sf_dir):
    """Events read as a stream, hashed without state, appended batch by batch, read back."""
    events = table(spark, sf_dir, "events")
    model = H.fit_scalar_hash(events, "value", "linear,linear", 64, 32)
    out, state = fresh_path(spark, "stream-out"), fresh_path(spark, "stream-state")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    sink = A.append_batches(out, lambda b: A.hash_stream(b, model, "value").select("event_id", F.col("hash").cast("bigint").alias("hash")))
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch")


@register("stream_quantiles", "SELECT min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg FROM events")
def stream_quantiles(spark, sf_dir):
    out = A.stream_quantiles(table(spark, sf_dir, "events"), "value", {"p50": 0.5, "p99": 0.99})
    return out.select("min", "max", F.round("avg", 6).alias("avg"))
