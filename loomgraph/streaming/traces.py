"""Live spans with Structured Streaming: sessions of traces, hourly windows, exactly-once batches merged into stored partials."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.telemetry import failed, merge, partials
from ..store import shared_dir


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream has by now, written once to the shared folder: availableNow, as on the final flush."""
    spark, base = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/loomgraph/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def events_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)


def sessions(spans: DataFrame, key: str = "trace_id", gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """A trace is over when nothing came for `gap` of event time: (key, start, end, spans, errors).

    State is bounded by the watermark, not by a count of spans; a span later than `late` is dropped by Spark.
    """
    w = spans.withWatermark("at", late).groupBy(F.session_window("at", gap), key)
    out = w.agg(F.count("*").alias("spans"), F.count_if(failed()).alias("errors"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "spans", "errors")


def hourly(spans: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    w = spans.withWatermark("at", late).groupBy(F.window("at", "1 hour"), key)
    return w.agg(F.count("*").alias("count"), F.count_if(failed()).alias("errors"), F.max("duration_ms").alias("max_ms")).select(F.col("window.start").alias("hour"), key, "count", "errors", "max_ms")


def once(spans: DataFrame, key: str = "span_id", late: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen before within the watermark."""
    return spans.withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def merge_into(stream: DataFrame, path: str, keys: list[str], state: str) -> None:
    """Each batch's partials are appended under its number, overwritten if the batch is run again: so counted exactly once."""
    def put(batch: DataFrame, number: int) -> None:
        partials(batch, keys).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def merged(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    return merge(spark.read.option("basePath", path).parquet(path).drop("batch"), keys)
