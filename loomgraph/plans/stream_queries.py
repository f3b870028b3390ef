"""Streaming operators, drained over the events and compared with the batch answer."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import views as V
from ..store import shared_dir
from ..streaming import capacity as C
from ..streaming import traces as T
from .registry import query
from .telemetry_queries import BAD, SP


def stream(s, d):
    """The events as a stream of spans; what needs a window over all rows (the parent) is left out."""
    path = f"{d}/events.parquet"
    # as a pattern, since the source takes a single file only so
    e = T.events_stream(s, f"{d}/[e]vents.parquet", s.read.parquet(path).schema)
    return e.select(
        F.col("event_id").alias("span_id"), F.col("user_id").cast("string").alias("trace_id"), F.col("event_type").alias("entry"), F.col("ts").cast("timestamp").alias("at"),
        F.when(F.col("event_type") == "error", 500).when(F.col("event_id") % 17 == 0, 404).otherwise(200).alias("status"), F.col("value").alias("duration_ms"), (F.col("event_id") % 101 == 0).alias("error"),
    )


@query("str_02_trace_sessions", SP + f", u as (select split_part(trace_id, '/', 1) as trace_id, \"at\", status, error from spans), g as (select *, case when \"at\" - lag(\"at\") over (partition by trace_id order by \"at\") < interval 6 hour then 0 else 1 end as new from u), n as (select *, sum(new) over (partition by trace_id order by \"at\" rows unbounded preceding) as k from g) select trace_id, min(\"at\") as start, max(\"at\") + interval 6 hour as \"end\", count(*) as spans, count(*) filter ({BAD}) as errors from n group by trace_id, k having max(\"at\") + interval 6 hour < (select max(\"at\") - interval 10 minute from spans)")
def trace_sessions(s, d):
    out = T.drain(T.sessions(stream(s, d), gap="6 hours"), "sessions")
    last = s.read.parquet(f"{d}/events.parquet").agg((F.max(F.col("ts").cast("timestamp")) - F.expr("interval 10 minutes")).alias("m"))
    closed = out.join(F.broadcast(last)).filter("end < m").drop("m")
    return closed.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("str_03_capacity", SP + f"select split_part(trace_id, '/', 1) as trace_id, count(*) as spans, count(*) filter ({BAD}) as errors, count(*) // 20 as cut_short, cast(ceil(count(*) / 20) as bigint) as pieces from spans group by 1")
def capacity(s, d):
    """Traces under a bound of 20 spans: their pieces add up. A last span, long after the others, closes all."""
    own = stream(s, d)
    path = f"{shared_dir(s)}/loomgraph/closing-{uuid.uuid4().hex}"
    last = F.to_timestamp(F.lit("2100-01-01 00:00:00"))
    closing = s.range(1).select(F.col("id").alias("span_id"), F.lit("~").alias("trace_id"), F.lit("end").alias("entry"), last.alias("at"), F.lit(200).alias("status"), F.lit(0.0).alias("duration_ms"), F.lit(False).alias("error"))
    closing.coalesce(1).write.parquet(path)
    both = own.unionByName(s.readStream.schema(closing.schema).parquet(path))
    pieces = T.drain(C.bounded_traces(both, 20, "1 hour"), "pieces").filter("trace_id <> '~'")
    return pieces.groupBy("trace_id").agg(F.sum("spans").alias("spans"), F.sum("errors").alias("errors"), F.count_if("cut_short").alias("cut_short"), F.count("*").alias("pieces"))


@query("str_06_incremental_merge", SP + f"select entry, count(*) as \"count\", count(*) filter ({BAD}) as errors, max(duration_ms) as max_ms from spans group by 1")
def incremental_merge(s, d):
    base = f"{shared_dir(s)}/loomgraph/merge-{uuid.uuid4().hex}"
    T.merge_into(stream(s, d), f"{base}/out", ["entry"], f"{base}/state")
    return T.merged(s, f"{base}/out", ["entry"]).select("entry", "count", "errors", "max_ms")


@query("str_05_exactly_once", "select event_type as entry, count(*) as n from events group by 1")
def exactly_once(s, d):
    """Every event comes twice and is counted once."""
    x = stream(s, d)
    return T.drain(T.once(x.union(x)).select("span_id", "entry"), "once").groupBy("entry").agg(F.count("*").alias("n"))


@query("src_12_url_archive", "select lower(regexp_extract(url, '^([a-z]+)://', 1)) as scheme, count(*) as n from pages group by 1")
def url_schemes(s, d):
    return V.read(s, d, "pages").groupBy(F.lower(F.regexp_extract("url", "^([a-z]+)://", 1)).alias("scheme")).agg(F.count("*").alias("n"))
