"""Aggregates over spans: hourly partials, the log-histogram sketch and its quantiles, samples, comparison of windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def round_half_up(x: Column, places: int = 2) -> Column:
    return F.floor(x * 10**places + 0.5) / 10**places


def bucket(ms: Column) -> Column:
    """Eight buckets for each doubling of a duration; null for durations that aren't finite or are negative."""
    fine = ms.isNotNull() & ~F.isnan(ms) & (ms >= 0) & (ms < float("inf"))
    return F.when(fine, F.floor(F.ln(F.greatest(ms, F.lit(0.01))) / (F.ln(F.lit(2.0)) / 8) + 0.5).cast("int"))


def edge_of(b: Column) -> Column:
    """Upper edge of a bucket, rounded to two places."""
    return round_half_up(F.pow(F.lit(2.0), (b + 0.5) / 8))


def failed() -> Column:
    return F.coalesce(F.col("error"), F.lit(False)) | (F.coalesce(F.col("status"), F.lit(0)) >= 500)


def partials(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mergeable state for each key: count, errors, greatest duration, first and last time. Sums and extremes only."""
    return spans.groupBy(*keys).agg(
        F.count("*").alias("count"), F.count_if(failed()).alias("errors"), F.max("duration_ms").alias("max_ms"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen")
    )


def merge(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of parts to the state of the whole."""
    return states.groupBy(*keys).agg(
        F.sum("count").alias("count"), F.sum("errors").alias("errors"), F.max("max_ms").alias("max_ms"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def histogram(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    return spans.withColumn("bucket", bucket(F.col("duration_ms"))).filter("bucket is not null").groupBy(*keys, "bucket").agg(F.count("*").alias("n"))


def quantiles(hist: DataFrame, keys: Sequence[str], q: Sequence[float]) -> DataFrame:
    """Nearest-rank quantiles from a histogram: columns p50, p95, ...; the upper edge of the first bucket that reaches the rank.

    A key has at most some hundred buckets, so its window is small however many spans there are.
    """
    w = Window.partitionBy(*keys).orderBy("bucket")
    whole = Window.partitionBy(*keys)
    cum = hist.withColumn("_c", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_t", F.sum("n").over(whole))
    return cum.groupBy(*keys).agg(*[edge_of(F.min(F.when(F.col("_c") >= F.greatest(F.lit(1), F.ceil(F.col("_t") * x)), F.col("bucket")))).alias(f"p{round(x * 100)}") for x in q])


def summary(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """count, errors, error_rate (four places), p50, p95 (never over the greatest) and max_ms of each key."""
    base, q = partials(spans, keys), quantiles(histogram(spans, keys), keys, (0.5, 0.95))
    top = round_half_up(F.col("max_ms"))
    out = base.join(q, list(keys), "left")
    return out.select(
        *keys, "count", "errors", round_half_up(F.col("errors") / F.col("count"), 4).alias("error_rate"), F.least("p50", top).alias("p50"), F.least("p95", top).alias("p95"), top.alias("max_ms")
    )


def hours(spans: DataFrame) -> DataFrame:
    """Spans with `hour`: their own, else their trace's first, else the last of all."""
    first = F.min("at").over(Window.partitionBy("trace_id"))
    last = spans.agg(F.max("at").alias("_last"))
    own = spans.withColumn("_first", first)
    return own.join(F.broadcast(last)).withColumn("hour", F.date_trunc("hour", F.coalesce("at", "_first", "_last")).cast("timestamp_ntz")).drop("_first", "_last")


def samples(spans: DataFrame, key: str, most: int = 3) -> DataFrame:
    """For each key the slowest spans and the latest failing ones, one for each trace: (key, why, rank, span_id)."""
    out = None
    for why, df, order in (
        ("slow", spans, [F.desc("duration_ms"), F.col("span_id")]),
        ("failing", spans.filter(failed()), [F.desc("at"), F.col("span_id")]),
    ):
        one = df.withColumn("_k", F.row_number().over(Window.partitionBy(key, "trace_id").orderBy(*order))).filter("_k = 1")
        top = one.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= most)
        part = top.select(key, F.lit(why).alias("why"), "rank", "span_id")
        out = part if out is None else out.unionByName(part)
    return out


def compare(a: DataFrame, b: DataFrame, keys: Sequence[str], least: int = 20) -> DataFrame:
    """Two windows' summaries: state appeared, gone, few, slower, failing or same."""
    x = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in ("count", "p95", "error_rate")])
    y = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("count", "p95", "error_rate")])
    both = x.join(y, list(keys), "full")
    slower = (F.col("b_p95") - F.col("a_p95")) >= F.greatest(F.lit(1.0), F.col("a_p95") * 0.1)
    state = (
        F.when(F.col("a_count").isNull(), "appeared")
        .when(F.col("b_count").isNull(), "gone")
        .when((F.col("a_count") < least) | (F.col("b_count") < least), "few")
        .when(F.col("b_error_rate") - F.col("a_error_rate") >= 0.01, "failing")
        .when(slower, "slower")
        .otherwise("same")
    )
    return both.select(*keys, "a_count", "b_count", "a_p95", "b_p95", state.alias("state"))
