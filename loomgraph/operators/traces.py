"""Traces as trees: depth of spans below their roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import materialise


def depths(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, depth, root): steps from each span up to one without a parent in its trace.

    A span knows an ancestor and its distance; each round it takes on what its ancestor knows, so a chain of n spans needs about
    log2(n) rounds, and a round is one join within traces. Spans on a ring of parents have no root and are left out.
    """
    own = spans.select("trace_id", "span_id", "parent_id").dropDuplicates(["trace_id", "span_id"])
    known = own.select("trace_id", F.col("span_id").alias("parent_id"), F.lit(True).alias("there"))
    first = own.join(known, ["trace_id", "parent_id"], "left")
    up = F.when(F.col("there"), F.col("parent_id"))
    now = materialise(first.select("trace_id", "span_id", F.coalesce(up, "span_id").alias("at"), F.when(up.isNull(), 0).otherwise(1).cast("long").alias("depth"), up.isNull().alias("done")), "depths")
    left, before = now.filter("not done").count(), -1
    while left and left != before:  # a round that settles no span leaves rings alone
        above = now.select("trace_id", F.col("span_id").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"), F.col("done").alias("top"))
        moved = now.join(above, ["trace_id", "at"]).select("trace_id", "span_id", F.col("next").alias("at"), F.when(F.col("done"), F.col("depth")).otherwise(F.col("depth") + F.col("more")).alias("depth"), (F.col("done") | F.col("top")).alias("done"))
        now = materialise(moved, "depths")
        left, before = now.filter("not done").count(), left
    return now.filter("done").select("trace_id", "span_id", "depth", F.col("at").alias("root"))
