"""Connected components of an edge table, by contraction; all state lies in tables of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for each id in edges (longs): root is the least id of its component.

    Each round maps every id to the least of itself and its neighbours, then contracts the edges to these; what is left
    shrinks at least by half, as every id that isn't least among its neighbours goes. The maps are composed at the end. A hub
    is one row of the joins' small side; its many edges are the other side, which adaptive execution splits.
    """
    left = materialise(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b").distinct(), "edges")
    maps: list[DataFrame] = []
    while left.limit(1).count():
        both = left.union(left.select("b", "a"))
        step = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("to")), "roots")
        x, y = step.select(F.col("id").alias("a"), F.col("to").alias("ta")), step.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        moved = left.join(x, "a").join(y, "b").filter("ta <> tb")
        left = materialise(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        maps.append(step)
    if not maps:
        return left.select(F.col("a").alias("id"), F.col("b").alias("root"))
    out = maps[-1].select("id", F.col("to").alias("root"))
    for step in reversed(maps[:-1]):
        up = out.select(F.col("id").alias("to"), "root")
        out = materialise(step.join(up, "to", "left").select("id", F.coalesce("root", "to").alias("root")), "roots")
    return out
