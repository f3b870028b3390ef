"""Architecture rules over hops between labelled ends: forbid, only, tags and reachable, and what they leave unchecked."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .traverse import reach


def glob(column: Column, pattern: str) -> Column:
    """"*" for any text; the whole value, with case."""
    import re

    return column.rlike("^" + ".*".join(re.escape(x) for x in re.split(r"\*+", pattern)) + "$")


@dataclass(frozen=True)
class Rule:
    name: str
    shape: str  # forbid, only, tags or reachable
    source: dict = field(default_factory=dict)  # column of nodes -> pattern
    target: dict = field(default_factory=dict)
    transitive: bool = False
    must: bool = False  # reachable: has to be reached, or must not
    tag: str = ""  # tags: ends tagged so may only go to `may`
    may: tuple[str, ...] = ()
    severity: str = "error"


def selected(nodes: DataFrame, selector: dict) -> DataFrame:
    test = reduce(lambda a, b: a & b, [glob(F.coalesce(F.col(c), F.lit("")), p) for c, p in selector.items()], F.lit(True))
    return nodes.filter(test).select("id")


def evaluate(nodes: DataFrame, edges: DataFrame, rules: Iterable[Rule], depth: int | None = None) -> DataFrame:
    """(rule, severity, from_id, to_id): a row for each violation; (rule, "unchecked", null, null) where a selector fits nothing.

    nodes: id and the columns that selectors name, with tag for rules on tags. Direct rules look at single edges; transitive
    ones at all that is reached (within `depth` steps, where given), each start by itself, so the way's ends are known.
    """
    out = None
    for r in rules:
        a, b = selected(nodes, r.source), selected(nodes, r.target)
        hops = edges.select("from_id", "to_id")
        if r.shape != "tags" and (not a.limit(1).count() or not b.limit(1).count()):
            found = nodes.sparkSession.createDataFrame([(None, None)], "from_id string, to_id string").withColumn("severity", F.lit("unchecked"))
        else:
            start, end = a.withColumnRenamed("id", "from_id"), b.withColumnRenamed("id", "to_id")
            if r.transitive or r.shape == "reachable":
                seeds = (a if r.shape != "only" else nodes.select("id")).withColumn("from_id", F.col("id"))
                hops = reach(edges, seeds, "out", None, 1 << 20 if depth is None else depth, by="from_id").filter("depth > 0").select("from_id", F.col("id").alias("to_id"))
            if r.shape == "forbid":
                found = hops.join(start, "from_id", "left_semi").join(end, "to_id", "left_semi")
            elif r.shape == "only":
                found = hops.join(end, "to_id", "left_semi").join(start, "from_id", "left_anti")
            elif r.shape == "tags":
                tag = nodes.select("id", "tag")
                both = hops.join(tag.select(F.col("id").alias("from_id"), F.col("tag").alias("x")), "from_id").join(tag.select(F.col("id").alias("to_id"), F.col("tag").alias("y")), "to_id")
                found = both.filter((F.col("x") == r.tag) & ~F.col("y").isin(*r.may))
            elif r.must:
                hit = hops.join(end, "to_id", "left_semi").select("from_id").distinct()
                found = start.join(hit, "from_id", "left_anti").withColumn("to_id", F.lit(None).cast("string"))
            else:
                found = hops.join(start, "from_id", "left_semi").join(end, "to_id", "left_semi")
            found = found.select("from_id", "to_id").distinct().withColumn("severity", F.lit(r.severity))
        part = found.select(F.lit(r.name).alias("rule"), "severity", "from_id", "to_id")
        out = part if out is None else out.unionByName(part)
    return out
