"""Shapes of JSON bodies: which paths they have, of what types and how often; places in a shape; traffic against declarations."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import importable
from .diff import SEVERITIES


def _type(x: object) -> str:
    if x is None or isinstance(x, bool):
        return "null" if x is None else "boolean"
    return "number" if isinstance(x, int | float) else "string" if isinstance(x, str) else "array" if isinstance(x, list) else "object"


def places_of(body: str | None) -> list[tuple[str, list[str]]]:
    """(path, types) of one body: "" is the body, "a.b" a key, "a[]" an array's items; none for what isn't JSON."""
    try:
        todo = [("", json.loads(body))] if body else []
    except (ValueError, RecursionError):
        return []
    found: dict[str, set[str]] = {}
    while todo:
        path, x = todo.pop()
        found.setdefault(path, set()).add(_type(x))
        if isinstance(x, dict):
            todo += [(f"{path}.{k}" if path else k, v) for k, v in x.items()]
        elif isinstance(x, list):
            todo += [(f"{path}[]", v) for v in x]
    return [(p, sorted(t)) for p, t in found.items()]


def parent_of(path: Column) -> Column:
    """The object that a path's last key sits in: what stands before the last dot, else the body itself."""
    return F.regexp_extract(path, r"^(.*)\.[^.]*$", 1)


def body_shapes(bodies: DataFrame, keys: Sequence[str], body: str = "body") -> DataFrame:
    """(*keys, path, types, n, of, optional): over all bodies of each key, a body counting once for a path.

    `of` is how many bodies had the object that the path sits in; optional says that some of them lacked it. Bodies that aren't
    JSON (nulls too) have no shape. Python sees each body once, in Arrow batches; counts are summed before the shuffle.
    """
    importable(bodies.sparkSession)

    @F.pandas_udf("array<struct<path: string, types: array<string>>>")
    def places(column: pd.Series) -> pd.Series:
        return column.map(lambda x: [{"path": p, "types": t} for p, t in places_of(x)])

    rows = bodies.select(*keys, F.explode(places(F.col(body))).alias("x")).select(*keys, "x.path", "x.types")
    # at most one set for each mix of six types, so the collected sets are bounded
    n = rows.groupBy(*keys, "path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"), F.count("*").alias("n"))
    above = n.select(*keys, F.col("path").alias("_parent"), F.col("n").alias("of"))
    x = n.withColumn("_parent", parent_of(F.col("path"))).join(above, [*keys, "_parent"])
    return x.select(*keys, "path", "types", "n", "of", ((F.col("n") < F.col("of")) & ~F.col("path").endswith("[]")).alias("optional"))


def shape_at(shapes: DataFrame, path: str) -> DataFrame:
    """The rows of one place of the shapes, such as "a.b[].c"; none where no body has it."""
    return shapes.filter(F.col("path") == path)


def compare_traffic(shapes: DataFrame, declared: DataFrame, keys: Sequence[str], least: int = 50) -> DataFrame:
    """(*keys, path, kind, severity, seen, of): where traffic differs from what is declared, a warning at most.

    declared (*keys, path, type, optional): types joined by "|"; any and unknown take everything. A field that no body carried
    is told only where its object was: required (missing_required), or optional and `least` bodies could have had it
    (declared_never_sent). Fields below an undeclared one are not told again. Keys without any declaration are left out.
    """
    k = list(keys)
    s = shapes.filter(~F.col("path").endswith("[]") & (F.col("path") != "")).select(*k, "path", "types", "n", F.col("of").alias("_of"), F.lit(True).alias("_sent"))
    d = declared.select(*k, "path", F.col("type").alias("_type"), F.col("optional").alias("_opt"), F.lit(True).alias("_decl"))
    objects = shapes.select(*k, F.col("path").alias("_parent"), F.col("n").alias("_held"))
    # an array's items are declared with the array
    places = declared.select(*k, F.regexp_replace("path", r"(\[\])+$", "").alias("_above")).union(declared.select(*k, F.lit("").alias("_above"))).distinct().withColumn("_known", F.lit(True))
    x = s.join(d, [*k, "path"], "full").withColumn("_parent", parent_of(F.col("path"))).withColumn("_above", F.regexp_replace("_parent", r"(\[\])+$", ""))
    x = x.join(objects, [*k, "_parent"], "left").join(places, [*k, "_above"], "left").filter("_known")
    kinds = F.transform(F.split("_type", r"\s*\|\s*"), lambda t: F.when(t.isin("Date", "bigint"), "string").when(t.rlike(r"\[\]$|^Array<"), "array").when(t.isin("string", "number", "boolean", "null", "any", "unknown"), t).otherwise("object"))
    loose = F.arrays_overlap(kinds, F.array(F.lit("any"), F.lit("unknown")))
    other = F.array_except("types", F.when(F.col("_opt"), F.concat(kinds, F.array(F.lit("null")))).otherwise(kinds))
    sent, told = F.col("_sent").isNotNull(), F.col("_decl").isNotNull()
    found = F.array(
        F.when(sent & ~told, "extra_field"),
        F.when(~sent & told & ~F.col("_opt") & (F.col("_held") > 0), "missing_required"),
        F.when(~sent & told & F.col("_opt") & (F.col("_held") >= least), "declared_never_sent"),
        F.when(sent & told & ~F.col("_opt") & (F.col("n") < F.col("_of")), "optionality_mismatch"),
        F.when(sent & told & ~loose & (F.size(other) > 0), "type_mismatch"),
    )
    severity = F.lit("warning")
    for kind, own in SEVERITIES.items():
        severity = F.when(F.col("kind") == kind, F.lit(own if own != "error" else "warning")).otherwise(severity)
    out = x.select(*k, "path", F.explode(F.array_compact(found)).alias("kind"), F.coalesce("n", F.lit(0)).alias("seen"), F.coalesce("_of", "_held").alias("of"))
    return out.select(*k, "path", "kind", F.when(F.col("kind") == "declared_never_sent", "info").otherwise(severity).alias("severity"), "seen", "of")
