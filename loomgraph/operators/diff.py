"""Comparison of two versions: rows by key, bags, flattened types with severities, specs, sequences."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import importable


def diff_rows(base: DataFrame, head: DataFrame, keys: Sequence[str], compared: Sequence[str], position: Sequence[str] = ()) -> DataFrame:
    """(*keys, change): added, removed, changed (any compared column, nulls equal nulls) or moved (only position differs)."""
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(*keys, F.struct(*compared).alias(f"{p}c"), (F.struct(*position) if position else F.lit(0)).alias(f"{p}p"), F.lit(True).alias(p))

    both = side(base, "b").join(side(head, "h"), list(keys), "full")
    change = (
        F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").when(~F.col("bc").eqNullSafe(F.col("hc")), "changed").when(~F.col("bp").eqNullSafe(F.col("hp")), "moved")
    )
    return both.select(*keys, change.alias("change")).filter("change is not null")


def lost_joins(base: DataFrame, head: DataFrame) -> DataFrame:
    """Callers (from_id) that had edges in base, still occur in head's callers table and have none there."""
    return base.select("from_id").distinct().join(head.select("from_id"), "from_id", "left_anti")


def bag_difference(base: DataFrame, head: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, gone, came): how many more rows of each key either side has."""
    a, b = base.groupBy(*keys).agg(F.count("*").alias("a")), head.groupBy(*keys).agg(F.count("*").alias("b"))
    both = a.join(b, list(keys), "full").fillna(0, ["a", "b"])
    return both.select(*keys, F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("gone"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("came")).filter("gone > 0 or came > 0")


def flatten_types(types: DataFrame, depth: int = 3) -> DataFrame:
    """types (id, fields array<struct<name, type, optional>>) -> (id, path, type, optional); nested ids ("type:x") to `depth`."""
    fields = types.select("id", F.explode("fields").alias("f")).select("id", "f.name", "f.type", "f.optional")
    level = fields.select("id", F.col("name").alias("path"), "type", "optional", F.array("id").alias("seen"))
    out = level.drop("seen")
    inner = fields.select(F.col("id").alias("of"), "name", F.col("type").alias("t"), F.col("optional").alias("o"))
    for _ in range(depth - 1):
        own = level.filter(F.col("type").startswith("type:")).withColumn("of", F.col("type"))
        own = own.filter(~F.array_contains("seen", F.col("of")))
        level = own.join(inner, "of").select("id", F.concat_ws(".", "path", "name").alias("path"), F.col("t").alias("type"), F.col("o").alias("optional"), F.array_append("seen", F.col("of")).alias("seen"))
        out = out.unionByName(level.drop("seen"))
    return out


def wire_view(fields: DataFrame) -> DataFrame:
    """Types as they cross a wire: dates, big integers and buffers are strings, sets are arrays, maps objects; undefined vanishes."""
    t = F.col("type")
    seen = F.when(t.isin("Date", "bigint", "Buffer", "ObjectId"), "string").when(t.startswith("Set<"), F.concat(F.lit("Array<"), t.substr(F.lit(5), F.length(t)))).when(t.startswith("Map<"), "object").otherwise(F.replace(t, F.lit(" | undefined"), F.lit("")))
    return fields.withColumn("optional", F.col("optional") | t.contains("undefined")).withColumn("type", seen)


#: Severity of each kind of finding.
SEVERITIES = {"missing_required": "error", "type_mismatch": "error", "optionality_mismatch": "warning", "extra_field": "info"}


def compare_fields(sent: DataFrame, wanted: DataFrame, keys: Sequence[str] = ("pair",)) -> DataFrame:
    """(*keys, path, kind, severity): flattened fields sent against those wanted; any and unknown agree with everything."""
    a = sent.select(*keys, "path", F.col("type").alias("st"), F.col("optional").alias("so"))
    b = wanted.select(*keys, "path", F.col("type").alias("wt"), F.col("optional").alias("wo"))
    both = a.join(b, [*keys, "path"], "full")
    loose = F.col("st").isin("any", "unknown") | F.col("wt").isin("any", "unknown")
    kind = (
        F.when(F.col("st").isNull() & ~F.col("wo"), "missing_required")
        .when(F.col("wt").isNull(), "extra_field")
        .when((F.col("st") != F.col("wt")) & ~loose, "type_mismatch")
        .when(F.col("so") & ~F.col("wo"), "optionality_mismatch")
    )
    severity = F.lit(None).cast("string")
    for k, v in SEVERITIES.items():
        severity = F.when(F.col("kind") == k, v).otherwise(severity)
    return both.withColumn("kind", kind).filter("kind is not null").select(*keys, "path", "kind", severity.alias("severity"))


def delta(base: DataFrame, head: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, state): new, fixed or existing findings."""
    a, b = base.select(*keys).distinct().withColumn("a", F.lit(1)), head.select(*keys).distinct().withColumn("b", F.lit(1))
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "fixed").otherwise("existing")
    return a.join(b, list(keys), "full").select(*keys, state.alias("state"))


def sequence_steps(base: Sequence[str], head: Sequence[str]) -> list[tuple[str, str]]:
    """Longest common subsequence of two step lists; on ties the base's step goes first."""
    n, m = len(base), len(head)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if base[i] == head[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and base[i] == head[j]:
            out.append(("same", base[i]))
            i, j = i + 1, j + 1
        elif i < n and (j == m or best[i + 1][j] >= best[i][j + 1]):
            out.append(("removed", base[i]))
            i += 1
        else:
            out.append(("added", head[j]))
            j += 1
    return out


def diff_sequences(pairs: DataFrame) -> DataFrame:
    """pairs (flow, base array<string>, head array<string>) -> (flow, place, change, step). Arrow batches; a flow is one row."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(x.flow, i, c, s) for x in f.itertuples() for i, (c, s) in enumerate(sequence_steps(list(x.base), list(x.head)))]
            yield pd.DataFrame(rows, columns=["flow", "place", "change", "step"])

    importable(pairs.sparkSession)
    return pairs.mapInPandas(run, "flow long, place int, change string, step string")
