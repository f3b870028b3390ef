"""Orders, first rows and bounded tops: what is asked for as "first", "worst" or "at most" over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import materialise, sized

# Ranks of severities, of levels, and of verdicts on a change; the lower, the earlier.
SEVERITY = ("error", "warning", "info", "unchecked")
LEVEL = ("action", "info", "nothing")
SAFETY = ("unsafe", "unknown", "safe")


def place(value: Column, order: Sequence[str]) -> Column:
    """The place of a value in an order, from 0; values that it lacks come last."""
    found = F.array_position(F.array(*[F.lit(x) for x in order]), value)
    return F.when(found > 0, found - 1).otherwise(len(order)).cast("int")


def binary_key(text: Column) -> Column:
    """A key that sorts by the UTF-8 bytes of a text, whatever the session's collation."""
    return F.hex(F.encode(text, "UTF-8"))


def locale_key(text: Column) -> Column:
    """A key that sorts as people read: without case and marks first, marks then, small letters before capitals last."""
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.struct(plain.alias("letters"), F.lower(text).alias("marks"), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("case"))


def call_order(line: Column, column: Column, seq: Column) -> Column:
    """The order of calls in a body: by place in the file, those without one last, then as they were found."""
    return F.struct(F.coalesce(line, F.lit((1 << 31) - 1)).alias("line"), F.coalesce(column, F.lit((1 << 31) - 1)).alias("column"), seq.alias("seq"))


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by `order`; aggregated on both sides of the shuffle, so a hot key is no sort in one task."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*order, *[c for c in rest if c not in order])
    return df.groupBy(*keys).agg(F.min(row).alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """The first `most` rows of each key with their place (from 1); Spark cuts each partition's groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Every row with its place in its group, from 1."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def numbered_over_all(df: DataFrame, order: Sequence[Column], out: str = "place") -> DataFrame:
    """Every row with its place (long, from 1) in one order of all rows: sorted by ranges, each numbered from what lies before.

    Rows that the order holds equal may change places. No task sees more than its range; the ranges' counts are a row a task.
    """
    part = F.spark_partition_id()
    own = F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)
    held = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", part).withColumn("_at", own), "numbered")
    counts = held.groupBy("_part").agg(F.count("*").alias("n"))
    before = counts.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return held.join(sized(before, counts.count(), 16), "_part").withColumn(out, F.col("_at") + F.col("_before") + 1).select(*df.columns, out)


def top(df: DataFrame, order: Sequence[Column], most: int) -> DataFrame:
    """The first `most` rows of all: each task keeps a bounded queue, and the queues are merged."""
    return df.orderBy(*order).limit(most)


def cut_with_report(df: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int) -> tuple[DataFrame, DataFrame]:
    """(the first `most` of each key, and of each key that has more: how many there are and how many were left out)."""
    kept = first_of_each(df, keys, order, most)
    count = df.groupBy(*keys).agg(F.count("*").alias("found")).filter(F.col("found") > most)
    return kept, count.withColumn("left_out", F.col("found") - most)


def union_first_wins(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """All rows of the parts, and of rows with one key those of the first part that has it."""
    if not parts:
        raise ValueError("no parts")
    whole = parts[0].withColumn("_part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        whole = whole.unionByName(p.withColumn("_part", F.lit(i)))
    first = whole.groupBy(*keys).agg(F.min("_part").alias("_part"))
    return whole.join(first, [*keys, "_part"], "left_semi").drop("_part")
