"""Which of many starts reach which nodes, as bitmaps: state per node and 32,768 starts, not a row for each pair of them.

Starts are numbered; a number is a bucket and a bit of a bitmap. A level joins the bitmaps that grew last with the edges and ors what
meets in a node with what it has; by its count Spark sees whether it grew. Python only unfolds bitmaps and adds them up, a few MB of
them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..store import importable, materialise
from . import orders as O

#: Rows that bitmaps are unfolded to before they are handed on (one bitmap has up to 32,768 more).
UNFOLDED_ROWS = 1 << 15


def numbered_starts(starts: DataFrame) -> DataFrame:
    """(id, number): different starts (id) with numbers from 1, in order of ids."""
    return materialise(O.numbered_over_all(starts.select("id").filter("id is not null").distinct(), [F.col("id")], "number"), "starts")


def reach_bits(edges: DataFrame, numbers: DataFrame, depth: int = 16) -> DataFrame:
    """(id, bucket, bits): the starts (id, number) that reach each node of edges (from_id, to_id) within `depth` steps, themselves too.

    bits is a bitmap of bucket's numbers as bitmap_construct_agg makes it. Ends when no node gets a new bit.
    """
    step = materialise(edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).filter("a is not null and b is not null").distinct(), "bit-steps")
    n = F.col("number")
    first = numbers.select("id", F.bitmap_bucket_number(n).alias("bucket"), F.bitmap_bit_position(n).alias("bit"))
    seen = materialise(first.groupBy("id", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), "bits")
    front = seen
    for _ in range(depth):
        came = front.withColumnRenamed("id", "a").join(step, "a").select(F.col("b").alias("id"), "bucket", "bits", F.lit(0).cast("long").alias("had"))
        own = seen.withColumn("had", F.bitmap_count("bits")).unionByName(came).groupBy("id", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.max("had").alias("had"))
        met = materialise(own.select("id", "bucket", "bits", (F.bitmap_count("bits") > F.col("had")).alias("grew")), "bits")
        seen, front = met.drop("grew"), met.filter("grew").drop("grew")
        if front.isEmpty():
            break
    return seen


def unfolded(bits: DataFrame, keys: list[str], numbers: DataFrame) -> DataFrame:
    """(keys, start): a row for each start of each bitmap; numbers (id, number) names them."""
    importable(bits.sparkSession)
    own = bits.select(*keys, "bucket", "bits")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, number = [], []
            buckets, maps, left = batch.column("bucket"), batch.column("bits"), 0
            for i in range(batch.num_rows):
                found = np.flatnonzero(np.unpackbits(np.frombuffer(maps[i].as_buffer(), np.uint8), bitorder="little"))
                number.append(found + ((buckets[i].as_py() - 1) * 32768 + 1))
                at.append(np.full(len(found), i))
                left += len(found)
                if left >= UNFOLDED_ROWS or i == batch.num_rows - 1:
                    own = batch.select(keys).take(pa.array(np.concatenate(at)))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.concatenate(number))], names=[*keys, "number"])
                    at, number, left = [], [], 0

    each = own.mapInArrow(rows, StructType([*own.select(*keys).schema.fields, StructField("number", LongType())]))
    return each.join(numbers.withColumnRenamed("id", "start"), "number").select(*keys, "start")


def ways_in(edges: DataFrame, starts: DataFrame, depth: int = 16) -> DataFrame:
    """(id, ways): by how many of the starts (id) each node is reached."""
    bits = reach_bits(edges, numbered_starts(starts), depth)
    return bits.groupBy("id").agg(F.sum(F.bitmap_count("bits")).alias("ways"))


def counts_reached(edges: DataFrame, starts: DataFrame, marked: DataFrame, depth: int = 16) -> DataFrame:
    """(id, reaches): starts (id) that reach any of marked (id), and how many of them.

    The marked nodes' bitmaps are added bit by bit within each task, a bucket at a time, so what is shuffled is a row for each
    start that a task has met, not for each pair of a start and a node.
    """
    numbers = numbered_starts(starts)
    own = reach_bits(edges, numbers, depth).join(marked.select("id").distinct(), "id", "left_semi").select("bucket", "bits").sortWithinPartitions("bucket")

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, total = None, None
        for f in frames:
            for k, bits in zip(f["bucket"], f["bits"], strict=True):
                if k != bucket:
                    if total is not None:
                        yield _told(bucket, total)
                    bucket, total = k, np.zeros(1 << 15, np.int64)
                total += np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
        if total is not None:
            yield _told(bucket, total)

    counted = own.mapInPandas(sums, "number long, n long").groupBy("number").agg(F.sum("n").alias("reaches"))
    return counted.join(numbers, "number").select("id", "reaches")


def _told(bucket: int, total: np.ndarray) -> pd.DataFrame:
    at = np.flatnonzero(total)
    return pd.DataFrame({"number": (bucket - 1) * 32768 + at + 1, "n": total[at]})


def writes_reached(edges: DataFrame, entries: DataFrame, writes: DataFrame, depth: int = 8) -> DataFrame:
    """(entry, table): tables that an entry comes to write. edges (from_id, to_id) are calls; writes (id, table) are made by nodes.

    The bits of all nodes that write one table are one bitmap before any is unfolded, so a table that a million methods write is
    a row for each of its entries, once.
    """
    numbers = numbered_starts(entries)
    bits = reach_bits(edges, numbers, depth).join(writes.select("id", "table").distinct(), "id")
    by = bits.groupBy("table", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return unfolded(by, ["table"], numbers).select(F.col("start").alias("entry"), "table")
