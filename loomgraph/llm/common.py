"""Helpers the operators of this subpackage share: tables in the shared folder, sized joins and distributed ranks."""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables whose measured size is at most this many bytes may be broadcast; larger ones are joined by shuffling.
BROADCAST_BYTES = 24 << 20
#: Bytes of a batch that goes to a Python worker, at most (one row may have more).
ARROW_BYTES = 8 << 20
#: Keys that a join may broadcast for the number of their rows, at most.
HOT = 1 << 14
#: Names no input column has; operators put what they add for themselves under this prefix.
PRE = "_lg_"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a local one if all runs in one JVM."""
    importable(spark)
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"{tempfile.gettempdir()}/loomgraph-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it back: cuts lineage, is computed once, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/loomgraph/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Python workers look for this package where the driver has it (where executors have it elsewhere nothing changes), and get
    texts in batches of ARROW_BYTES at most, whatever the rows' lengths."""
    own = re.fullmatch(r"(\d+)b?", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"))
    if not own or int(own[1]) > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(df: DataFrame, rows: int, row_bytes: int, at_most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if `rows` (counted) times `row_bytes` is at most `at_most`; else df as it is."""
    return F.broadcast(df) if rows * row_bytes <= at_most else df


def join_counted(left: DataFrame, right: DataFrame, key: str, n: str, spread: Column, row_bytes: int, at_most: int = BROADCAST_BYTES, keep: bool = False) -> DataFrame:
    """Inner join (left join: keep) on the binary column `key`, which is unique in right (a written table); `n` of right counts the rows of each key.

    A small right is broadcast. Else the keys that have over 1 in HOT of all rows, so fewer than HOT of them, are broadcast; their
    rows of left are dealt by `spread` in the shuffle that joins the others, so that no task gets a hot key.
    """
    rows, total = right.agg(F.count("*"), F.sum(n)).first()
    if rows * row_bytes <= at_most:
        return left.join(F.broadcast(right), key, "left" if keep else "inner")
    hot = F.col(n) > max(1, (total or 0) // HOT)
    rest = [c for c in right.columns if c != key]
    first = right.filter(hot).select(F.col(key), F.struct(*rest).alias(f"{PRE}hot"))
    second = right.filter(~hot).select(F.col(key).alias(f"{PRE}cold_key"), F.struct(*rest).alias(f"{PRE}cold"))
    dealt = left.join(F.broadcast(first), key, "left").withColumn(f"{PRE}deal", F.when(F.col(f"{PRE}hot").isNull(), F.col(key)).otherwise(F.encode(F.xxhash64(spread).cast("string"), "utf-8")))
    both = dealt.join(second, F.col(f"{PRE}deal") == F.col(f"{PRE}cold_key"), "left").withColumn(f"{PRE}met", F.coalesce(f"{PRE}hot", f"{PRE}cold"))
    return (both if keep else both.filter(F.col(f"{PRE}met").isNotNull())).select(*left.columns, *[F.col(f"{PRE}met.{c}").alias(c) for c in rest])


def crc_of_id(name: str = "doc_id") -> Column:
    """crc32 of the id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


def buckets_for(rows: int, rows_each: int, at_most: int = 1 << 16) -> int:
    return max(1, min(at_most, math.ceil(rows / rows_each)))


def ranked(df: DataFrame, group: Sequence[str], key: Column, out: str, buckets: int) -> DataFrame:
    """Rank (long, from 0) of each row in its group, in the order of a hash `key` (long); gapless.

    A group is cut into `buckets` ranges of the key, so that a hot group is ranked by many tasks; the ranges' counts give
    each its offset. Rows with equal keys are ordered by all their columns but maps, so only rows that equal one another
    may change places.
    """
    from pyspark.sql import Window

    g, k, b = list(group), f"{PRE}key", f"{PRE}bucket"
    plain = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    if buckets == 1:
        w = Window.partitionBy(*g).orderBy(k, *plain)
        return df.withColumn(k, key).withColumn(out, F.row_number().over(w).cast("long") - 1).select(*df.columns, out)
    keyed = df.withColumn(k, key).withColumn(b, F.pmod(F.shiftright(F.col(k), 32), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy(*g, b).count()
    # at most `buckets` ranges a group, so this array is bounded
    arrays = counts.groupBy(*g).agg(F.sort_array(F.collect_list(F.struct(b, "count"))).alias("c"))
    offsets = arrays.select(*g, "c", F.posexplode("c").alias("p", "x")).select(
        *[F.col(x).alias(f"{PRE}g{i}") for i, x in enumerate(g)],
        F.col(f"x.{b}").alias(f"{PRE}gb"),
        F.expr("aggregate(slice(c, 1, p), 0L, (a, y) -> a + y.count)").alias(f"{PRE}before"),
    )
    offsets = materialise(offsets, "offsets")
    cond = F.col(b) == F.col(f"{PRE}gb")
    for i, x in enumerate(g):
        cond = cond & F.col(x).eqNullSafe(F.col(f"{PRE}g{i}"))
    w = Window.partitionBy(*g, b).orderBy(F.shiftright(F.col(k), 32), k, *plain)
    placed = keyed.withColumn(f"{PRE}rn", F.row_number().over(w))
    joined = placed.join(sized(offsets, offsets.count(), 64), cond, "left")
    return joined.withColumn(out, F.col(f"{PRE}before") + F.col(f"{PRE}rn") - 1).select(*df.columns, out)
