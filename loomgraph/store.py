"""Tables in the folder that driver and executors share, and the graph store: write, read, replace one service."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables whose counted rows times row bytes are at most this may be broadcast.
BROADCAST_BYTES = 24 << 20
#: Bytes of a batch that goes to a Python worker, at most (one row may have more).
ARROW_BYTES = 8 << 20
#: Options of Parquet for rows of up to megabytes: its writer counts the bytes it holds from the first row on, not after a hundred.
LONG_ROWS = {"parquet.page.size.row.check.min": "1"}
#: Rows of a long table that one task groups or sorts, about.
ROWS_A_TASK = 1 << 20


def importable(spark: SparkSession) -> None:
    """Python workers look for this package where the driver has it (where executors have it elsewhere nothing changes), and get
    rows in batches of ARROW_BYTES at most, however long the rows are."""
    own = re.fullmatch(r"(\d+)b?", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"))
    if not own or int(own[1]) > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a local folder is set, if all runs in one JVM, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"{tempfile.gettempdir()}/loomgraph-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/loomgraph/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, of so many counted rows, dealt by keys to as many tasks as it takes, so what a task holds doesn't grow with the table.

    For up to spark.shuffle.sort.bypassMergeThreshold tasks rows are written straight to files, for more they are held and sorted
    first: more are taken only where each would else get over twice ROWS_A_TASK.
    """
    if rows <= ROWS_A_TASK:
        return df
    conf, tasks = df.sparkSession.conf, -(-rows // ROWS_A_TASK)
    straight = int(conf.get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    if straight < tasks <= 2 * straight:
        tasks = straight
    return df.repartition(max(int(conf.get("spark.sql.shuffle.partitions")), tasks), *keys)


def write_store(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet under path, by service where it has one; a table is replaced as a whole when its job commits."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if "service" in df.columns:
            writer = writer.partitionBy("service")
        writer.parquet(f"{path}/{name}")


def replace_service(tables: dict[str, DataFrame], path: str, service: str) -> None:
    """Only the rows of one service are replaced: dynamic partition overwrite."""
    for name, df in tables.items():
        own = df.filter(F.col("service") == service)
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("service").parquet(f"{path}/{name}")


def open_store(spark: SparkSession, path: str, names: tuple[str, ...] = ("nodes", "edges", "types", "unresolved")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
