"""Traces of a stream under a bound: one that grows past it is handed on in pieces, so no trace, however long, holds more state.

What is kept of a trace is six numbers in the state store (RocksDB: on the executors' disks, checkpointed to the shared folder), not
its spans. A time-out in event time closes a trace when nothing came for a while. A group of the stream is a bucket of traces, and its
state comes to Python and goes back with its rows: a call to Python for each trace costs far more than the trace's spans do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.telemetry import failed
from ..store import importable

# Fixed value: how many spans of one trace are held.
MOST_SPANS = 10_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PIECE = "trace_id string, piece int, start_us long, end_us long, spans long, errors long, cut_short boolean"
COLUMNS = ("trace_id", "piece", "start_us", "end_us", "spans", "errors", "cut_short")
HELD = ("trace_id", "piece", "start_us", "end_us", "spans", "errors", "latest_ms")
SUMS = "trace_id array<string>, " + ", ".join(f"{c} array<long>" for c in HELD[1:])
#: The start of a piece that has no span yet; its end is this below zero.
NONE = np.iinfo(np.int64).max
#: Traces are dealt to so many buckets, each a group of the stream; of a query that goes on this may not change.
BUCKETS = 1024


def _grown(held: pd.DataFrame, frame: pd.DataFrame, most: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(pieces that are full, what is held of each trace after them) when a frame of spans comes to what is held."""
    frame = frame.sort_values(["trace_id", "us"], kind="stable")
    us, bad = frame["us"].to_numpy(np.int64), frame["bad"].to_numpy(np.int64)
    codes, names = pd.factorize(frame["trace_id"])
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    before = held.set_index("trace_id")[["spans", "piece"]].reindex(names, fill_value=0).to_numpy(np.int64)
    place = np.arange(len(us)) - first[codes] + before[codes, 0]
    piece = before[codes, 1] + place // most
    new = pd.DataFrame({"trace_id": names[codes], "piece": piece, "start_us": us, "end_us": us, "spans": 1, "errors": bad, "latest_ms": us // 1000})
    sums = pd.concat([held, new]).groupby(["trace_id", "piece"], as_index=False).agg({"start_us": "min", "end_us": "max", "spans": "sum", "errors": "sum", "latest_ms": "max"})
    sums["latest_ms"] = sums.groupby("trace_id")["latest_ms"].transform("max")
    full = sums["spans"] == most
    last = sums.drop_duplicates("trace_id", keep="last")
    rest = last[last["spans"] < most]
    begun = last[last["spans"] == most].assign(piece=lambda x: x["piece"] + 1, start_us=NONE, end_us=-NONE, spans=0, errors=0)
    return sums[full].assign(cut_short=True), pd.concat([rest, begun])


def _pieces(frames: Iterator[pd.DataFrame], state: GroupState, most: int, wait: int) -> Iterator[pd.DataFrame]:
    """The traces of a bucket: of each the sums of the spans since its last piece, and when the last of all came. A trace is over
    `wait` ms after that."""
    held = pd.DataFrame(dict(zip(HELD, state.get if state.exists else [[]] * len(HELD)))).astype({c: np.int64 for c in HELD[1:]})
    if not state.hasTimedOut:
        for frame in frames:
            told, held = _grown(held, frame, most)
            if len(told):
                yield told[list(COLUMNS)]
    over = held["latest_ms"] + wait < state.getCurrentWatermarkMs()
    ended = held[over & (held["spans"] > 0)].assign(cut_short=False)
    if len(ended):
        yield ended[list(COLUMNS)]
    held = held[~over]
    if len(held):
        state.update(tuple(held[c].tolist() for c in HELD))
        state.setTimeoutTimestamp(int(held["latest_ms"].min()) + wait)
    elif state.exists:
        state.remove()


def bounded_traces(spans: DataFrame, most: int = MOST_SPANS, wait: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """(trace_id, piece, start, end, spans, errors, cut_short) of a stream of spans (trace_id, at, status, error).

    A piece is cut short when it has `most` spans; the rest of a trace comes when nothing was added for `wait` of event time. The
    pieces of a trace add up to all its spans. Spans later than `late` are dropped by Spark; null ids are one trace; null times
    aren't taken. The session's state store has to be RocksDB, which is set here where nothing else is said.
    """
    spark = spans.sparkSession
    importable(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    millis = int(pd.Timedelta(wait).total_seconds() * 1000)
    own = spans.filter("at is not null").select(F.coalesce("trace_id", F.lit("")).alias("trace_id"), "at", F.unix_micros("at").alias("us"), failed().alias("bad"))

    def pieces(key, frames, state):
        yield from _pieces(frames, state, most, millis)

    dealt = own.withColumn("bucket", F.pmod(F.xxhash64("trace_id"), BUCKETS)).withWatermark("at", late).groupBy("bucket")
    out = dealt.applyInPandasWithState(pieces, PIECE, SUMS, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("trace_id", "piece", F.timestamp_micros("start_us").alias("start"), F.timestamp_micros("end_us").alias("end"), "spans", "errors", "cut_short")
