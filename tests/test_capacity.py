"""A stream with one endless trace under a bound: its pieces add up to what a batch says."""

import pandas as pd
from pyspark.sql import functions as F

from loomgraph.streaming import capacity as C
from loomgraph.streaming import traces as T

SPAN = "trace_id string, at timestamp, status int, error boolean"


def spans(spark, n, trace, start, step):
    return spark.range(n).select(trace.alias("trace_id"), F.timestamp_seconds(start + F.col("id") * step).alias("at"), F.when(F.col("id") % 7 == 0, 500).otherwise(200).alias("status"), F.lit(False).alias("error"))


def test_pieces_add_up(spark, tmp_path):
    path, start = str(tmp_path / "in"), 1_700_000_000
    for k in range(3):  # three batches: an endless trace goes on in all of them, short ones come in each
        spans(spark, 250, F.lit("endless"), start + 250 * k, 1).coalesce(1).write.mode("append").parquet(path)
        spans(spark, 60, F.concat(F.lit(f"t{k}."), F.col("id") % 20), start + 250 * k, 1).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([(None, None, 200, False)], SPAN).coalesce(1).write.mode("append").parquet(path)
    closing = spans(spark, 1, F.lit("~"), start + 10_000_000, 1)
    stream = spark.readStream.schema(SPAN).option("maxFilesPerTrigger", 100).parquet(path)
    want = {r.trace_id: (r.n, r.bad) for r in spark.read.parquet(path).filter("at is not null").groupBy("trace_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == 500).alias("bad")).collect()}
    closing.coalesce(1).write.mode("append").parquet(path)
    out = T.drain(C.bounded_traces(stream, 100, "30 seconds", "1 hour"), "pieces").collect()
    got = {}
    for r in out:
        n, bad = got.get(r.trace_id, (0, 0))
        got[r.trace_id] = (n + r.spans, bad + r.errors)
    assert got == want
    long = sorted((r.piece, r.spans, r.cut_short) for r in out if r.trace_id == "endless")
    assert long == [*[(k, 100, True) for k in range(7)], (7, 50, False)]
    assert not any(r.cut_short for r in out if r.trace_id != "endless")


def test_many_traces_are_few_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "BUCKETS", 3)
    path, start = str(tmp_path / "in"), 1_700_000_000
    for k in range(2):
        spans(spark, 5000, F.concat(F.lit("t"), F.col("id") % 1000), start + 20_000 * k, 1).repartition(2).write.mode("append").parquet(path)
    spans(spark, 1, F.lit("~"), start + 10_000_000, 1).coalesce(1).write.mode("append").parquet(path)
    told = []
    stream = spark.readStream.schema(SPAN).option("maxFilesPerTrigger", 100).parquet(path)
    q = C.bounded_traces(stream, 4, "30 seconds", "1 hour").writeStream.foreachBatch(lambda df, n: told.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    assert 0 < max(rows) <= 3
    per = pd.DataFrame([r.asDict() for r in told if r.trace_id != "~"]).groupby("trace_id").agg(spans=("spans", "sum"), pieces=("piece", "count"), cut=("cut_short", "sum"))
    assert len(per) == 1000 and set(map(tuple, per.to_numpy().tolist())) == {(10, 3, 2)}


def frame(*rows):
    return pd.DataFrame(rows, columns=["trace_id", "us", "bad"])


def test_pieces_go_on_from_what_is_held():
    none = pd.DataFrame({c: [] for c in C.HELD}).astype({c: "int64" for c in C.HELD[1:]})
    told, held = C._grown(none, frame(("b", 5000, True), ("a", 9000, False), ("a", 1000, True), ("a", 4000, False)), 2)
    assert told[list(C.COLUMNS)].to_numpy().tolist() == [["a", 0, 1000, 4000, 2, 1, True]]
    assert sorted(held[list(C.HELD)].to_numpy().tolist()) == [["a", 1, 9000, 9000, 1, 0, 9], ["b", 0, 5000, 5000, 1, 1, 5]]
    told, held = C._grown(held, frame(("a", 2000, True), ("c", 7000, False)), 2)  # earlier than what is held
    assert told[list(C.COLUMNS)].to_numpy().tolist() == [["a", 1, 2000, 9000, 2, 1, True]]
    assert sorted(held[["trace_id", "piece", "spans", "errors", "latest_ms"]].to_numpy().tolist()) == [["a", 2, 0, 0, 9], ["b", 0, 1, 1, 5], ["c", 0, 1, 0, 7]]
    told, held = C._grown(held, frame(("a", 3000, False)), 2)
    assert told.empty and [x for x in held[list(C.HELD)].to_numpy().tolist() if x[0] == "a"] == [["a", 2, 3000, 3000, 1, 0, 9]]
