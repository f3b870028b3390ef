"""Flow trees, sequences and bitmaps against plain walks on random graphs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import bitmaps as B
from loomgraph.operators import flows as W
from loomgraph.operators import traverse as T

TYPES = ("calls", "handles", "queries", "emits", "consumes", "http_calls", "reads_config")
KINDS = ("method", "table", "channel", "entry", "db_query", "external_api")


def graph(rng, n, m):
    nodes = [(f"n{i}", rng.choice(KINDS), f"l{i}", rng.choice(["s1", "s2", None])) for i in range(n)]
    edges = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n + 1)}", rng.choice(TYPES)): rng.choice([None, 1, 2, 3]) for _ in range(m)}
    return nodes, [(*k, v) for k, v in edges.items()]


def frames(spark, nodes, edges):
    return spark.createDataFrame(edges, "from_id string, to_id string, type string, order long"), spark.createDataFrame(nodes, "id string, type string, label string, service string")


def plain_rows(nodes, edges, entry, depth, most=None):
    """[(path ids and types, note)] in reading order, walking breadth first."""
    at = {i: (t, lab, s) for i, t, lab, s in nodes}
    out = defaultdict(list)
    for a, b, t, o in edges:
        x, y = at.get(a), at.get(b)
        cross = t in W.CROSSING or bool(x and y and x[2] and y[2] and x[2] != y[2])
        out[a].append(((not cross, o is not None, o or 0, (1 << 31) - 1, t, b), b))
    rows, seen, front, done = {(): (entry, "")}, {entry}, [((), entry, (entry,))], 1
    for level in range(1, depth + 1):
        if most and done >= most:
            break
        new, made = [], []
        for path, a, way in sorted(front):
            made += [((*path, k), b, way) for k, b in out[a]]
        for path, b, way in sorted(made):
            note = "cycle" if b in way else "again" if b in seen else ""
            if not note:
                seen.add(b)
                new.append((path, b, (*way, b)))
            rows[path] = (b, note)
        done += len(made)
        front = new
    for path, a, _ in front:
        if out[a]:
            rows[path] = (a, "cut")
    if most and len(rows) > most:
        order = sorted(rows, key=lambda p: (len(p), [k[0] for k in p], p))
        for p in order[most:]:
            if p[:-1] in rows and rows[p[:-1]][1] == "":
                rows[p[:-1]] = (rows[p[:-1]][0], "cut")
        rows = {p: rows[p] for p in order[:most]}
    return [(p, *rows[p]) for p in sorted(rows)]


@pytest.mark.parametrize("most", [None, 25])
def test_flow_rows_equal_a_walk(spark, most):
    rng = random.Random(4)
    nodes, edges = graph(rng, 40, 110)
    e, n = frames(spark, nodes, edges)
    entries = ["n0", "n5", "n7", "n20"]
    got = W.flow_rows(e, n, n.filter(F.col("id").isin(*entries)), 6, most).collect()
    for entry in entries:
        mine = sorted((tuple(tuple(k) for k in r.path), r.id, r.note) for r in got if r.entry == entry)
        assert mine == plain_rows(nodes, edges, entry, 6, most)


def test_no_tree_is_lost(spark):
    """An entry with 100 children in its own service, each with 10 calls into another one."""
    edges = [("e", f"c{i:03}", "calls", i) for i in range(100)] + [(f"c{i:03}", f"x{i:03}.{j}", "http_calls", j) for i in range(100) for j in range(10)]
    nodes = [("e", "entry", "E", "s1")] + [(f"c{i:03}", "method", f"c{i}", "s1") for i in range(100)] + [(f"x{i:03}.{j}", "method", "x", "s2") for i in range(100) for j in range(10)]
    e, n = frames(spark, nodes, edges)
    rows = W.flow_rows(e, n, n.filter("id = 'e'"), 8, 150).collect()
    assert len(rows) == 150 and sum(r.level == 1 for r in rows) == 100
    assert sum(r.note == "cut" for r in rows) == 96  # four children have all ten, one nine of them
    assert W.flow_rows(e, n, n.filter("id = 'e'"), 8).count() == 1101
    assert len(T.flow_tree(e, n, "e")) == 150


def test_sequences(spark):
    nodes = [("e", "entry", "GET /a", "shop"), ("h", "method", "Ctl.a", "shop"), ("q", "db_query", "write orders", "shop"), ("t", "table", "orders", "shop"), ("p", "producer", "message x", "shop"), ("c", "channel", "x", None), ("k", "consumer", "onX", "mail"), ("m", "method", "Mail.send", "mail"), ("o", "external_api", "post.example", None)]
    edges = [("e", "h", "handles", 1), ("h", "q", "calls", 1), ("q", "t", "queries", None), ("h", "p", "calls", 2), ("p", "c", "emits", None), ("c", "k", "consumes", None), ("k", "m", "calls", None), ("m", "o", "http_calls", 1), ("m", "gone", "calls", 2), ("m", "h", "calls", 3)]
    e, n = frames(spark, nodes, edges)
    got = [tuple(r)[1:] for r in W.sequences(W.flow_rows(e, n, n.filter("type = 'entry'"))).orderBy("place").collect()]
    assert got == [
        (0, "enters", "caller", "shop", "GET /a"), (1, "queries", "shop", "table:shop/orders", "write orders"), (2, "emits", "shop", "channel:x", "x"), (3, "consumes", "channel:x", "mail", "x"),
        (4, "http_calls", "mail", "external:post.example", "post.example"), (5, "calls", "mail", "shop", "Ctl.a"), (6, "stop", "mail", "mail", "not in the graph"),
    ]


def test_changed_flows(spark):
    nodes = [(f"e{i}", "entry", f"E{i}", "a") for i in range(4)] + [(f"m{i}", "method", f"M{i}", "b" if i % 2 else "c") for i in range(6)]
    base = [("e0", "m0", "calls", 1), ("m0", "m1", "calls", 1), ("e1", "m2", "calls", 1), ("m2", "m3", "calls", 1), ("e2", "m4", "calls", 1)]
    head = [("e0", "m0", "calls", 1), ("m0", "m1", "calls", 1), ("m0", "m5", "calls", 2), ("e1", "m2", "calls", 1), ("m2", "m3", "calls", 1), ("e3", "m4", "calls", 1)]
    a, b = frames(spark, nodes[:-1], base), frames(spark, nodes, head)
    got = sorted(map(tuple, W.changed_flows((a[1], a[0]), (b[1], b[0])).collect()))
    assert got == [("e0", 2, "both", 3, 1, 0), ("e2", 1, "both", 1, 0, 1), ("e3", 1, "both", 1, 1, 0)]


def test_bitmaps_equal_reach(spark):
    rng = random.Random(9)
    nodes, edges = graph(rng, 60, 120)
    e, n = frames(spark, nodes, edges)
    starts = n.filter("id like '%1' or id like '%5'")
    for depth in (1, 3, 16):
        want = sorted((r.id, r.by_) for r in T.reach(e.withColumn("confidence", F.lit("static")), starts.select("id", F.col("id").alias("by_")), "out", None, depth, by="by_").collect())
        numbers = B.numbered_starts(starts)
        assert sorted((r.id, r.start) for r in B.unfolded(B.reach_bits(e, numbers, depth), ["id"], numbers).collect()) == want
    many = spark.range(70000).select(F.concat(F.lit("s"), "id").alias("id"))
    star = many.select(F.col("id").alias("from_id"), F.lit("hub").alias("to_id")).unionByName(spark.createDataFrame([("hub", "end")], "from_id string, to_id string"))
    assert {r.id: r.ways for r in B.ways_in(star, many).filter("id in ('hub', 'end', 's3')").collect()} == {"hub": 70000, "end": 70000, "s3": 1}
    assert B.ways_in(star, many.limit(0)).count() == 0


def test_writes_reached(spark):
    e, _ = frames(spark, [], [("a", "m", "calls", None), ("m", "w", "calls", None), ("b", "w", "calls", None), ("c", "x", "calls", None)])
    entries = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "id string")
    writes = spark.createDataFrame([("w", "t1"), ("m", "t1"), ("w", "t2"), ("w", "t2"), ("z", "t3")], "id string, table string")
    assert sorted(map(tuple, B.writes_reached(e, entries, writes).collect())) == [("a", "t1"), ("a", "t2"), ("b", "t1"), ("b", "t2")]
    assert sorted(map(tuple, B.writes_reached(e, entries, writes, 1).collect())) == [("a", "t1"), ("b", "t1"), ("b", "t2")]
