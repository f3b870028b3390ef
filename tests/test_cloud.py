"""Cloud calls: names as written, the nearest marked span against a plain walk, and scopes on a small graph."""

import random

from pyspark.sql import functions as F

from loomgraph.operators import cloud as C

NAMES = [
    ("function", "arn:aws:lambda:eu:1:function:f", "f"), ("function", "arn:aws:lambda:eu:1:function:f:live", "f"), ("function", "arn:aws:lambda:eu:1:function:f:a:b", None),
    ("function", "1:function:f", "f"), ("function", "function:f:3", "f"), ("function", "f:3", "f"), ("function", "f", "f"), ("function", "", None), ("function", None, None),
    ("function", "arn:aws:sqs:eu:1:q", None), ("workflow", "arn:aws:states:eu:1:stateMachine:w:2", "w"), ("workflow", "arn:aws:states:eu:1:execution:w:run", "w"),
    ("workflow", "arn:aws:states:eu:1:express:w:run:x", "w"), ("workflow", "w:1", None), ("queue", "https://sqs.eu/1/q/", "q"), ("queue", "http://localhost:4566/0/q", "q"),
    ("queue", "https://sqs.eu/q", None), ("queue", "https://sqs.eu/1/q?x", None), ("queue", "arn:aws:sqs:eu:1:q", "q"), ("topic", "arn:aws:sns:eu:1:t", "t"),
    ("topic", "arn:aws:sns:eu:1:t:sub", None), ("bus", "arn:aws:events:eu:1:event-bus/a/b/c", "a/b/c"), ("table", "arn:aws:dynamodb:eu:1:table/t", "t"),
    ("table", "arn:aws:dynamodb:eu:1:table/t/stream/2024-01-01T00:00", "t"), ("table", "arn:aws:dynamodb:eu:1:table/t/index/i", None), ("stream", "arn:aws:kinesis:eu:1:stream/s", "s"),
    ("bucket", "arn:aws:s3:::b", "b"), ("bucket", "arn:aws:s3:::b/key", None), ("bucket", "arn:aws:s3:eu:1:b", None),
]


def test_names(spark):
    for kind in C.ARNS:
        own = [(t, n) for k, t, n in NAMES if k == kind]
        got = spark.createDataFrame(own, "t string, n string").select("n", C.deployed_name(kind, F.col("t")).alias("g"), "t").collect()
        assert [(r.t, r.g) for r in got if r.g != r.n] == []


def test_nearest(spark):
    rng = random.Random(7)
    rows = []
    for t in range(6):
        for i in range(60):  # long chains, rings, parents that are missing
            rows.append((f"t{t}", i, None if i == 0 or rng.random() < 0.05 else rng.choice([i - 1, i - 1, i - 1, rng.randrange(70)]), rng.random() < 0.15, rng.random() < 0.02))
    rows += rows[:5] + [(None, 1, 0, True, True), ("t0", None, 0, True, True)]
    got = {(r.trace_id, r.span_id): (r.x, r.y) for r in C.nearest(spark.createDataFrame(rows, "trace_id string, span_id long, parent_id long, a boolean, b boolean"), x=F.col("a"), y=F.col("b")).collect()}
    at = {(r[0], r[1]): r for r in rows if r[0] and r[1] is not None}
    for (t, i), r in at.items():
        for k in (0, 1):
            up, seen = r[2], set()
            while (t, up) in at and not at[t, up][3 + k] and up not in seen:
                seen.add(up)
                up = at[t, up][2]
            want = up if (t, up) in at and at[t, up][3 + k] else None
            assert (got.get((t, i)) or (None, None))[k] == want


SPANS = "trace_id string, span_id long, parent_id long, kind string, service string, faas string, workflow string, state string, api string, operation string, targets array<string>"
NODES = [
    ("e:f", "entry", "invoke", "f", "s"), ("e:g", "entry", "invoke", "g", "s"), ("e:w", "entry", "workflow", "w", "s"), ("c1", "method", None, "c1", "s"), ("c2", "method", None, "c2", "s"), ("c3", "method", None, "c3", "s"),
    ("T", "table", None, "Orders", "s"), ("U", "table", None, "users", "s"), ("U2", "table", None, "users", "s"), ("st", "function", "state", "w/put", "s"),
    ("q", "channel", None, "sqs/q", None), ("b1", "channel", None, "eventbridge/x/y/e", None), ("b2", "channel", None, "eventbridge/x/f", None), ("ch", "channel", None, "dynamodb/orders", None),
]
EDGES = [("e:f", "c1", "handles"), ("c1", "c2", "calls"), ("e:g", "c3", "handles"), ("c2", "T", "queries"), ("c3", "T", "queries"), ("c2", "q", "emits"), ("c3", "q", "emits"), ("c2", "b1", "emits"), ("c2", "ch", "emits"), ("c2", "e:g", "calls"), ("st", "c3", "calls"), ("st", "e:w", "calls")]


def placed(spark, rows, nodes=NODES, edges=EDGES):
    out = C.match_calls(spark.createDataFrame(rows, SPANS), spark.createDataFrame(nodes, "id string, type string, kind string, label string, service string"), spark.createDataFrame(edges, "from_id string, to_id string, type string"))
    return out, {(r.span_id, r.target): (r.outcome, r.node, r.site, r.join_outcome, r.join, r.within) for r in out.collect()}


def test_calls(spark):
    call = lambda i, up, api, op, t, faas=None: ("t", i, up, "client", "s", faas, None, None, api, op, t)
    rows = [
        ("t", 0, None, "server", "s", "f", None, None, None, None, None), ("t", 1, 0, "internal", "s", None, None, None, None, None, None),
        call(2, 1, "DynamoDB", "PutItem", ["orders", "users", "nope", "orders"]), call(3, 2, "DynamoDB", "PutItem", ["orders"]), call(4, 1, "SQS", "SendMessage", ["https://sqs.eu/1/q"]),
        call(5, 1, "EventBridge", "PutEvents", ["arn:aws:events:eu:1:event-bus/x"]), call(6, 1, "Lambda", "Invoke", ["g:live"]), call(7, 1, "SFN", "StartExecution", ["w"]), call(8, 1, "S3", "PutObject", ["b"]),
        call(9, 1, "SQS", "ReceiveMessage", ["q"]), call(10, 1, "Other", "X", None), call(11, 1, "SQS", "SendMessage", None), call(12, 99, "SQS", "SendMessage", ["q"]), call(13, 1, "EventBridge", "PutEvents", ["none"]),
        ("u", 20, None, "internal", "s", None, "w", "put", None, None, None), ("u", 21, 20, "client", "s", None, None, None, "DynamoDB", "GetItem", None), ("u", 22, 20, "client", "s", None, None, None, "SFN", "StartExecution", None),
        (None, 30, None, "client", "s", None, None, None, "SQS", "SendMessage", ["q"]),
    ]
    out, got = placed(spark, rows)
    assert got == {
        (2, "orders"): ("match", "T", "c2", "match", "c2 -emits-> ch", None), (2, "users"): ("ambiguous", None, None, None, None, None), (2, "nope"): ("not-found", None, None, None, None, None), (3, "orders"): ("match", "T", "c2", "match", "c2 -emits-> ch", 2),
        (4, "https://sqs.eu/1/q"): ("match", "q", None, "match", "c2 -emits-> q", None), (5, "arn:aws:events:eu:1:event-bus/x"): ("match", "b1", None, "match", "c2 -emits-> b1", None),
        (6, "g:live"): ("match", "e:g", "c2", "match", "c2 -calls-> e:g", None), (7, "w"): ("match", None, None, "no join", None, None), (8, "b"): ("not counted", None, None, None, None, None),
        (9, "q"): ("not counted", None, None, None, None, None), (10, None): ("unknown call", None, None, None, None, None), (11, None): ("unnamed", None, None, None, None, None),
        (12, "q"): ("match", "q", None, "ambiguous", None, None), (13, "none"): ("not-found", None, None, None, None, None),
        (21, None): ("match", "T", "c3", None, None, None), (22, None): ("match", "e:w", None, "match", "st -calls-> e:w", None),
    }
    counted = {(r.what, r.id): r["count"] for r in C.call_counts(out).collect()}
    assert counted["node", "T"] == 2 and counted["site", "c2"] == 2 and counted["join", "c2 -emits-> q"] == 1


def test_empty(spark):
    assert placed(spark, [])[1] == {} and placed(spark, [("t", 1, 1, "client", None, None, None, None, "SQS", "SendMessage", ["q"])], [], [])[1] == {(1, "q"): ("not-found", None, None, None, None, None)}


def test_chains_are_walked_in_few_rounds(spark, monkeypatch):
    from loomgraph.operators import traverse as T

    ways = [(f"a{i}", f"a{i + 1}") for i in range(100)] + [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)] + [("a100", "r4"), ("a100", "x"), ("x", "y"), ("x", "z"), ("y", "x"), ("lone", "z"), ("a7", None)]
    seeds = [("f", "a0"), ("f", "a0"), ("g", "a60"), ("g", "lone"), ("h", "r1"), ("h", None), ("i", "away")]
    written, own = [], T.materialise
    monkeypatch.setattr(T, "materialise", lambda df, name: (written.append(name), own(df, name))[1])
    got = sorted(tuple(r) for r in T.reach_all(spark.createDataFrame(ways, "from_id string, to_id string"), spark.createDataFrame(seeds, "scope string, id string"), "scope").collect())
    want = {s for s in seeds if s[1]}
    while more := {(s, b) for s, at in want for a, b in ways if a == at and b} - want:
        want |= more
    assert got == sorted(want) and len(written) < 50
