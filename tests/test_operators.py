"""Operators on graphs and rows small enough to work out by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomgraph import store
from loomgraph.functions import scalars as S
from loomgraph.operators import diff as D
from loomgraph.operators import linking as L
from loomgraph.operators import telemetry as M
from loomgraph.operators import traverse as T

EDGE = "from_id string, to_id string, type string, confidence string"


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, *(rest or ("calls", "static"))) for a, b, *rest in rows], EDGE)


def seed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_depth_bound_and_reverse(spark):
    e = edges(spark, ("a", "b"), ("b", "c"))
    assert {r[0] for r in T.reach(e, seed(spark, "a"), "out", None, 1).collect()} == {"a", "b"}
    assert {r[0]: r[1] for r in T.reach(e, seed(spark, "c"), "in", None, 9).collect()} == {"c": 0, "b": 1, "a": 2}


def test_cycle_and_diamond(spark):
    ring = edges(spark, ("a", "b"), ("b", "a"))
    assert sorted(r[0] for r in T.simple_paths(ring, seed(spark, "a"), depth=10).collect()) == ["a", "b"]
    diamond = edges(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"))
    rows = T.simple_paths(diamond, seed(spark, "a"), depth=4)
    assert rows.filter("id = 'd'").count() == 2
    assert [r.path for r in T.first_per_id(rows).filter("id = 'd'").collect()] == ["a>b>d"]


def test_ids_inside_ids_and_types(spark):
    e = edges(spark, ("refresh", "refreshToken"), ("refreshToken", "x", "hits", "static"))
    assert T.simple_paths(e, seed(spark, "refresh"), depth=4).count() == 3
    assert T.simple_paths(e, seed(spark, "refresh"), types=["calls"], depth=4).count() == 2


def test_truncation(spark):
    e = edges(spark, *[("a", f"b{i}") for i in range(5)])
    nodes = seed(spark, "a", *[f"b{i}" for i in range(5)])
    rows, cut = T.traverse(nodes, T.simple_paths(e, seed(spark, "a")), 3)
    assert cut and rows.count() == 3
    assert not T.traverse(nodes, T.simple_paths(e, seed(spark, "a")), 6)[1]


def test_blast_radius_takes_the_best_weakest_step(spark):
    e = edges(spark, ("x", "t", "calls", "heuristic"), ("x", "m", "calls", "static"), ("m", "t", "calls", "declared"))
    got = {r.id: (r.depth, r.confidence) for r in T.blast_radius(e, seed(spark, "t")).collect()}
    assert got["x"] == (1, "declared") and got["m"] == (1, "declared")


@pytest.mark.parametrize("number", range(3))
def test_strong_components_by_closure(spark, number):
    rng = random.Random(number)
    pairs = {(rng.randrange(12), rng.randrange(12)) for _ in range(20)}
    reach = {a: {a} for a in range(12)}
    for _ in range(12):
        for a, b in pairs:
            for x in reach.values():
                if a in x:
                    x.add(b)
    want = {}
    for a in range(12):
        own = {b for b in reach[a] if a in reach[b]}
        if len(own) > 1:
            want[f"n{a:02}"] = f"n{min(own):02}"
    e = edges(spark, *[(f"n{a:02}", f"n{b:02}") for a, b in pairs])
    assert {r.id: r.component for r in T.strong_components(e).collect()} == want


def test_channel_collapse(spark):
    e = edges(spark, ("p", "ch", "emits", "static"), ("ch", "c", "consumes", "heuristic"))
    assert [tuple(r) for r in T.collapse_channels(e).collect()] == [("p", "c", "ch", "heuristic")]


def routes(spark, *rows):
    return spark.createDataFrame([(i, m, p, a) for i, (m, p, a) in enumerate(rows)], "route_id long, method string, path string, app string")


def calls(spark, *rows):
    return spark.createDataFrame([(i, m, p, a) for i, (m, p, a) in enumerate(rows)], "call_id long, method string, path string, app string")


def test_route_match(spark):
    r = routes(spark, ("GET", "/o/:param", "a"), ("GET", "/o/list", "a"), ("ALL", "/files/*", "a"), ("GET", "/x/:param", "a"), ("GET", "/x/:param", "b"), ("GET", "/v/foo-:param", "a"), ("GET", "/f/*/end", "a"))
    c = calls(spark, ("get", "/O/LIST", "z"), ("GET", "/o/7", "z"), ("POST", "/files/a/b", "z"), ("GET", "/x/1", "b"), ("GET", "/x/1", "z"), ("GET", "/v/foo-1", "z"), ("GET", "/v/bar", "z"), ("GET", "/f/a/other", "z"), ("GET", "/files", "z"))
    got = {x.call_id: (x.outcome, x.route_id) for x in L.match_routes(c, r).collect()}
    assert got == {0: ("match", 1), 1: ("match", 0), 2: ("match", 2), 3: ("match", 4), 4: ("ambiguous", None), 5: ("match", 5), 6: ("not-found", None), 7: ("not-found", None), 8: ("not-found", None)}


def test_patterns_reach_a_fixpoint(spark):
    names = spark.createDataFrame([("a.b",)], "name string")
    f = spark.createDataFrame([("x", "a.*", "c.d"), ("y", "c.>", "a.b"), ("z", "c", None)], "consumer string, pattern string, forward string")
    assert {tuple(r) for r in L.join_patterns(names, f).collect()} == {("a.b", "x"), ("c.d", "y")}


def test_log_histogram(spark):
    rows = [(float(x),) for x in (0, 0.005, 1, 1, 2, 100, 100, 3000)] + [(None,), (float("nan"),), (-1.0,)]
    s = spark.createDataFrame(rows, "duration_ms double").withColumn("k", F.lit(1))
    h = M.histogram(s, ["k"])
    assert h.agg(F.sum("n")).first()[0] == 8
    assert h.filter("bucket = 8").first().n == 1
    q = M.quantiles(h, ["k"], (0.5, 0.95)).first()
    assert q.p50 == 1.04 and abs(q.p95 / 3000 - 1) < 0.1


def test_merge_law_and_errors(spark):
    s = spark.createDataFrame([(i, "t", i % 3, 200 + 300 * (i % 2), float(i), i % 5 == 0) for i in range(40)], "span_id long, trace_id string, k int, status int, duration_ms double, error boolean").withColumn("at", F.timestamp_seconds("span_id").cast("timestamp_ntz"))
    parts = M.partials(s.filter("span_id < 11"), ["k"]).unionByName(M.partials(s.filter("span_id >= 11"), ["k"]))
    assert sorted(map(tuple, M.merge(parts, ["k"]).collect())) == sorted(map(tuple, M.partials(s, ["k"]).collect()))


def test_fields(spark):
    kind = "id string, fields array<struct<name:string,type:string,optional:boolean>>"
    sent = D.flatten_types(spark.createDataFrame([("t", [("a", "Date", False), ("in", "type:x", False), ("more", "string", False)]), ("type:x", [("n", "number", True), ("up", "type:x", False)])], kind)).filter("id = 't'")
    assert {r.path for r in sent.collect()} >= {"a", "in", "in.n", "more"}
    wanted = spark.createDataFrame([("t", "a", "string", False), ("t", "in", "type:x", False), ("t", "in.n", "number", False), ("t", "gone", "any", False), ("t", "in.up", "type:x", False)], "id string, path string, type string, optional boolean")
    got = {(r.path, r.kind, r.severity) for r in D.compare_fields(D.wire_view(sent), wanted, ["id"]).collect()}
    assert {("in.n", "optionality_mismatch", "warning"), ("gone", "missing_required", "error"), ("more", "extra_field", "info")} <= got
    assert not any(p == "a" for p, *_ in got)


def test_row_diff(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, None, 1), (3, "z", 1), (4, "q", 1)], "id long, v string, line int")
    b = spark.createDataFrame([(1, "x", 2), (2, None, 1), (3, None, 1), (5, "n", 1)], "id long, v string, line int")
    assert {tuple(r) for r in D.diff_rows(a, b, ["id"], ["v"], ["line"]).collect()} == {(1, "moved"), (3, "changed"), (4, "removed"), (5, "added")}


def test_sequence_steps():
    assert D.sequence_steps("abc", "axc") == [("same", "a"), ("removed", "b"), ("added", "x"), ("same", "c")]
    assert D.sequence_steps("", "a") == [("added", "a")]


def test_paths(spark):
    rows = [("/a//:id/{b}/<c>/",), ("/x",), ("/",)]
    got = [r[0] for r in spark.createDataFrame(rows, "p string").select(S.normalise_path(F.col("p"))).collect()]
    assert got == ["/a/:param/:param/:param", "/x", "/"]


def test_store_replaces_one_service(spark, tmp_path):
    df = spark.createDataFrame([("a", "s1"), ("b", "s2")], "id string, service string")
    store.write_store({"nodes": df}, str(tmp_path))
    store.replace_service({"nodes": spark.createDataFrame([("c", "s1")], "id string, service string")}, str(tmp_path), "s1")
    got = store.open_store(spark, str(tmp_path), ("nodes",))["nodes"]
    assert {tuple(r) for r in got.select("id", "service").collect()} == {("c", "s1"), ("b", "s2")}


def test_trace_readers(spark, tmp_path):
    from loomgraph.sources import traces as R

    otlp = {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "shop"}}]}, "scopeSpans": [{"spans": [{"traceId": "t", "spanId": "s", "parentSpanId": "", "kind": 2, "startTimeUnixNano": "1700000000000000000", "endTimeUnixNano": "1700000000250000000", "attributes": [{"key": "http.method", "value": {"stringValue": "GET"}}, {"key": "http.target", "value": {"stringValue": "/o/17?x=1"}}, {"key": "http.status_code", "value": {"intValue": "503"}}], "status": {"code": 2}}]}]}]}
    zipkin = [{"traceId": "t", "id": "z", "kind": "CLIENT", "timestamp": 1700000000000000, "duration": 1500, "localEndpoint": {"serviceName": "web"}, "tags": {"http.path": "/a", "http.status_code": "200"}}]
    jaeger = {"data": [{"traceID": "t", "spans": [{"traceID": "t", "spanID": "j", "processID": "p1", "startTime": 1700000000000000, "duration": 2000, "references": [{"refType": "CHILD_OF", "spanID": "z"}], "tags": [{"key": "error", "type": "bool", "value": "true"}]}], "processes": {"p1": {"serviceName": "db"}}}]}
    har = {"log": {"entries": [{"startedDateTime": "2024-01-01T00:00:00.000Z", "time": 12.5, "request": {"method": "post", "url": "https://h.example/o/9?q=1", "headers": []}, "response": {"status": 404}}]}}
    files = {"o.json": json.dumps(otlp), "z.json": json.dumps(zipkin), "j.json": json.dumps(jaeger), "h.har": json.dumps(har), "r.log": "x\nREPORT RequestId: abc Duration: 12.30 ms Billed\n", "a.log": json.dumps({"requestId": "q", "httpMethod": "get", "path": "/p/5", "status": "502", "requestTimeEpoch": "1700000000000"}) + "\n", "u.txt": "nothing"}
    for n, t in files.items():
        (tmp_path / n).write_text(t)
    got = {r.span_id: r for r in R.read_traces(spark, [str(tmp_path / n) for n in files]).collect()}
    assert len(got) == 6
    o = got["s"]
    assert (o.service, o.kind, o.method, o.path, o.status, o.duration_ms, o.error, o.parent_id) == ("shop", "server", "GET", "/o/:value", 503, 250.0, True, None)
    assert got["z"].kind == "client" and got["z"].duration_ms == 1.5
    assert got["j"].service == "db" and got["j"].parent_id == "z" and got["j"].error
    assert got["abc"].duration_ms == 12.3
    assert got["q"].status == 502 and got["q"].error
    assert any(r.method == "POST" and r.path == "/o/:value" and r.status == 404 for r in got.values())


def test_flow_tree(spark):
    e = edges(spark, ("a", "b"), ("b", "a"), ("a", "c"), ("c", "d"), ("b", "d"), ("d", "e"))
    nodes = spark.createDataFrame([(x, "s2" if x == "c" else "s1") for x in "abcde"], "id string, service string")
    got = T.flow_tree(e, nodes, "a")
    assert [(r[0], r[1], r[3]) for r in got] == [(0, "a", ""), (1, "c", ""), (2, "d", ""), (3, "e", ""), (1, "b", ""), (2, "a", "cycle"), (2, "d", "again")]
    assert len(T.flow_tree(e, nodes, "a", most=3)) == 3


def test_graph_documents(spark, tmp_path):
    from loomgraph.sources import graphs as G

    doc = {
        "nodes": [{"id": "a", "type": "entry", "label": "A", "service": "s"}, {"id": "b", "type": "method", "label": "B"}],
        "edges": [{"from": "a", "to": "b", "type": "calls"}, {"from": "a", "to": "b", "type": "calls", "confidence": "heuristic"}],
        "types": {"type:x": {"name": "X", "kind": "interface", "fields": [{"name": "f", "type": "string", "optional": False}]}},
        "unresolved": [{"file": "f.ts", "line": 3, "reason": "dynamic"}],
    }
    (tmp_path / "g.json").write_text(json.dumps(doc, indent=1))
    got = G.read_graph(spark, str(tmp_path / "g.json"))
    assert {k: v.count() for k, v in got.items()} == {"nodes": 2, "edges": 1, "types": 1, "unresolved": 1}
    u = got["unresolved"].first()
    assert (u.level, u.sites, u.kind) == ("action", 1, "gap")
    (tmp_path / "bad.json").write_text(json.dumps({"nodes": [{"label": "x"}]}))
    with pytest.raises(Exception, match="without id"):
        G.read_graph(spark, str(tmp_path / "bad.json"))["nodes"].collect()


def test_old_traffic_is_upgraded(spark):
    from loomgraph.sources import graphs as G

    one = spark.createDataFrame([("join", "x", 5)], "family string, id string, count long").withColumn("last_seen", F.lit("2024-01-01 10:20:00").cast("timestamp"))
    r = G.upgrade_observed(one).first()
    assert (r.hour.hour, r.errors, r.hist, r.format) == (10, 0, {}, 3)


def test_shortest_cycles_of_any_length(spark, monkeypatch):
    from loomgraph.plans import catalog
    from loomgraph.sources import views as V

    ring = [(f"n{i}", f"n{(i + 1) % 9}") for i in range(9)]
    e = edges(spark, *ring, ("n2", "m"), ("m", "n4"), ("m", "x"), ("x", "y"), ("y", "x"), ("z", "z"), ("z", "n0"))
    monkeypatch.setattr(V, "trade_edges", lambda s, d: e)
    got = {r.id: (r.length, r.path) for r in catalog.queries()["gra_02_representative_cycle"](spark, "").collect()}
    way = lambda i, third: ">".join(third if k % 9 == 3 else f"n{k % 9}" for k in range(i, i + 10))
    assert got == {**{f"n{i}": (9, way(i, "n3" if i == 3 else "m")) for i in range(9)}, "m": (9, way(3, "m")), "x": (2, "x>y>x"), "y": (2, "y>x>y"), "z": (1, "z>z")}


def test_rules_reach_to_the_end(spark):
    from loomgraph.operators import rules as R

    e = edges(spark, *[(f"n{i}", f"n{i + 1}") for i in range(19)])
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(20)], "id string")
    rules = (R.Rule("may not", "reachable", {"id": "n0"}, {"id": "n19"}), R.Rule("must", "reachable", {"id": "n0"}, {"id": "n19"}, must=True))
    assert [tuple(r) for r in R.evaluate(nodes, e, rules).collect()] == [("may not", "error", "n0", "n19")]


def test_spread_takes_few_rounds(spark, monkeypatch):
    """The least label reaches the end of a chain of 300 ids, and every id has the least of all before it on one of shuffled ids."""
    rounds = []
    write = T.materialise
    monkeypatch.setattr(T, "materialise", lambda df, name: rounds.append(name) or write(df, name))
    for ids in (list(range(300)), random.Random(3).sample(range(300), 300)):
        rounds.clear()
        chain = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
        got = {r.id: r.c for r in T._spread(chain, spark.createDataFrame([(i, i) for i in ids], "id long, c long")).collect()}
        assert got == {x: min(ids[: k + 1]) for k, x in enumerate(ids)}
        assert len(rounds) <= 20
