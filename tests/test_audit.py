"""Operators of audits and spec changes on small fixtures: nulls, empty tables, ties and repeated rows."""

import json

from loomgraph.operators import audit as A
from loomgraph.operators import shapes as H
from loomgraph.operators import specs as P

ROUTE = "method string, path string, decorators array<string>, handler string, controller string, public_note string"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_routes_of_nulls_and_empty_paths(spark):
    r = spark.createDataFrame([("GET", None, None, None, None, None), ("GET", "", [], None, None, None), ("POST", "/notify", None, None, None, None), ("GET", "/notify", None, None, None, None)], ROUTE)
    got = rows(A.classify_routes(r, public=("GET /open/*",), names=("x",)), "method", "path", "class", "role")
    assert got == [("GET", "", "actionable", None), ("GET", "/notify", "actionable", None), ("GET", None, "actionable", None), ("POST", "/notify", "infrastructure", "webhook")]
    assert A.classify_routes(r.limit(0)).count() == 0
    assert rows(A.classify_routes(r.filter("method = 'POST'"), built_in=False), "class") == [("actionable",)]


def test_families_take_the_longest_prefix_first(spark):
    names = ["pay-api-a", "pay-api-b", "pay-api-c", "pay-web", "@s/x", "@s/y", "@s/z", "solo", "", None, "a-", "a-"]
    got = dict(rows(A.families(spark.createDataFrame([(n,) for n in names], "name string")), "name", "family"))
    assert got == {"pay-api-a": "pay-api-", "pay-api-b": "pay-api-", "pay-api-c": "pay-api-", "pay-web": "", "@s/x": "@s/", "@s/y": "@s/", "@s/z": "@s/", "solo": "", "": "", None: "", "a-": ""}


def test_api_choice(spark):
    c = [(1, "BILLING_API_URL", "billing-api", 1), (1, "BILLING_API_URL", "orders-api", 2), (1, "BILLING_API_URL", "orders-api", 2), (2, "API_URL", "billing-api", 1), (2, "API_URL", "orders-api", 2), (3, "ORDERS", "orders", 1)]
    c += [(4, "orders", "orders", 1), (4, "orders", "orders", 2), (4, "orders", "stock", 3), (5, "orders", None, 1), (5, "orders", "orders", 2), (5, "orders", "stock", 2)]
    got = rows(A.choose_api(spark.createDataFrame(c, "call int, setting string, api string, entry int")), "call", "outcome", "api", "entry")
    assert got == [(1, "one", "billing-api", 1), (2, "tie", None, None), (3, "none", None, None), (4, "narrowed", "orders", None), (5, "none", None, None)]


def test_sites_match_said_then_folded(spark):
    schema = "gap string, saying string, sites int"
    base = spark.createDataFrame([("g", "a", 1), ("g", "a", 1), ("g", "b", 1), ("g", None, 5), ("only", "x", 1)], schema)
    head = spark.createDataFrame([("g", "a", 1), ("g", "c", 1), ("g", None, 2)], schema)
    # said: one "a" meets; the base's "a" and "b" go into the head's two folded, the head's "c" into the base's five: four are left
    assert rows(A.match_sites(base, head), "gap", "added", "removed", "kept") == [("g", 0, 4, 4), ("only", 0, 1, 0)]
    assert A.match_sites(base.limit(0), head.limit(0)).count() == 0


def test_verdicts_without_any_fact(spark):
    p = spark.createDataFrame([("p", "s", "P", "class"), ("e", "s", "E", "external"), ("n", None, None, None)], "id string, service string, label string, kind string")
    m = spark.createDataFrame([("p.m", "p"), ("q.m", "gone")], "id string, owner string")
    edges = spark.createDataFrame([], "from_id string, to_id string, type string")
    out, gaps = spark.createDataFrame([], "service string, label string"), spark.createDataFrame([("s", 2)], "service string, n long")
    v = A.provider_verdicts(p, m, edges, out, gaps)
    assert rows(v, "id", "verdict") == [("e", "unknown"), ("n", "dead"), ("p", "likely-dead")]
    assert rows(A.method_verdicts(m, edges, v), "id", "verdict", "reason") == [("p.m", "likely-dead", "class not reached"), ("q.m", "likely-dead", "no class")]


def test_sarif_cut_and_empty(spark):
    f = spark.createDataFrame([("r", "error", "a.ts", 2, "m", "k"), ("r", "error", "a.ts", 1, "m", "k"), ("q", "note", "b.ts", 1, "m", "k"), ("q", None, "b.ts", 1, "m", "k")], "rule string, level string, uri string, line int, message string, key string")
    run = json.loads(A.sarif(f, most=2).first()[0])["runs"][0]
    assert [(x["ruleId"], x["locations"][0]["physicalLocation"]["region"]["startLine"], x["partialFingerprints"]["findingKey/v1"][-2:]) for x in run["results"]] == [("r", 1, ":1"), ("r", 2, ":2")]
    assert run["invocations"][0]["toolExecutionNotifications"][0]["message"]["text"].startswith("1 results left out")
    assert json.loads(A.sarif(f.limit(0)).first()[0])["runs"][0]["results"] == []


def test_operations_pair_by_added_parameters(spark):
    schema = "document string, kind string, op string, method string, path string, channel string"
    base = spark.createDataFrame([("d", "http", "GET /a/b", "GET", "/a/b", None), ("d", "http", "GET /c", "GET", "/c", None), ("d", "send", "old", None, None, "ch"), ("d", "http", "GET /t/:param", "GET", "/t/:param", None)], schema)
    head = spark.createDataFrame([("d", "http", "GET /a/:param/b", "GET", "/a/:param/b", None), ("d", "http", "GET /:param/c", "GET", "/:param/c", None), ("d", "http", "GET /c/:param", "GET", "/c/:param", None), ("d", "send", "new", None, None, "ch"), ("d", "http", "GET /t", "GET", "/t", None)], schema)
    got = rows(P.pair_operations(base, head), "op", "other", "how")
    assert got == sorted([("GET /a/b", "GET /a/:param/b", "moved"), ("GET /c", None, "removed"), ("GET /:param/c", None, "added"), ("GET /c/:param", None, "added"), ("old", "new", "moved"), ("GET /t/:param", None, "removed"), ("GET /t", None, "added")], key=repr)
    assert P.pair_operations(base.limit(0), head.limit(0)).count() == 0


def test_places_of_bodies():
    assert dict(H.places_of('{"a": [{"b": 1}, {"b": null}, 2], "c": {}}')) == {"": ["object"], "a": ["array"], "a[]": ["number", "object"], "a[].b": ["null", "number"], "c": ["object"]}
    assert H.places_of(None) == H.places_of("") == H.places_of("{") == [] and len(H.places_of("[" * 20_000)) == 0
    assert dict(H.places_of("[[1]]")) == {"": ["array"], "[]": ["array"], "[][]": ["number"]}


def test_shapes_and_traffic(spark):
    b = spark.createDataFrame([("e", '{"a": 1, "o": {"x": 1}}'), ("e", '{"a": "1"}'), ("e", "no"), ("e", None), (None, "1")], "entry string, body string")
    shapes = H.body_shapes(b, ["entry"])
    assert rows(shapes.filter("entry is not null"), "path", "types", "n", "of", "optional") == [("", ["object"], 2, 2, False), ("a", ["number", "string"], 2, 2, False), ("o", ["object"], 1, 2, True), ("o.x", ["number"], 1, 1, False)]
    declared = spark.createDataFrame([("e", "a", "any", False), ("e", "b", "string", False), ("e", "c", "string", True), ("e", "o", "O", True), ("e", "o.y", "string", False), ("f", "z", "string", False)], "entry string, path string, type string, optional boolean")
    got = rows(H.compare_traffic(shapes, declared, ["entry"], least=2), "path", "kind", "seen", "of")
    assert got == [("b", "missing_required", 0, 2), ("c", "declared_never_sent", 0, 2), ("o.x", "extra_field", 1, 1), ("o.y", "missing_required", 0, 1)]
    assert H.body_shapes(b.limit(0), ["entry"]).count() == 0


def test_route_audit_of_little_known_routes(spark):
    fields = "route string, method string, path string, controller string, public_note string, auth_note string, open boolean, refuses boolean, middleware_read boolean"
    r = spark.createDataFrame([(x, "GET", f"/{x}", None, None, None, None, None, None) for x in ("bare", "nodata", "gated", "skipped", "pub")], fields)
    gates = spark.createDataFrame([("gated", "guard", None), ("gated", "guard", "Open"), ("skipped", "guard", "Open"), ("bare", "pipe", None)], "route string, layer string, skipped_by string")
    hands = spark.createDataFrame([("bare", None), ("bare", "w")], "route string, label string")
    data = spark.createDataFrame([(x, "t") for x in ("bare", "bare", "gated", "skipped", "pub")], "route string, data string")
    got = rows(A.route_audit(r, gates, hands, data, public=("/pub",)), "route", "reason", "level")
    assert got == [("bare", "route-unguarded", "action"), ("skipped", "route-guard-skipped", "info")]


def test_causes_and_blind_spots(spark):
    fields = "reason string, cause string, package string, sites int, causes array<struct<cause: string, package: string, sites: int>>"
    g = spark.createDataFrame([("call-module-ref", None, "", None, None), ("x", "", "p", 3, []), ("x", "c", None, 2, [("a", None, 2), (None, None, 9)]), (None, None, None, None, None)], fields)
    assert rows(A.folded_causes(g), "cause", "package", "sites") == [("a", None, 2), ("container-lookup", None, 1), ("x", "p", 3), (None, None, 1)]
    u = spark.createDataFrame([(None, "http", "b", 2, 1), (None, "http", "a", 1, 5), (None, "http", "a", 1, 2), (None, "http", "c", 1, 1)], "service string, kind string, name string, count int, last_seen int")
    assert rows(A.blind_spots(u, 2), "count", "places", "last_seen", "names", "more") == [(5, 3, 5, [("a", 2), ("b", 2)], 1)]
