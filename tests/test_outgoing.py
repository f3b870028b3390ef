"""Outgoing calls: each rule on a small graph, and that an earlier one takes the call."""

from loomgraph.operators import outgoing as G

CALLS = "call_id long, service string, method string, unread boolean, path string, env string, variable string, host string, binding string, typed boolean"
TABLES = {
    "routes": ("route_id string, service string, method string, path string, prefix string, api string", [
        ("r1", "a", "GET", "/items/:param", None, "main"), ("r2", "a", "GET", "/items/new", None, "main"), ("r3", "b", "POST", "/v2/items", "v2", "main"), ("r4", "b", "GET", "/x", None, "orders admin"), ("r5", "b", "GET", "/x", None, "public"),
        ("r6", "b", "ALL", "/files/*", None, "main"),
    ]),
    "markers": ("call_id long, ord int, service string, method string, path string", [(1, 2, "b", "POST", "/items"), (1, 1, "a", None, "/items/7"), (1, 0, "a", "GET", "/none"), (2, 0, "zz", "GET", "/items/7")]),
    "bindings": ("service string, binding string, target string", [("s", "B", "a"), ("s", "M", "a"), ("s", "M", "b")]),
    "claims": ("env string, service string", [("A_URL", "a"), ("B_URL", "b"), ("TWO", "a"), ("TWO", "b"), ("PUBLIC_URL", "b"), ("BASE", "a")]),
    "values": ("service string, env string, kind string, target string, start string", [("s", "V", "service", "a", "/items"), ("s", "E", "external", None, None), ("s", "W", "service", "a", None), ("s", "W", "service", "b", None), ("s", "A_URL", "external", None, None)]),
    "urls": ("call_id long, entry string", [(20, "f2"), (20, "f1"), (21, "f1")]),
}


def call(i, path="/items/7", method=None, env=None, **more):
    return (i, "s", method, more.get("unread"), path, env, more.get("variable"), more.get("host"), more.get("binding"), more.get("typed"))


ASKED = {
    1: (call(1, env="B_URL"), ("linked", "marker", "a", "r1", 1)), 2: (call(2, env="A_URL"), ("linked", "env", "a", "r1", 0)), 3: (call(3, "/items/new", binding="B"), ("linked", "binding", "a", "r2", 0)),
    4: (call(4, binding="M"), ("unknownBinding", None, None, None, 0)), 5: (call(5, binding="Q", typed=False), ("dynamic", None, None, None, 0)), 6: (call(6, binding="Q"), ("unknownBinding", None, None, None, 0)),
    7: (call(7, host="h"), ("external", None, None, None, 0)), 8: (call(8), ("dynamic", None, None, None, 0)), 9: (call(9, env="TWO"), ("unknownEnv", None, None, None, 0)), 10: (call(10, env="none"), ("unknownEnv", None, None, None, 0)),
    11: (call(11, "/7", env="V"), ("linked", "value", "a", "r1", 0)), 12: (call(12, env="V"), ("linked", "value", "a", "r1", 0)), 13: (call(13, env="E"), ("external", None, None, None, 0)), 14: (call(14, env="W"), ("unknownEnv", None, None, None, 0)),
    15: (call(15, "/items", "POST", "B_URL"), ("linked", "env", "b", "r3", 0)), 16: (call(16, "/x", env="B_URL"), ("ambiguous", None, "b", None, 0)), 17: (call(17, "/x", env="PUBLIC_URL"), ("linked", "apiName", "b", "r5", 0)),
    18: (call(18, "/no", env="A_URL"), ("noRoute", None, "a", None, 0)), 19: (call(19, env="A_URL", unread=True), ("dynamic", None, "a", None, 0)), 20: (call(20, None, env="none"), ("linked", "functionUrl", None, "f1", 1)),
    21: (call(21, env="A_URL"), ("linked", "env", "a", "r1", 0)), 22: (call(22, "/items/${x}", env="A_URL"), ("dynamic", None, "a", None, 0)), 23: (call(23, env="made", variable="BASE"), ("linked", "env", "a", "r1", 0)),
    24: (call(24, "/files/a/b/c", "PUT", "B_URL"), ("linked", "env", "b", "r6", 0)), 25: (call(25, "/items/7", "POST", "A_URL"), ("noRoute", None, "a", None, 0)),
}


def went(spark, rows, tables):
    out = G.outgoing_calls(spark.createDataFrame(rows, CALLS), *[spark.createDataFrame(tables.get(n, []), s) for n, (s, _) in TABLES.items()])
    return {r.call_id: (r.outcome, r.way, r.target, r.route_id, r.also) for r in out.collect()}


def test_rules(spark):
    rows = [c for c, _ in ASKED.values()]
    got = went(spark, rows + rows[:3] + [call(None)], {n: r + r[:1] for n, (_, r) in TABLES.items()})
    assert {i: (got[i], w) for i, (_, w) in ASKED.items() if got[i] != w} == {}
    assert len(got) == len(ASKED)


def test_empty(spark):
    assert went(spark, [], {}) == {}
    assert went(spark, [call(1, env="X"), call(2, binding="B"), call(3, None)], {}) == {1: ("unknownEnv", None, None, None, 0), 2: ("unknownBinding", None, None, None, 0), 3: ("dynamic", None, None, None, 0)}
