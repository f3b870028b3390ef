"""Query tools over spans and sources of a small graph; flows, sequences and comparisons of two versions."""

import datetime

import pytest
from pyspark.sql import functions as F

from loomgraph import tools

SPANS = "trace_id string, span_id string, parent_id string, service string, entry string, at timestamp, status int, duration_ms double, error boolean"


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([("e1", "entry", "http", "GET /a", "shop", "a.ts", 3), ("e2", "entry", "http", "GET /b", "shop", "b.ts", 4), ("e3", "entry", "cron", "nightly", "bill", None, None), ("m1", "method", None, "Orders.list", "shop", "o.ts", 9), ("t1", "table", None, "orders", "shop", None, None)], "id string, type string, kind string, label string, service string, file string, line int")
    edges = spark.createDataFrame([("e1", "m1", "handles", "static"), ("m1", "t1", "queries", "static"), ("e2", "m1", "calls", "static")], "from_id string, to_id string, type string, confidence string")
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(f"t{i}", f"s{i}", None, "shop", "e1" if i % 3 else "e2", t0 + datetime.timedelta(minutes=i), 500 if i % 10 == 4 else 404 if i % 10 == 5 else 200, float(i), False) for i in range(40)]
    rows += [(f"t{i}", f"c{i}", f"s{i}", "bill", None, t0, 200, 1.0, False) for i in range(40)]
    rows += [("t1", "x", "s1", "mail", "e1", t0, 200, 1.0, False)]
    return tools.Graph(nodes, edges, spans=spark.createDataFrame(rows, SPANS))


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def test_traffic(spark, graph):
    assert rows(graph.slow_steps(most=1), "service", "entry", "count") in ([("shop", "e1", 26)], [("shop", "e2", 14)])
    assert graph.slow_steps(least=20).count() == 1
    assert sorted(rows(graph.hot_paths(), "entry", "service", "hits", "place")) == [("e1", "mail", 1, 2), ("e1", "shop", 26, 1), ("e2", "shop", 14, 1)]
    traces = graph.trace_for("e2", 2)
    assert sorted(set(rows(traces, "why", "rank", "trace_id"))) == [("failing", 1, "t24"), ("slow", 1, "t39"), ("slow", 2, "t36")]
    assert sorted(rows(traces.filter("trace_id = 't39'"), "span_id")) == [("c39",), ("s39",)]
    declared = spark.createDataFrame([("e1", 500), ("e2", 404)], "entry string, status int")
    assert rows(graph.undeclared_failures(declared)) == [("e2", 1, 1, 0.0714), ("e1", 0, 3, 0.1111)]
    assert rows(graph.never_seen(), "id", "kind") == [("e3", "cron")]
    with pytest.raises(ValueError):
        tools.Graph(graph.nodes, graph.edges).slow_steps()


def test_sources(graph):
    assert sorted(rows(graph.get_source(["m1", "GET /b", "none"])), key=str) == sorted([("m1", "m1", "o.ts", 9), ("GET /b", "e2", "b.ts", 4), ("none", None, None, None)], key=str)


def test_versions(spark, graph):
    edges = graph.edges.filter("from_id <> 'm1'")
    now = tools.Graph(graph.nodes, edges)
    assert sorted(rows(graph.sequences(), "entry", "place", "kind", "target")) == [("e1", 0, "enters", "shop"), ("e1", 1, "queries", "table:shop/orders"), ("e2", 0, "enters", "shop"), ("e2", 1, "queries", "table:shop/orders"), ("e3", 0, "enters", "bill")]
    assert sorted(rows(now.flow_changes(graph), "entry", "reaches", "same", "added", "removed")) == [("e1", 1, 1, 0, 1), ("e2", 1, 1, 0, 1)]
    assert sorted(rows(now.comparison(graph))) == [("edge", "m1 -queries-> t1", "removed"), ("flow", "e1", "+0 -1"), ("flow", "e2", "+0 -1"), ("join", "m1", "lost")]
    entries = graph.nodes.filter("type = 'entry'").select(F.col("id"))
    assert sorted(rows(graph.writes_reached(entries))) == [("e1", "t1"), ("e2", "t1")]
