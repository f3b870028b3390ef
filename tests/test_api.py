"""API documents: read, written, read again; schemas of references; rings and odd rows."""

import json

import pytest

from loomgraph.functions.typerefs import schema_text
from loomgraph.sources import api_read as R
from loomgraph.sources import api_write as W


def obj(**properties):
    return {"type": "object", "properties": properties}


def ref(name):
    return {"$ref": f"#/components/schemas/{name}"}


def json_body(schema):
    return {"content": {"application/json": {"schema": schema}}}


HTTP = {
    "openapi": "3.1.0",
    "paths": {
        "/a/{id}": {
            "get": {"operationId": " getA ", "summary": "s", "parameters": [{"in": "path", "name": "id", "required": True, "schema": {"type": "string"}}, {"in": "query", "name": "q", "schema": {"type": "integer"}}, {"$ref": "#/components/parameters/P"}],
                    "responses": {"404": {"description": "NotFound"}, "201": {"description": "ok", **json_body({"type": "array", "items": ref("X")})}, "200": {"description": "plain", "content": {"text/plain": {}}}}},
            "post": {"requestBody": json_body({**obj(n={"type": ["string", "null"]}, k={"enum": ["a", "b'c", 1, True]}, i=obj(z={"oneOf": [{"type": "string"}, ref("X")]}), u={"allOf": [{"$ref": "other.json#/x"}, {"type": "string"}]}, e={"enum": [None]}, w={"anyOf": [ref("Y")]}), "required": ["n"]}), "responses": {}},
            "trace": {"operationId": "t"}, "x-y": {"a": 1}, "parameters": [],
        },
        "/odd": None, "/text": "x",
    },
    "components": {"schemas": {"X": obj(self=ref("X"), y=ref("Y")), "Y": obj(x=ref("X"), d={"type": "object"}), "E": {"enum": ["p", None, 2]}, "Al": {"type": "array", "items": {"type": "number"}}}},
}
EVENTS = {
    "asyncapi": "3.0.0",
    "channels": {
        "c1": {"address": "real.c1", "messages": {"m": {"$ref": "#/components/messages/M"}}},
        "a/b": {"messages": {"r": {"$ref": "#/channels/a~1b/messages/r2"}, "r2": {"$ref": "#/channels/a~1b/messages/r"}, "z": {"payload": {"type": "number"}}, "lost": {"$ref": "#/nowhere/x"}}},
    },
    "operations": {"op1": {"action": "send", "channel": {"$ref": "#/channels/c1"}, "messages": [{"$ref": "#/channels/c1/messages/m"}]}, "op2": {"action": "receive", "channel": {"$ref": "#/channels/a~1b"}}, "bad": {"action": "zap", "channel": {"$ref": "#/channels/c1"}}},
    "components": {"messages": {"M": {"payload": obj(t={"type": "string"})}}},
}
OLDER = {"asyncapi": "2.0.0", "channels": {"ev": {"publish": {"message": {"oneOf": [{"payload": {"type": "string"}}, {"payload": {"type": "boolean"}}]}}, "subscribe": {"operationId": "subs", "message": {"payload": {"type": "string"}}}}}}


@pytest.fixture(scope="module")
def api(spark):
    rows = [("svc", "d1", json.dumps(HTTP)), ("ev", "d2", json.dumps(EVENTS)), ("ev", "d3", json.dumps(OLDER)), ("x", "bad", "{"), ("x", "arr", "[1]"), ("x", "old", '{"swagger":"2.0","paths":{}}'), ("x", "none", "{}"), ("x", "nul", None)]
    return R.read_api(spark.createDataFrame(rows, "service string, document string, text string"))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_operations_and_problems(api):
    assert rows(api["operations"], "op", "kind", "method", "path", "channel", "body", "returns") == sorted([
        ("getA", "http", "GET", "/a/:param", None, None, "type:svc#X[]"), ("POST /a/:param", "http", "POST", "/a/:param", None, "type:svc#POSTAParamBody", None), ("t", "http", "ALL", "/a/:param", None, None, None),
        ("op1", "send", None, None, "real.c1", "type:ev#Op1Payload", None), ("op2", "receive", None, None, "a/b", "number", None), ("publish ev", "receive", None, None, "ev", "string | boolean", None), ("subs", "send", None, None, "ev", "string", None),
    ], key=str)
    told = rows(api["problems"], "service", "document", "problem")
    assert told == [("ev", "d2", "message dangling"), ("ev", "d2", "message ring"), ("ev", "d2", "message ring"), ("x", "arr", "not an object"), ("x", "bad", "not JSON"), ("x", "none", "neither paths nor channels"), ("x", "nul", "not JSON"), ("x", "old", "convert it to version 3 first")]
    assert rows(api["parameters"], "op", "place", "name", "type", "optional") == [("getA", "path", "id", "string", False), ("getA", "query", "q", "number", True)]


def test_types_and_fields(api):
    f = {(i.split("#")[1], n): (t, o) for i, n, t, o in rows(api["fields"], "id", "name", "type", "optional")}
    body = "POSTAParamBody"
    assert f[body, "n"] == ("string | null", False) and f[body, "k"] == ("'a' | 'b\\'c' | 1 | true", True) and f[body, "u"] == ("unknown", True)
    assert f[body, "i"] == (f"type:svc#{body}I", True) and f[f"{body}I", "z"] == ("string | type:svc#X", True) and f[body, "w"] == ("type:svc#Y", True) and f[body, "e"] == ("unknown", True)
    assert f["X", "self"] == ("type:svc#X", True) and f["Y", "d"] == ("object", True)
    kinds = {n: (k, m, a) for n, k, m, a in rows(api["types"], "name", "kind", "members", "alias")}
    assert kinds["E"] == ("enum", ["'p'", "2"], None) and kinds["Al"] == ("unknown", None, "number[]")


@pytest.mark.parametrize("most", [200, 1])
def test_written_documents_are_read_the_same(spark, api, most, tmp_path):
    written = W.write_api(api, most=most)
    W.save_documents(written, str(tmp_path / "docs"))
    back = R.read_api(W.saved_documents(spark, str(tmp_path / "docs")))
    assert back["problems"].count() == 0
    own = ["service", "kind", "method", "path", "raw_path", "channel", "body", "returns"]
    assert rows(back["operations"], *own) == [r for r in rows(api["operations"], *own) if r[2] != "ALL"]
    assert rows(back["fields"], "id", "name", "type", "optional") == rows(api["fields"], "id", "name", "type", "optional")
    assert rows(W.unwritten(api), "service", "reason", "n") == [("svc", "any-verb", 1)]
    if most == 1:
        assert written.filter("service = 'svc'").count() > 2  # one path, and schemas in documents of their own


def test_parts_and_graph(api):
    ops, parts = R.spec_tables(api)
    assert ops.count() == api["operations"].count()
    got = rows(parts.filter("document = 'svc' and part = 'request'"), "op", "field", "type", "optional")
    deep = [r for r in got if r[1].startswith("body.w")]
    assert ("POST /a/:param", "body.i.z", "string | type:svc#X", True) in got and ("GET /a/:param", "query.q", "number", True) in got
    assert [r[1] for r in deep] == ["body.w", "body.w.d", "body.w.x", "body.w.x.self", "body.w.x.y"]  # the ring is told and not opened
    nodes, edges = R.api_graph(api)
    assert nodes.count() == nodes.select("id").distinct().count()
    ids = {r[0] for r in rows(nodes, "id")}
    assert all(a in ids and b in ids for a, b in rows(edges, "from_id", "to_id"))


def test_too_deep_and_unknown_types(spark):
    n = 12
    types = spark.createDataFrame([(f"type:s#T{i}", "s", f"T {i}", "object", None, None) for i in range(n)] + [("type:s#Out", "s", "Out", "external", None, None)], "id string, service string, name string, kind string, members array<string>, alias string")
    fields = spark.createDataFrame([(f"type:s#T{i}", "next", f"type:s#T{i + 1}" if i < n - 1 else "type:s#Out", False) for i in range(n)] + [("type:s#T0", "gone", "type:s#None[]", True), ("type:s#T0", "out", "type:s#Out", True)], "id string, name string, type string, optional boolean")
    ops = spark.createDataFrame([("s", "d", "op", "http", "GET", "/x/:param/:param", "/x/:a/:a", None, None, None, "type:s#T0")], "service string, document string, op string, kind string, method string, path string, raw_path string, channel string, summary string, body string, returns string")
    none = {"parameters": "service string, op string, place string, name string, type string, optional boolean", "answers": "service string, op string, status string, description string, type string"}
    api = {"operations": ops, "types": types, "fields": fields, **{k: spark.createDataFrame([], v) for k, v in none.items()}}
    [row] = W.write_api(api).collect()
    doc = json.loads(row.text)
    schemas = doc["components"]["schemas"]
    assert list(doc["paths"]) == ["/x/{a}/{a2}"] and sorted(schemas) == [f"T_{i}" for i in range(8)]
    assert schemas["T_7"]["properties"]["next"] == {"x-unread": "too-deep"}
    assert schemas["T_0"]["properties"] == {"gone": {"type": "array", "items": {"x-unread": "type-not-found"}}, "next": {"$ref": "#/components/schemas/T_1"}, "out": {"x-unread": "external-type"}}


def test_no_documents(spark):
    empty = R.read_api(spark.createDataFrame([], "service string, document string, text string"))
    assert all(t.count() == 0 for t in empty.values()) and W.write_api(empty).count() == 0


@pytest.mark.parametrize(("text", "schema"), [
    ("string", {"type": "string"}), ("'a' | 'b' | null", {"type": ["string", "null"], "enum": ["a", "b", None]}), ("1 | 2.5", {"type": "number", "enum": [1, 2.5]}), ("'it\\'s' | 1 | true", {"enum": ["it's", 1, True]}),
    ("(string | null)[]", {"type": "array", "items": {"type": ["string", "null"]}}), ("type:s#A | null", {"anyOf": [{"$ref": "#/components/schemas/A"}, {"type": "null"}]}), ("[string, number]", {"type": "array", "items": {"anyOf": [{"type": "string"}, {"type": "number"}]}, "minItems": 2, "maxItems": 2}),
    ("{ a?: number; b: string | undefined }", {"type": "object", "properties": {"a": {"type": "number"}, "b": {"type": "string"}}}), ("Set<string>", {"x-unread": "not-json"}), ("Page<string>", {"x-unread": "generic-unread"}), ("string |", {"x-unread": "ref-unparsed"}), ("undefined", {"x-unread": "nothing-sent"}), ("Record<string, any>", {"type": "object", "additionalProperties": {"x-unread": "any-typed"}}), ("", {"x-unread": "ref-unparsed"}),
])
def test_reference_schemas(text, schema):
    assert json.loads(schema_text(text, {"type:s#A": "A"})) == schema


def many_paths(n):
    return json.dumps({"openapi": "3.1.0", "paths": {f"/some/long/path/{i}": {"post": {"requestBody": json_body(obj(a={"type": "string"})), "responses": {"200": {"description": "ok", **json_body({"type": "number"})}}}} for i in range(n)}})


def test_an_operation_carries_its_own_names_only(spark):
    docs = spark.createDataFrame([("s", "d", many_paths(300))], "service string, document string, text string")
    ops = R.http_operations(R.parsed(docs)).select("raw_path", "o").collect()
    assert len(ops) == 300 and max(len(r.o.metadata) for r in ops) < 200
    assert {json.dumps(r.o.toPython(), sort_keys=True) for r in ops} == {json.dumps(json.loads(many_paths(1))["paths"]["/some/long/path/0"]["post"], sort_keys=True)}


def test_schemas_are_compared_only_where_a_document_came_twice(spark, monkeypatch):
    plans = []
    plain = R.schemas
    monkeypatch.setattr(R, "schemas", lambda roots: plans.append(roots._jdf.queryExecution().optimizedPlan().toString()) or plain(roots))
    rows = [("s", "d", many_paths(3)), (None, "e", many_paths(2))]
    once, twice = (R.read_api(spark.createDataFrame(x, "service string, document string, text string")) for x in (rows, rows * 2))
    assert "Aggregate" not in plans[0].split("Join")[0] and "Aggregate" in plans[1]
    for name in ("types", "fields"):
        assert sorted(map(str, once[name].collect())) == sorted(map(str, twice[name].collect())) != []
    assert sorted(map(str, twice["operations"].collect())) == sorted(map(str, once["operations"].collect() * 2))


@pytest.mark.parametrize("text, whole", [('{"a": {"b": [1]}}', True), ("{}", True), ("[1]", False), ('"x"', False), ("1", False), ("null", False), ("{", False)])
def test_objects_are_told_by_themselves(spark, text, whole):
    from pyspark.sql import functions as F

    assert spark.range(1).select(R.is_object(F.try_parse_json(F.lit(text)))).first()[0] is whole


def test_links_of_types_are_found_once(spark, monkeypatch):
    plans = []
    plain = W.materialise
    monkeypatch.setattr(W, "materialise", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or plain(df, name))
    types = spark.createDataFrame([(f"type:s#{x}", None) for x in "ABC"], "id string, alias string")
    fields = spark.createDataFrame([("type:s#A", "b", "type:s#B"), ("type:s#B", "c", "type:s#C[]")], "id string, name string, type string")
    roots = spark.createDataFrame([("s", "type:s#A | null")], "service string, ref string")
    assert sorted((r.id[-1], r.level) for r in W.used_types(roots, types, fields).collect()) == [("A", 1), ("B", 2), ("C", 3)]
    assert len(plans) > 3 and sum("regexp_extract_all" in p for name, p in plans if name == "used") == 1
