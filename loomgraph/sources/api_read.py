"""OpenAPI 3 and AsyncAPI 2 and 3 documents as tables: operations, parameters, answers, types, fields, and the graph they declare.

A document is read as VARIANT, so its shape needn't be known. Schemas are opened level by level, each level a written table: a schema
node has the reference it stands for ("string", "type:SERVICE#Name", "a | b", "x[]"), or waits for its members'. References between
messages are followed as joins over the table (document, pointer, value). Members of objects come in the order of their keys, as
VARIANT keeps them so; arrays keep their order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..store import materialise

# The verbs of a path item, the words for the ends of a channel, where named schemas and messages are, and how many
# references between messages are followed.
VERBS = {"get": "GET", "put": "PUT", "post": "POST", "delete": "DELETE", "options": "OPTIONS", "head": "HEAD", "patch": "PATCH", "trace": "ALL"}
ENDS = {"send": "send", "receive": "receive", "subscribe": "send", "publish": "receive"}
SCHEMAS = "#/components/schemas/"
MESSAGE_PREFIXES = ("#/components/messages/", "#/channels/")
MOST_LINKS = 8
SCALARS = {"string": "string", "number": "number", "integer": "number", "boolean": "boolean", "null": "null"}
UNKNOWN = "unknown"

DOC = ["service", "document"]


def _table(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def kind_of(v: Column) -> Column:
    """STRING, BOOLEAN, BIGINT …, OBJECT<…>, ARRAY<…>; null for a missing value."""
    return F.schema_of_variant(v)


def text_at(v: Column, path: str) -> Column:
    """The string there; null for anything else."""
    x = at(v, path)
    return F.when(kind_of(x) == "STRING", x.cast("string"))


def is_object(v: Column) -> Column:
    return at(v, "$", "struct<>").isNotNull()  # its members aren't looked at, as they are for a kind


def items(v: Column, path: str) -> Column:
    return F.coalesce(at(v, path, "array<variant>"), F.array().cast("array<variant>"))


def alone(v: Column) -> Column:
    """A part of a document with its own names only: a part else carries the names of the whole document wherever it goes."""
    return F.parse_json(F.to_json(v))


def exploded(df: DataFrame, v: str, path: str, key: str, value: str) -> DataFrame:
    """A row for each member of the object there; none where it isn't one."""
    return df.withColumn("_m", at(F.col(v), path, "map<string,variant>")).select(*df.columns, F.explode("_m").alias(key, value))


def digest(*parts: Column) -> Column:
    """Sixteen bytes for some parts, whatever these hold."""
    return F.unhex(F.left(F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])), 256), F.lit(32)))


def shape_name(name: Column) -> Column:
    """Words run together with capitals: the name that shapes of an operation begin with."""
    parts = F.filter(F.split(name, "[^A-Za-z0-9]+"), lambda w: w != "")
    joined = F.array_join(F.transform(parts, _capital), "")
    return F.when(joined == "", "Anonymous").otherwise(joined)


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 20))


def json_schema_of(content: Column) -> Column:
    """The schema under the first media type, in order of names, that is JSON."""
    json = F.filter(F.map_entries(content), lambda e: F.lower(e["key"]).contains("json"))
    # variants have no order, so the entry is found by its key
    first = F.array_min(F.transform(json, lambda e: e["key"]))
    return at(F.get(F.filter(json, lambda e: e["key"] == first), F.lit(0))["value"], "$.schema")


def parsed(docs: DataFrame) -> DataFrame:
    """docs (service, document, text) with `v` and `format` openapi|asyncapi, or a `problem` instead.

    Problems: not JSON, not an object, a document of version 2 of the older form, neither form. Null texts are not JSON.
    """
    d = docs.select("service", "document", F.try_parse_json("text").alias("v"))
    older, http, events = text_at(F.col("v"), "$.swagger"), at(F.col("v"), "$.openapi"), at(F.col("v"), "$.asyncapi")
    problem = (
        F.when(F.col("v").isNull(), "not JSON").when(~is_object(F.col("v")), "not an object").when(older.isNotNull(), "convert it to version 3 first")
        .when(http.isNull() & events.isNull() & at(F.col("v"), "$.paths").isNull() & at(F.col("v"), "$.channels").isNull(), "neither paths nor channels")
    )
    form = F.when(events.isNotNull() | (http.isNull() & at(F.col("v"), "$.channels").isNotNull()), "asyncapi").otherwise("openapi")
    return d.withColumn("problem", problem).withColumn("format", F.when(F.col("problem").isNull(), form))


def http_operations(d: DataFrame) -> DataFrame:
    """(service, document, key, op, method, path, raw_path, summary, o): an operation for each verb of each path; o is its VARIANT."""
    paths = exploded(d.filter("format = 'openapi'").select(*DOC, "v"), "v", "$.paths", "raw_path", "item").drop("v")
    verbs = exploded(paths, "item", "$", "verb", "o").drop("item").filter(F.col("verb").isin(*VERBS) & is_object(F.col("o")))
    method, path = _table(VERBS, F.col("verb")), S.normalise_path(F.col("raw_path"))
    own = F.trim(text_at(F.col("o"), "$.operationId"))
    return verbs.select(
        *DOC, F.to_json(F.array("raw_path", "verb")).alias("key"), F.when(own != "", own).otherwise(F.concat_ws(" ", method, path)).alias("op"),
        method.alias("method"), path.alias("path"), "raw_path", text_at(F.col("o"), "$.summary").alias("summary"), alone(F.col("o")).alias("o"),
    )


def _pointer(ref: Column) -> Column:
    """The steps of a local reference, unescaped."""
    return F.transform(F.split(F.substring(ref, 3, 1 << 20), "/"), lambda s: F.coalesce(F.try_url_decode(F.replace(F.replace(F.replace(s, F.lit("+"), F.lit("%2B")), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))), s))


def message_places(d: DataFrame) -> DataFrame:
    """(service, document, steps, m): every message that a reference may name."""
    a = d.filter("format = 'asyncapi'").select(*DOC, "v")
    shared = exploded(a, "v", "$.components.messages", "k", "m").select(*DOC, F.array(F.lit("components"), F.lit("messages"), "k").alias("steps"), "m")
    channels = exploded(a, "v", "$.channels", "c", "ch").drop("v")
    own = exploded(channels, "ch", "$.messages", "k", "m").select(*DOC, F.array(F.lit("channels"), "c", F.lit("messages"), "k").alias("steps"), "m")
    inside = exploded(channels, "ch", "$", "w", "o").filter(F.col("w").isin("subscribe", "publish")).select(*DOC, F.array(F.lit("channels"), "c", "w", F.lit("message")).alias("steps"), at(F.col("o"), "$.message").alias("m"))
    return shared.unionByName(own).unionByName(inside.filter("m is not null"))


def followed(messages: DataFrame, places: DataFrame) -> DataFrame:
    """messages (service, document, …, m) with m behind its references, or null, and `link`: null, dangling, or ring (MOST_LINKS or
    more of them). One join for each link; it ends as soon as no message is a reference."""
    cols = messages.columns
    done, left = [], messages.withColumn("link", F.lit(None).cast("string"))
    ref = text_at(F.col("m"), "$['$ref']")
    p = places.select(*DOC, "steps", F.col("m").alias("there"))
    for step in range(MOST_LINKS + 1):
        left = materialise(left, "messages")
        done.append(left.filter(ref.isNull()))
        left = left.filter(ref.isNotNull())
        if left.isEmpty():
            break
        if step == MOST_LINKS:
            done.append(left.withColumns({"m": F.lit(None).cast("variant"), "link": F.lit("ring")}))
            break
        known = F.when(reduce(lambda a, b: a | b, [ref.startswith(x) for x in MESSAGE_PREFIXES]), ref)
        met = left.withColumn("steps", _pointer(known)).join(p, [*DOC, "steps"], "left")
        left = met.select(*[c for c in cols if c != "m"], F.col("there").alias("m"), F.when(F.col("there").isNull(), "dangling").alias("link"))
    return reduce(DataFrame.unionByName, done)


def channel_operations(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(operations, links): (service, document, key, op, kind send|receive, channel, summary, payload), and references that lead nowhere.

    Operations beside the channels if the document has `operations`, else inside them. A payload is the schema of the messages; of
    several, a choice.
    """
    a = d.filter("format = 'asyncapi'").select(*DOC, "v", at(F.col("v"), "$.operations").isNotNull().alias("beside"))
    channels = exploded(a, "v", "$.channels", "c", "ch").drop("v")
    beside = exploded(a.filter("beside"), "v", "$.operations", "name", "o").drop("v")
    target = text_at(F.col("o"), "$.channel['$ref']")
    key = F.when(target.startswith("#/channels/"), F.substring(target, len("#/channels/") + 1, 1 << 20))
    beside = beside.withColumn("c", F.when(~key.contains("/") & (key != ""), F.replace(F.replace(key, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))))
    beside = beside.withColumn("kind", _table(ENDS, text_at(F.col("o"), "$.action"))).filter("kind is not null and c is not null")
    beside = beside.join(channels.select(*DOC, "c", "ch"), [*DOC, "c"])
    own, all_of = items(F.col("o"), "$.messages"), at(F.col("ch"), "$.messages", "map<string,variant>")
    names = F.array_sort(F.map_keys(all_of))
    messages = F.when(F.size(own) > 0, own).otherwise(F.coalesce(F.transform(names, lambda k: all_of[k]), F.array().cast("array<variant>")))
    beside = beside.select(*DOC, F.to_json(F.array("name", "c")).alias("key"), F.col("name").alias("op"), "kind", F.coalesce(text_at(F.col("ch"), "$.address"), "c").alias("channel"), text_at(F.col("o"), "$.summary").alias("summary"), messages.alias("messages"))
    inside = exploded(channels.filter("not beside"), "ch", "$", "w", "o").filter(is_object(F.col("o")))
    inside = inside.withColumn("kind", _table(ENDS, F.col("w"))).filter("kind is not null")
    message = at(F.col("o"), "$.message")
    named = F.coalesce(text_at(F.col("o"), "$.operationId"), F.concat_ws(" ", "w", "c"))
    inside = inside.select(*DOC, F.to_json(F.array("c", "w")).alias("key"), named.alias("op"), "kind", F.col("c").alias("channel"), text_at(F.col("o"), "$.summary").alias("summary"), F.when(message.isNotNull(), F.array(message)).otherwise(F.array().cast("array<variant>")).alias("messages"))
    ops = materialise(beside.unionByName(inside), "ends")
    each = ops.select(*DOC, "key", F.posexplode("messages").alias("i", "m"))
    found = followed(each, message_places(d))
    one = at(F.col("m"), "$.payload")
    choice = F.transform(items(F.col("m"), "$.oneOf"), lambda x: at(x, "$.payload"))
    payloads = F.when(F.size(items(F.col("m"), "$.oneOf")) > 0, F.filter(choice, lambda x: x.isNotNull())).otherwise(F.filter(F.array(one), lambda x: x.isNotNull()))
    # an operation's messages are a list of its document, gathered as text: variants can't be ordered
    listed = found.select(*DOC, "key", "i", F.posexplode(F.transform(payloads, lambda x: F.to_json(x))).alias("j", "p"))
    by = listed.groupBy(*DOC, "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "p"))), lambda x: x["p"]).alias("ps"))
    payload = F.when(F.size("ps") == 1, F.get("ps", F.lit(0))).otherwise(F.concat(F.lit('{"oneOf":['), F.array_join("ps", ","), F.lit("]}")))
    ops = ops.drop("messages").join(by.select(*DOC, "key", F.parse_json(payload).alias("payload")), [*DOC, "key"], "left")
    links = found.filter("link is not null").select(*DOC, "key", F.concat(F.lit("message "), "link").alias("problem"))
    return ops, links


CHILD = "array<struct<ord:int,role:string,key:string,name:string,optional:boolean,s:variant>>"
NODE = ["service", "document", "id", "parent", "ord", "role", "key", "name", "optional", "owner", "s"]


def _literal(v: Column) -> Column:
    k = kind_of(v)
    quoted = F.concat(F.lit("'"), F.replace(v.cast("string"), F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(k == "STRING", quoted).when((k == "BOOLEAN") | k.isin("BIGINT", "DOUBLE") | k.startswith("DECIMAL"), F.to_json(v))


def opened(nodes: DataFrame) -> DataFrame:
    """Schema nodes with what they are: `text` where that is known at once, else `joint` and children; `type_kind` where one is a type.

    What is asked more than once of a schema is a column of its own for a while, so it is worked out, and compiled, once.
    """
    s = F.col("s")
    typed = at(s, "$.type")
    own = nodes.withColumns({
        "_ref": text_at(s, "$['$ref']"), "_kinds": F.when(F.coalesce(kind_of(typed).startswith("ARRAY"), F.lit(False)), at(s, "$.type", "array<string>")).otherwise(F.array(text_at(s, "$.type"))),
        "_all": items(s, "$.allOf"), "_one": items(s, "$.oneOf"), "_any": items(s, "$.anyOf"), "_enum": F.transform(items(s, "$.enum"), _literal), "_item": at(s, "$.items"),
        "_props": at(s, "$.properties", "map<string,variant>"), "_need": F.coalesce(at(s, "$.required", "array<string>"), F.array().cast("array<string>")),
        "_loose": F.coalesce(at(s, "$.nullable", "boolean"), F.lit(False)),
    })
    own = own.withColumns({"_solid": F.filter("_kinds", lambda k: k.isNotNull() & (k != "null")), "_names": F.array_sort(F.map_keys("_props"))})
    own = own.withColumn("_kind", F.coalesce(F.get("_solid", F.lit(0)), F.get("_kinds", F.lit(0))))
    component = F.col("role") == "component"
    is_enum, full, has = F.size("_enum") > 0, ~F.exists("_enum", lambda x: x.isNull()), F.col("_props").isNotNull()
    # a named schema is an enum or an object before it is anything else; others are what they refer to first
    what = F.when(component, F.when(is_enum, "enum").when(has, "object").otherwise("alias")).otherwise(
        F.when(F.col("_ref").isNotNull(), "ref").when(F.size("_all") > 0, "allOf").when(F.size("_one") > 0, "oneOf").when(F.size("_any") > 0, "anyOf")
        .when(is_enum & full, "literals").when(F.col("_kind") == "array", "array").when(has, "object").when(F.col("_kind") == "object", "empty").otherwise("scalar")
    )
    nullable = ~component & (F.col("_loose") | (F.array_contains("_kinds", "null") & (F.size("_solid") > 0)))
    own = own.withColumns({"what": what, "nullable": F.coalesce(nullable, F.lit(False))})
    type_id = F.concat(F.lit("type:"), "service", F.lit("#"), "name")
    w, name = F.col("what"), F.col("name")
    text = (
        F.when(w == "ref", F.when(F.col("_ref").startswith(SCHEMAS), F.concat(F.lit("type:"), "service", F.lit("#"), F.substring("_ref", len(SCHEMAS) + 1, 1 << 20))).otherwise(UNKNOWN))
        .when(w == "literals", F.array_join("_enum", " | ")).when(w == "empty", "object").when(w.isin("object", "enum"), type_id)
        .when(w == "scalar", F.coalesce(_table(SCALARS, F.col("_kind")), F.lit(UNKNOWN)))
    )
    child = lambda i, role, k, n, opt, v: F.struct(i.cast("int").alias("ord"), F.lit(role).alias("role"), k.cast("string").alias("key"), n.alias("name"), opt.alias("optional"), v.alias("s"))
    none, no = F.lit(None), F.lit(False)
    several = F.when(w == "allOf", F.col("_all")).when(w == "oneOf", F.col("_one")).when(w == "anyOf", F.col("_any"))
    children = (
        F.when(w == "object", F.transform("_names", lambda k, i: child(i, "field", k, F.concat(name, _capital(k)), ~F.array_contains("_need", k), F.col("_props")[k])))
        .when(w.isin("allOf", "oneOf", "anyOf"), F.transform(several, lambda v, i: child(i, "member", none, F.concat(name, (i + 1).cast("string")), no, v)))
        .when((w == "array") & F.col("_item").isNotNull(), F.array(child(F.lit(0), "member", none, F.concat(name, F.lit("Item")), no, F.col("_item"))))
        .when(w == "alias", F.array(child(F.lit(0), "alias", none, F.concat(name, F.lit("Alias")), no, s)))
    )
    out = own.withColumns({
        "text": text, "children": F.coalesce(children.cast(CHILD), F.array().cast(CHILD)), "type_kind": F.when(w.isin("object", "enum"), w).when(w == "alias", UNKNOWN),
        "members": F.when(w == "enum", F.filter("_enum", lambda x: x.isNotNull())),
    })
    return out.withColumn("type_id", F.when(F.col("type_kind").isNotNull(), type_id)).drop("s", *[c for c in out.columns if c.startswith("_")])


def schemas(roots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """roots (service, document, id, role component|root, name, s) -> (refs (id, ref), types, fields).

    types: id, service, name, kind, declared_in, members, alias. fields: id, name, type, optional. A type named twice is the
    component, else that of the first document and place. Down one level of schemas a step, then up again; a step is a job over
    that level only, so the number of steps is the depth of the deepest schema.
    """
    none = F.lit(None).cast("string")
    level = roots.select(*DOC, "id", F.lit(None).cast("binary").alias("parent"), F.lit(0).alias("ord"), "role", none.alias("key"), "name", F.lit(False).alias("optional"), none.alias("owner"), "s")
    levels = []
    while True:
        now = materialise(opened(level), "schemas")
        levels.append(now)
        below = now.filter(F.size("children") > 0)
        if below.isEmpty():
            break
        c = below.select(*DOC, F.col("id").alias("parent"), F.when(F.col("what").isin("object", "alias"), F.col("type_id")).alias("owner"), F.explode("children").alias("c")).select(*DOC, "parent", "owner", "c.*")
        level = c.withColumn("id", digest(F.hex("parent"), F.col("ord"))).select(*NODE)
    texts, under = [], None
    for now in reversed(levels):
        own = now.select("id", "parent", "ord", "role", "key", "optional", "owner", "what", "nullable", "text", *DOC)
        if under is not None:
            # the members of one schema; as many as its document lists
            got = under.filter("role = 'member'").groupBy(F.col("parent").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("m"))
            own = own.join(got, "id", "left")
        else:
            own = own.withColumn("m", F.lit(None).cast("array<string>"))
        odd = F.exists("m", lambda x: x == UNKNOWN)
        w = F.col("what")
        joined = (
            F.when(w == "array", F.concat(F.coalesce(F.get("m", F.lit(0)), F.lit(UNKNOWN)), F.lit("[]")))
            .when(w.isin("allOf", "oneOf", "anyOf"), F.when(odd, UNKNOWN).when(w == "allOf", F.array_join("m", " & ")).otherwise(F.array_join("m", " | ")))
        )
        text = F.coalesce("text", joined)
        own = own.withColumn("text", F.when(F.col("nullable") & ~text.isin(UNKNOWN, "null"), F.concat(text, F.lit(" | null"))).otherwise(text)).drop("m")
        under = materialise(own, "refs")
        texts.append(under)
    every, known = reduce(DataFrame.unionByName, texts), reduce(DataFrame.unionByName, levels)
    declared = known.filter("type_id is not null").select(F.col("type_id").alias("id"), "service", "name", F.col("type_kind").alias("kind"), F.concat_ws("#", *DOC).alias("declared_in"), "members", F.col("id").alias("node"), F.struct(F.col("role") != "component", F.col("document"), F.col("id")).alias("order"))
    first = declared.groupBy("id").agg(F.min_by("node", "order").alias("node"))
    types = declared.join(first, ["id", "node"])
    alias = every.filter("role = 'alias'").select(F.col("parent").alias("node"), F.col("text").alias("alias"))
    fields = every.filter("role = 'field'").select(F.col("owner").alias("id"), F.col("parent").alias("node"), F.col("key").alias("name"), F.col("text").alias("type"), "optional")
    return (
        every.filter("parent is null").select("id", F.col("text").alias("ref")),
        types.join(alias, "node", "left").select("id", "service", "name", "kind", "declared_in", "members", "alias"),
        fields.join(first, ["id", "node"]).select("id", "name", "type", "optional"),
    )


def read_api(docs: DataFrame) -> dict[str, DataFrame]:
    """Tables of documents (service, document, text), which may be of either form and several to a service.

    * problems: service, document, key (an operation's, or null), problem
    * operations: service, document, op, kind http|send|receive, method, path, raw_path, channel, summary, body, returns (references)
    * parameters: service, document, op, place path|query|header|cookie, name, type, optional
    * answers: service, document, op, status, description, type
    * types and fields as in `schemas`

    Documents with a problem give nothing else. A body or answer that isn't JSON has no reference. `returns` is the schema of the
    first success status, in order, that has one. Repeated documents give repeated operations, but a type only once. No documents:
    empty tables.
    """
    d = materialise(parsed(docs), "documents")
    http = materialise(http_operations(d), "operations")
    ends, links = channel_operations(d)
    ends = materialise(ends, "ends")
    op, shape = F.col("o"), shape_name(F.col("op"))
    rid = lambda *x: digest(F.col("service"), F.col("document"), *x)
    key = F.col("key")
    root = lambda df, i, name, s: df.select(*DOC, i.alias("id"), F.lit("root").alias("role"), name.alias("name"), s.alias("s")).filter("s is not null")
    components = exploded(d.filter("problem is null").select(*DOC, "v"), "v", "$.components.schemas", "name", "s")
    components = components.select(*DOC, rid(F.lit("component"), F.col("name")).alias("id"), F.lit("component").alias("role"), "name", "s")

    answers = exploded(http.select(*DOC, "key", "op", "o"), "o", "$.responses", "status", "a").drop("o")
    success = F.col("status").rlike(r"(?i)^2(\d\d|XX)$")
    answers = answers.select(*DOC, "key", "op", "status", text_at(F.col("a"), "$.description").alias("description"), json_schema_of(at(F.col("a"), "$.content", "map<string,variant>")).alias("s"), success.alias("success"))
    answers = materialise(answers, "answers")
    best = answers.filter("success and s is not null").groupBy(*DOC, "key").agg(F.min("status").alias("best"))
    answers = answers.join(best, [*DOC, "key"], "left").withColumn("role", F.when(F.col("status") == F.col("best"), "Response").otherwise(F.concat(F.lit("Answer"), "status")))
    params = http.select(*DOC, "key", "op", F.posexplode(items(op, "$.parameters")).alias("i", "p"))
    params = params.select(*DOC, "key", "op", "i", text_at(F.col("p"), "$.in").alias("place"), text_at(F.col("p"), "$.name").alias("name"), (~F.coalesce(at(F.col("p"), "$.required", "boolean"), F.lit(False))).alias("optional"), at(F.col("p"), "$.schema").alias("s")).filter("place is not null and name is not null")
    body = json_schema_of(at(op, "$.requestBody.content", "map<string,variant>"))
    roots = [
        components,
        root(http, rid(key, F.lit("body")), F.concat(shape, F.lit("Body")), body),
        root(answers, rid(key, F.lit("answer"), F.col("status")), F.concat(shape, "role"), F.col("s")),
        root(params, rid(key, F.lit("parameter"), F.col("i")), F.concat(shape, F.lit("Parameter"), _capital(F.col("name"))), F.col("s")),
        root(ends, rid(key, F.lit("payload")), F.concat(shape, F.lit("Payload")), F.col("payload")),
    ]
    roots = reduce(DataFrame.unionByName, roots)
    # within one document no two schemas have one id
    refs, types, fields = schemas(roots if d.groupBy(*DOC).count().filter("count > 1").isEmpty() else roots.dropDuplicates(["id"]))
    refs = materialise(refs, "roots")

    def with_ref(df: DataFrame, i: Column, name: str) -> DataFrame:
        return df.withColumn("_id", i).join(refs.select(F.col("id").alias("_id"), F.col("ref").alias(name)), "_id", "left").drop("_id")

    answers = with_ref(answers, rid(key, F.lit("answer"), F.col("status")), "type")
    returns = answers.filter("status = best").select(*DOC, "key", F.col("type").alias("returns")).dropDuplicates([*DOC, "key"])
    routes = with_ref(http, rid(key, F.lit("body")), "body").join(returns, [*DOC, "key"], "left")
    none = F.lit(None).cast("string")
    routes = routes.select(*DOC, "op", F.lit("http").alias("kind"), "method", "path", "raw_path", none.alias("channel"), "summary", "body", "returns")
    events = with_ref(ends, rid(key, F.lit("payload")), "body").select(*DOC, "op", "kind", none.alias("method"), none.alias("path"), none.alias("raw_path"), "channel", "summary", "body", none.alias("returns"))
    problems = d.filter("problem is not null").select(*DOC, none.alias("key"), "problem").unionByName(links)
    return {
        "problems": problems,
        "operations": routes.unionByName(events),
        "parameters": with_ref(params, rid(key, F.lit("parameter"), F.col("i")), "type").select(*DOC, "op", "place", "name", F.coalesce("type", F.lit(UNKNOWN)).alias("type"), "optional"),
        "answers": answers.select(*DOC, "op", "status", "description", "type"),
        "types": types,
        "fields": fields,
    }


def flat_fields(types: DataFrame, fields: DataFrame, roots: DataFrame, depth: int = 8) -> DataFrame:
    """roots (key, ref) -> (key, path, type, optional): the fields below each root, through named types.

    A field is optional if one on the way to it is. A type that holds itself is told by its id and not opened again on that way;
    deeper fields than `depth` are not opened.
    """
    step = materialise(fields.select(F.col("id").alias("at_id"), "name", F.col("type").alias("ftype"), F.col("optional").alias("fopt")), "fields")  # levels read them again and again
    named = lambda ref: F.regexp_extract(ref, r"^(type:[^ |&\[\]]+)( \| null)?$", 1)
    left = roots.select("key", F.lit("").alias("path"), F.lit(False).alias("optional"), named(F.col("ref")).alias("at_id"), F.array().cast("array<string>").alias("way")).filter("at_id <> ''")
    out = []
    for _ in range(depth):
        met = left.join(step, "at_id").select("key", F.concat("path", F.when(F.col("path") == "", "").otherwise("."), "name").alias("path"), F.col("ftype").alias("type"), (F.col("optional") | F.col("fopt")).alias("optional"), F.array_append("way", F.col("at_id")).alias("way"))
        met = materialise(met, "flat")
        out.append(met.drop("way"))
        left = met.select("key", "path", "optional", named(F.col("type")).alias("at_id"), "way").filter("at_id <> '' and not array_contains(way, at_id)")
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)


def spec_tables(api: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(operations, parts) of the documents as `specs.spec_changes` takes them; document is the service. Callers and marks of public
    operations aren't in documents: none and false."""
    ops = api["operations"].withColumn("k", F.when(F.col("kind") == "http", F.concat_ws(" ", "method", "path")).otherwise(F.concat_ws(" ", "kind", "channel")))
    head = [F.col("service").alias("document"), "kind", F.col("k").alias("op")]
    out = ops.select(*head, "method", "path", "channel", F.lit(0).cast("long").alias("callers"), F.lit(False).alias("public"))
    none = F.lit(None).cast("string")
    full = lambda part, status, field, kind, optional: [F.lit(part).alias("part"), status.alias("status"), field.alias("field"), kind.alias("type"), optional.alias("optional")]
    no = F.lit(False)
    first = ops.filter("kind = 'http'").select("service", "document", "op", "kind", "k").dropDuplicates(["service", "document", "op"])
    answers = api["answers"].join(first, [*DOC, "op"])
    good = F.col("status").rlike(r"(?i)^2(\d\d|XX)$")
    roots = [
        ops.filter("body is not null").select(*head, F.when(F.col("kind") == "http", "request").otherwise("message").alias("part"), none.alias("status"), F.when(F.col("kind") == "http", "body").otherwise("payload").alias("prefix"), F.col("body").alias("ref")),
        answers.filter(good & F.col("type").isNotNull()).select(*head, F.lit("response").alias("part"), "status", F.lit("").alias("prefix"), F.col("type").alias("ref")),
    ]
    roots = reduce(DataFrame.unionByName, roots).withColumn("key", F.struct("document", "kind", "op", "part", "status", "prefix"))
    flat = flat_fields(api["types"], api["fields"], roots)
    flat = flat.select("key.*", F.concat(F.col("key.prefix"), F.when(F.col("key.prefix") == "", "").otherwise("."), "path").alias("field"), "type", "optional").drop("prefix")
    told = answers.select(*head, *full("success", none, F.col("status"), none, no)).filter(F.col("field").rlike(r"(?i)^2(\d\d|XX)$"))
    failed = answers.filter(~good).select(*head, *full("failure", none, F.col("status"), F.col("description"), no))
    params = api["parameters"].filter("place <> 'path'").join(first, [*DOC, "op"]).select(*head, *full("request", none, F.concat_ws(".", "place", "name"), F.col("type"), F.col("optional")))
    return out, flat.unionByName(told).unionByName(failed).unionByName(params).distinct()


def api_graph(api: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that the documents declare: entries and their methods, producers, consumers and channels; all `declared`."""
    o = api["operations"]
    entry = F.when(F.col("kind") == "http", F.concat(F.lit("entry:"), "service", F.lit(":http:"), "method", F.lit(":"), "path")).otherwise(F.concat(F.lit("entry:"), "service", F.lit(":event:"), "channel"))
    method, channel = F.concat(F.col("service"), F.lit(":"), "document", F.lit("#"), "op"), F.concat(F.lit("channel:"), "channel")
    end = F.concat(F.when(F.col("kind") == "send", "producer:").otherwise("consumer:"), method)
    none = F.lit(None).cast("string")
    node = lambda df, i, kind, sub, label: df.select(i.alias("id"), F.lit(kind).alias("type"), sub.alias("kind"), label.alias("label"), "service")
    http, send, take = (o.filter(F.col("kind") == k) for k in ("http", "send", "receive"))
    nodes = [
        node(http, entry, "entry", F.lit("http"), F.concat_ws(" ", "method", "path")), node(take, entry, "entry", F.lit("event"), F.concat_ws(" ", F.lit("event"), "channel")),
        node(o, method, "method", none, F.col("op")), node(send, end, "producer", F.lit("message"), F.concat_ws(" ", F.lit("message"), "channel")),
        node(take, end, "consumer", F.lit("message"), F.col("op")), node(send.unionByName(take), channel, "channel", none, F.col("channel")),
    ]
    edge = lambda df, a, b, kind, ref, back: df.select(a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("type"), F.lit("declared").alias("confidence"), ref.alias("param"), back.alias("returns"))
    body = F.col("body")
    edges = [
        edge(http, entry, method, "handles", body, F.col("returns")), edge(send, method, end, "calls", none, none), edge(send, end, channel, "emits", body, none),
        edge(take, entry, method, "handles", body, none), edge(take, end, method, "handles", none, none), edge(take, channel, end, "consumes", none, none),
    ]
    return reduce(DataFrame.unionByName, nodes).dropDuplicates(["id"]), reduce(DataFrame.unionByName, edges).dropDuplicates(["from_id", "to_id", "type"])
