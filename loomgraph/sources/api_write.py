"""OpenAPI 3.1 and AsyncAPI 3.0 documents written from tables: schemas, operations, paths and documents put together bottom-up.

Every object of a document is text that one grouping joins from its members, in order of keys: fields make schemas, parameters and
answers make operations, operations make paths. A service's paths, channels and schemas are dealt to as many documents as it takes
for about `most` of them each, by a hash, so none is larger for a service that has a third of all operations; the reader takes all
documents of a service together. A schema is written once and referred to, so a ring of types ends there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.typerefs import PLAIN, schema_batch
from ..store import importable, materialise, sized

# Versions written, verbs, how deep named types are followed from an operation, and what sends no body.
OPENAPI, ASYNCAPI, DEPTH = "3.1.0", "3.0.0", 8
VERBS = ("GET", "PUT", "POST", "DELETE", "OPTIONS", "HEAD", "PATCH")
NOTHING = ("void", "undefined", "never")
TYPE_IDS = r"(type:[^\s|&<>()\[\]{},;]+)"
#: A hole of a path as frameworks write one, and the name in it.
HOLES = (r"^:([A-Za-z_$][\w$]*)\??$", r"^\{([A-Za-z_$][\w$]*)\+?\}$", r"^\[(?:\.\.\.)?([A-Za-z_$][\w$]*)\]$", r"^<([A-Za-z_$][\w$]*)>$")


def quoted(c: Column) -> Column:
    """A string as JSON; null for null."""
    t = F.to_json(F.array(c))
    return F.when(c.isNotNull(), t.substr(F.lit(2), F.length(t) - 2))


def member(name: str, json: Column) -> Column:
    """`"name":json`, or null where there is no json; for object()."""
    return F.concat(F.lit(f'"{name}":'), json)


def obj(*members: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*members)), ","), F.lit("}"))


def gathered(key: str, json: str) -> Column:
    """An object of a group's rows, in order of keys; one row a key."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, json))), lambda x: F.concat(quoted(x[key]), F.lit(":"), x[json])), ","), F.lit("}"))


def used_types(roots: DataFrame, types: DataFrame, fields: DataFrame, depth: int = DEPTH) -> DataFrame:
    """roots (service, ref) -> (service, id, level): the types that a service's operations come to, and after how many steps.

    One join for each step over what came last; types first reached at depth + 1 are told, to be written as too deep.
    """
    ids = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(TYPE_IDS), 1)))
    links = fields.select("id", ids(F.col("type")).alias("to")).unionByName(types.filter("alias is not null").select("id", ids(F.col("alias")).alias("to"))).distinct()
    links = materialise(links, "links")  # steps read them again and again
    left = roots.select("service", ids(F.col("ref")).alias("id")).distinct()
    seen = materialise(left.withColumn("level", F.lit(1)), "used")
    left = seen
    for level in range(2, depth + 2):
        new = left.join(links, "id").select("service", F.col("to").alias("id")).distinct().join(seen, ["service", "id"], "left_anti")
        left = materialise(new.withColumn("level", F.lit(level)), "used")
        if left.isEmpty():
            break
        seen = seen.unionByName(left)
    return seen


def component_names(used: DataFrame, types: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(service, id, name): the component of each type in a service's documents, or "!" and the reason why it has none."""
    met = used.join(types.select("id", "kind", F.col("name").alias("own"), "alias"), "id", "left")
    why = (
        F.when(F.col("kind").isNull(), "!type-not-found").when(F.col("kind") == "external", "!external-type")
        .when((F.col("kind") == "unknown") & F.col("alias").isNull(), "!type-unread").when(F.col("level") > depth, "!too-deep")
    )
    clean = F.regexp_replace(F.regexp_replace("own", r"[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    met = met.withColumn("why", why).withColumn("base", F.when(F.col("why").isNull(), F.when(clean == "", "Shape").otherwise(clean)))
    n = F.row_number().over(Window.partitionBy("service", "base").orderBy("id"))
    named = met.filter("why is null").withColumn("n", n)
    return named.select("service", "id", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", "n")).alias("name")).unionByName(met.filter("why is not null").select("service", "id", F.col("why").alias("name")))


def schema_texts(refs: DataFrame, names: DataFrame) -> DataFrame:
    """refs (service, ref), each once -> (service, ref, schema) as JSON."""
    importable(refs.sparkSession)
    ids = refs.select("service", "ref", F.explode_outer(F.array_distinct(F.regexp_extract_all("ref", F.lit(TYPE_IDS), 1))).alias("id"))
    met = ids.join(names, ["service", "id"], "left").groupBy("service", "ref")
    # a reference names a handful of types
    pairs = met.agg(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("id", F.coalesce("name", F.lit("!type-not-found")).alias("name"))))).alias("p"))
    render = F.pandas_udf(schema_batch, "string")
    return pairs.select("service", "ref", render("ref", F.transform("p", lambda x: x["id"]), F.transform("p", lambda x: x["name"])).alias("schema"))


def component_texts(names: DataFrame, types: DataFrame, fields: DataFrame, schemas: DataFrame) -> DataFrame:
    """(service, name, json) of the components: objects with their fields, enums, and aliases as what they stand for."""
    kept = names.filter("not startswith(name, '!')").select("service", "id", "name")
    own = kept.join(fields.select("id", F.col("name").alias("field"), F.col("type").alias("ref"), "optional"), "id")
    loose = F.col("optional") | F.exists(F.split("ref", r"\s*\|\s*"), lambda x: x == "undefined")
    sent = ~F.col("ref").isin("undefined", "void")
    own = own.filter(sent).join(schemas, ["service", "ref"]).withColumn("need", ~loose)
    by = own.groupBy("service", "id").agg(gathered("field", "schema").alias("properties"), F.array_sort(F.collect_list(F.when(F.col("need"), F.col("field")))).alias("required"))
    # numbers stay numbers only where all members are
    plain = F.transform("members", lambda m: F.when(m.rlike("^'.*'$"), F.replace(m.substr(F.lit(2), F.length(m) - 2), F.lit("\\'"), F.lit("'"))).otherwise(m))
    numeric = F.forall(plain, lambda m: m.rlike(r"^-?\d+(\.\d+)?$")) & (F.size("members") > 0)
    values = F.when(numeric, F.array_join(plain, ",")).otherwise(F.array_join(F.transform(plain, quoted), ","))
    enum = obj(member("type", F.when(numeric, F.lit('"number"')).otherwise(F.lit('"string"'))), member("enum", F.concat(F.lit("["), values, F.lit("]"))))
    t = kept.join(types.select("id", "kind", "members", F.col("alias").alias("ref")), "id").join(by, ["service", "id"], "left").join(schemas, ["service", "ref"], "left")
    need = F.when(F.size("required") > 0, F.to_json("required"))
    whole = obj(member("type", F.lit('"object"')), member("properties", F.coalesce("properties", F.lit("{}"))), member("required", need))
    return t.select("service", "name", F.when(F.col("kind") == "enum", enum).when(F.col("kind") == "unknown", F.col("schema")).otherwise(whole).alias("json"))


def path_template(path: Column, raw: Column, declared: Column) -> Column:
    """struct<path, names>: the holes by the names in the raw path, else by the declared ones in order, else numbered; a name twice
    gets a number."""
    segs, raws = S.segments(path), S.segments(F.coalesce(raw, F.lit("")))
    alike = F.size(raws) == F.size(segs)
    both = F.zip_with(segs, F.when(alike, raws).otherwise(F.transform(segs, lambda s: F.lit(""))), lambda s, r: F.struct(s.alias("s"), r.alias("r")))
    holes = F.transform(F.filter(both, lambda x: x["s"] == S.PARAM), lambda x: reduce(lambda c, p: F.when(x["r"].rlike(p), F.regexp_extract(x["r"], p, 1)).otherwise(c), HOLES, F.lit(None).cast("string")))
    named = F.transform(holes, lambda h, i: F.coalesce(h, F.get(declared, i), F.concat(F.lit("param"), (i + 1).cast("string"))))
    return F.transform(named, lambda n, i: F.concat(n, F.when(F.array_position(named, n) <= i, (F.size(F.filter(F.slice(named, 1, i + 1), lambda m: m == n))).cast("string")).otherwise("")))


def dealt(df: DataFrame, key: str, counts: DataFrame, out: str) -> DataFrame:
    """df with the number of the document that a row's key goes to, of as many as the service has by `counts` (service, parts)."""
    return df.join(counts, "service").withColumn(out, F.pmod(F.xxhash64(key), F.col("parts")).cast("int")).drop("parts")


def parts_of(df: DataFrame, most: int) -> DataFrame:
    n = materialise(df.groupBy("service").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")), "parts")
    return sized(n, n.count(), 64)


def content(schema: Column) -> Column:
    return F.concat(F.lit('{"application/json":{"schema":'), schema, F.lit("}}"))


def write_api(api: dict[str, DataFrame], most: int = 200, depth: int = DEPTH) -> DataFrame:
    """(service, document, form openapi|asyncapi, text) from tables as `read_api` gives them; one JSON text a document.

    api may also have guards (service, op, name). Of operations with one method and path (or, of one service, one name) the least
    is written. Verbs that documents don't have are left to `unwritten`. A service without operations has no document. Names of
    operations may be null, and a null reference is a body or an answer nobody has read: an answer of unknown shape, no body.
    """
    types, fields = materialise(api["types"].dropDuplicates(["id"]), "types"), materialise(api["fields"].dropDuplicates(["id", "name"]), "fields")
    ops = api["operations"]
    params = api["parameters"].dropDuplicates(["service", "op", "place", "name"])
    answers = api["answers"].dropDuplicates(["service", "op", "status"])
    refs = reduce(DataFrame.union, [ops.select("service", "body"), ops.select("service", "returns"), params.select("service", "type"), answers.select("service", "type")]).toDF("service", "ref").filter("ref is not null").distinct()
    names = materialise(component_names(used_types(refs, types, fields, depth), types, depth), "names")
    inside = names.filter("not startswith(name, '!')").select("service", "id")
    below = inside.join(fields.select("id", F.col("type").alias("ref")), "id").select("service", "ref").union(inside.join(types.filter("alias is not null").select("id", F.col("alias").alias("ref")), "id").select("service", "ref"))
    schemas = materialise(schema_texts(refs.union(below).distinct(), names), "schemas")
    components = materialise(component_texts(names, types, fields, schemas), "components")
    as_schema = lambda name, out: schemas.select("service", F.col("ref").alias(name), F.col("schema").alias(out))

    http = ops.filter((F.col("kind") == "http") & F.col("method").isin(*VERBS) & S.was_read(F.col("path")))
    http = http.groupBy("service", "method", "path").agg(F.min(F.struct("op", "raw_path", "summary", "body", "returns")).alias("x")).select("service", "method", "path", "x.*")
    told = params.filter("place = 'path'").groupBy("service", "op").agg(F.sort_array(F.collect_list("name")).alias("declared"))
    http = http.join(told, ["service", "op"], "left")
    http = http.withColumn("holes", path_template(F.col("path"), F.col("raw_path"), F.col("declared")))
    # the holes' names take the places of the holes, one after another
    filled = F.aggregate(S.segments(F.col("path")), F.struct(F.lit("").alias("t"), F.lit(0).alias("n")), lambda a, s: F.struct(F.concat(a["t"], F.lit("/"), F.when(s == S.PARAM, F.concat(F.lit("{"), F.get(F.col("holes"), a["n"]), F.lit("}"))).otherwise(s)).alias("t"), (a["n"] + (s == S.PARAM).cast("int")).alias("n")))["t"]
    http = materialise(http.withColumn("template", F.when(filled == "", "/").otherwise(filled)), "routes")

    holes = http.select("service", "op", F.posexplode("holes").alias("i", "name")).join(params.filter("place = 'path'").select("service", "op", "name", "type"), ["service", "op", "name"], "left")
    holes = holes.select("service", "op", F.lit("path").alias("place"), F.col("i"), "name", F.coalesce("type", F.lit("string")).alias("type"), F.lit(False).alias("optional"))
    rest = params.filter("place <> 'path'").select("service", "op", "place", F.lit(0).alias("i"), "name", "type", "optional")
    one = obj(member("name", quoted(F.col("name"))), member("in", quoted(F.col("place"))), member("required", (~F.col("optional")).cast("string")), member("schema", F.col("schema")))
    listed = holes.unionByName(rest).join(schemas.withColumnRenamed("ref", "type"), ["service", "type"], "left").withColumn("schema", F.coalesce("schema", F.lit(f'{{"type":"{PLAIN["string"]["type"]}"}}')))
    listed = listed.withColumn("order", F.when(F.col("place") == "path", 0).when(F.col("place") == "query", 1).otherwise(2)).groupBy("service", "op")
    listed = listed.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "i", "name", one.alias("json")))), lambda x: x["json"]), ","), F.lit("]")).alias("parameters"))

    good = F.col("status").rlike(r"(?i)^2(\d\d|XX)$")
    has = answers.filter(good).select("service", "op").distinct().withColumn("has", F.lit(True))
    said = F.when(F.col("returns").isNull(), "Success; what it answers was not read").when(F.col("returns").isin(*NOTHING), "Success, with no body").otherwise("Success")
    plain = http.join(has, ["service", "op"], "left").filter("has is null").select("service", "op", F.lit("2XX").alias("status"), said.alias("description"), F.col("returns").alias("type"))
    every = answers.select("service", "op", "status", "description", "type").unionByName(plain).join(as_schema("type", "schema"), ["service", "type"], "left")
    shown = F.when(~F.col("type").isin(*NOTHING), content(F.col("schema")))
    # an answer nobody has read says so, unless its document says that it has none
    json = obj(member("description", quoted(F.coalesce("description", F.lit("")))), member("content", shown), F.when(F.col("description").startswith("Success; what"), F.lit('"x-unread":"answer-unread"')))
    responses = every.withColumn("json", json).groupBy("service", "op").agg(gathered("status", "json").alias("responses"))

    parts = http.join(listed, ["service", "op"], "left").join(responses, ["service", "op"], "left").join(as_schema("body", "body_schema"), ["service", "body"], "left")
    guards = F.lit(None).cast("string")
    if "guards" in api:
        g = api["guards"].groupBy("service", "op").agg(F.array_sort(F.collect_set("name")).alias("g"))
        parts, guards = parts.join(g, ["service", "op"], "left"), F.when(F.size("g") > 0, F.to_json("g"))
    body = F.when(~F.col("body").isin(*NOTHING), F.concat(F.lit('{"required":true,"content":'), content(F.col("body_schema")), F.lit("}")))
    operation = obj(
        member("operationId", quoted(F.col("op"))), member("summary", quoted(F.col("summary"))), member("parameters", F.col("parameters")), member("requestBody", body),
        member("responses", F.coalesce("responses", F.lit("{}"))), member("x-guards", guards),
    )
    items = parts.select("service", "template", F.lower("method").alias("verb"), operation.alias("json")).groupBy("service", "template").agg(gathered("verb", "json").alias("json"))
    items = materialise(items, "paths")
    paths = dealt(items, "template", parts_of(items, most), "part").groupBy("service", "part").agg(gathered("template", "json").alias("paths"))
    return _documents("openapi", paths, components, most).unionByName(_documents("asyncapi", _events(ops, as_schema("body", "payload"), most), components, most))


def _events(ops: DataFrame, payloads: DataFrame, most: int) -> DataFrame:
    """(service, part, channels, operations, messages): a channel with all its ends goes to one document."""
    ends = ops.filter(F.col("kind").isin("send", "receive") & F.col("channel").isNotNull()).select("service", "op", "kind", "channel", "body").distinct()
    clean = F.regexp_replace(F.regexp_replace("channel", r"[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    channels = ends.select("service", "channel").distinct().withColumn("base", F.when(clean == "", "channel").otherwise(clean))
    n = F.row_number().over(Window.partitionBy("service", "base").orderBy("channel"))
    numbered = lambda base: F.when(F.col("n") == 1, F.col(base)).otherwise(F.concat_ws("_", base, "n"))
    channels = channels.withColumn("n", n).select("service", "channel", numbered("base").alias("channel_key"))
    keyed = ends.join(channels, ["service", "channel"]).withColumn("base", F.concat_ws(".", "kind", "channel_key"))
    keyed = keyed.withColumn("n", F.row_number().over(Window.partitionBy("service", "base").orderBy("op", "body"))).withColumn("key", numbered("base"))
    keyed = materialise(keyed.join(payloads, ["service", "body"], "left"), "ends")
    ref = lambda *x: F.concat(F.lit('{"$ref":'), quoted(F.concat(*x)), F.lit("}"))
    message = obj(member("name", quoted(F.col("key"))), member("payload", F.col("payload")), F.when(F.col("payload").isNull(), F.lit('"x-unread":"payload-unread"')))
    at = ref(F.lit("#/channels/"), F.col("channel_key"), F.lit("/messages/"), F.col("key"))
    operation = obj(member("action", quoted(F.col("kind"))), member("channel", ref(F.lit("#/channels/"), F.col("channel_key"))), member("messages", F.concat(F.lit("["), at, F.lit("]"))), member("summary", quoted(F.col("op"))))
    rows = keyed.select("service", "channel", "channel_key", "key", message.alias("message"), operation.alias("operation"), ref(F.lit("#/components/messages/"), F.col("key")).alias("ref"))
    by = rows.groupBy("service", "channel_key").agg(obj(member("address", quoted(F.min("channel"))), member("messages", gathered("key", "ref"))).alias("json"))
    counts = parts_of(by, most)
    own = dealt(by, "channel_key", counts, "part").groupBy("service", "part").agg(gathered("channel_key", "json").alias("channels"))
    rest = dealt(rows, "channel_key", counts, "part").groupBy("service", "part").agg(gathered("key", "operation").alias("operations"), gathered("key", "message").alias("messages"))
    return own.join(rest, ["service", "part"])


def _documents(form: str, bodies: DataFrame, components: DataFrame, most: int) -> DataFrame:
    """Documents of one form: each part's body, and the schemas in the same document where a service has one part of either, else
    in documents of their own."""
    bodies = materialise(bodies, "bodies")
    with_body = bodies.groupBy("service").agg(F.count("*").alias("n"))
    own = components.join(with_body.select("service"), "service", "left_semi")
    counts = parts_of(own, most)
    schemas = materialise(dealt(own, "name", counts, "part").groupBy("service", "part").agg(gathered("name", "json").alias("schemas")), "schemas")
    alone = with_body.join(schemas.groupBy("service").agg(F.count("*").alias("m")), "service", "left").filter("n = 1 and coalesce(m, 1) = 1").select("service", F.lit(True).alias("alone"))
    head = F.concat(F.lit('{"title":'), quoted(F.col("service")), F.lit(',"version":"0"}'))
    within = schemas.join(alone, "service", "left_semi").select("service", "schemas")
    together = bodies.join(alone, "service", "left").join(within, "service", "left")
    name = F.when(F.col("alone"), F.lit(f"{form}.json")).otherwise(F.concat(F.lit(f"{form}-"), "part", F.lit(".json")))
    if form == "openapi":
        text = obj(member("openapi", F.lit(f'"{OPENAPI}"')), member("info", head), member("paths", F.col("paths")), member("components", obj(member("schemas", F.col("schemas")))))
    else:
        text = obj(member("asyncapi", F.lit(f'"{ASYNCAPI}"')), member("info", head), member("channels", F.col("channels")), member("operations", F.col("operations")), member("components", obj(member("messages", F.col("messages")), member("schemas", F.col("schemas")))))
    first = together.select("service", name.alias("document"), F.lit(form).alias("form"), text.alias("text"))
    kind = obj(member(form, F.lit(f'"{OPENAPI if form == "openapi" else ASYNCAPI}"')), member("info", head), member("paths" if form == "openapi" else "channels", F.lit("{}")), member("components", obj(member("schemas", F.col("schemas")))))
    apart = schemas.join(alone, "service", "left_anti").select("service", F.concat(F.lit(f"{form}-schemas-"), "part", F.lit(".json")).alias("document"), F.lit(form).alias("form"), kind.alias("text"))
    return first.unionByName(apart)


def unwritten(api: dict[str, DataFrame]) -> DataFrame:
    """(service, reason, n): routes that no document has: path-unread, any-verb, duplicate-route."""
    o = api["operations"].filter("kind = 'http'")
    why = F.when(F.col("path").isNull() | F.col("method").isNull() | ~S.was_read(F.col("path")), "path-unread").when(~F.col("method").isin(*VERBS), "any-verb")
    o = o.withColumn("reason", why)
    more = o.filter("reason is null").groupBy("service", "method", "path").agg((F.count("*") - 1).alias("n")).filter("n > 0").groupBy("service").agg(F.sum("n").alias("n"))
    return o.filter("reason is not null").groupBy("service", "reason").agg(F.count("*").alias("n")).unionByName(more.select("service", F.lit("duplicate-route").alias("reason"), "n"))


def save_documents(documents: DataFrame, path: str) -> None:
    """A JSON line for each document, in a folder a service."""
    documents.write.mode("overwrite").partitionBy("service").json(path)


def saved_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("document string, form string, text string, service string").json(path)
