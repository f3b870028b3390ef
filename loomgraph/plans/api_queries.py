"""API documents read and written: every page is an operation of its host, or an end of one of its host's channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import specs as P
from ..sources import api_read as R
from ..sources import api_write as W
from ..sources import views as V
from .registry import query

#: A page as a route: secure ones take a body; what is asked after "?" are its parameters; every fifth has no name of its own.
FACTS_SQL = r"""facts as (
  select *, case when page_id % 5 > 0 then 'get ' || lang || ' ' || page_id else method || ' ' || path end as op from (
    select *, case when secure then 'POST' else 'GET' end as method, regexp_replace(regexp_replace(raw, '/{2,}', '/', 'g'), '\{n\}', ':param') as path from (
      select page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as service, 'd' || (page_id // 400) as document, starts_with(url, 'https') as secure,
        regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) || '/' || page_id || '/{n}' as raw, split_part(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/', 2) as lang,
        list_distinct(list_transform(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: split_part(x, '=', 1))) as asked
      from pages))
), shaped as (
  select *, array_to_string(list_transform(list_filter(regexp_split_to_array(op, '[^A-Za-z0-9]+'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), '') as shape from facts
)"""
FACTS = FACTS_SQL.replace("\n", " ")
BODY_SQL = "case when secure then 'type:' || service || '#' || shape || 'Body' end"
RETURNS_SQL = "case when secure then 'type:' || service || '#Base[]' when len(asked) > 0 then 'string | type:' || service || '#Base' else 'unknown' end"
#: Fields of the types: the shared one of each service, and of each body and what it holds.
FIELDS_SQL = """
  select distinct 'type:' || service || '#Base' as id, unnest(['n', 'next']) as name, unnest(['number', 'type:' || service || '#Base']) as type, true as optional from facts
  union all select 'type:' || service || '#' || shape || 'Body', unnest(['at', 'id', 'lang', 'size']), unnest(['string | null', 'number', '''' || lang || ''' | ''xx''', 'type:' || service || '#' || shape || 'BodySize']), unnest([true, false, true, true]) from shaped where secure
  union all select 'type:' || service || '#' || shape || 'BodySize', 'html', 'number', true from shaped where secure"""


def facts(s, d):
    url = F.col("url")
    p = F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    f = V.read(s, d, "pages").select(
        "page_id", F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1).alias("service"), F.concat(F.lit("d"), F.expr("page_id div 400")).alias("document"), url.startswith("https").alias("secure"),
        F.concat(p, F.lit("/"), "page_id", F.lit("/{n}")).alias("raw"), F.split_part(p, F.lit("/"), F.lit(2)).alias("lang"),
        F.array_distinct(F.transform(F.filter(F.split(F.regexp_extract(url, "[?]([^#]*)", 1), "&"), lambda x: x != ""), lambda x: F.substring_index(x, "=", 1))).alias("asked"),
    )
    return f.withColumn("method", F.when(F.col("secure"), "POST").otherwise("GET"))


def filled(template: str, **values):
    """The template with each @name@ replaced by a column; templates are JSON, so they have braces of their own."""
    parts = template.split("@")
    return F.concat(*[F.lit(x) if i % 2 == 0 else values[x] for i, x in enumerate(parts)])


BODY = '{"content":{"text/plain":{},"application/json":{"schema":{"type":"object","required":["id"],"properties":{"id":{"type":"integer"},"lang":{"enum":["@lang@","xx"]},"at":{"type":["string","null"]},"size":{"type":"object","properties":{"html":{"type":"number"}}}}}}}}'
ANSWERS = {
    "secure": '{"type":"array","items":{"$ref":"#/components/schemas/Base"}}',
    "asked": '{"oneOf":[{"type":"string"},{"$ref":"#/components/schemas/Base"}]}',
    "else": '{"$ref":"https://elsewhere.example.org/schemas.json#/Other"}',
}
BASE = '{"Base":{"type":"object","properties":{"next":{"$ref":"#/components/schemas/Base"},"n":{"type":"number"}}}}'


def documents(s, d):
    """Documents of at most 400 routes as their writers would have them; one in seven is cut short and one of an older version."""
    f = facts(s, d)
    answer = F.when(F.col("secure"), ANSWERS["secure"]).when(F.size("asked") > 0, ANSWERS["asked"]).otherwise(ANSWERS["else"])
    named = F.when(F.col("page_id") % 5 > 0, filled('"operationId":" get @lang@ @id@ ",', lang=F.col("lang"), id=F.col("page_id").cast("string"))).otherwise("")
    params = F.array_join(F.transform("asked", lambda a: filled(',{"in":"query","name":"@a@","schema":{"type":"string"}}', a=a)), "")
    body = F.when(F.col("secure"), F.concat(F.lit('"requestBody":'), filled(BODY, lang=F.col("lang")), F.lit(","))).otherwise("")
    op = filled(
        '"@raw@":{"@verb@":{@named@@body@"parameters":[{"in":"path","name":"n","required":true,"schema":{"type":"integer"}}@params@],"responses":{"404":{"description":"gone"},"200":{"description":"ok","content":{"application/json":{"schema":@answer@}}}}},"x-note":1}',
        raw=F.col("raw"), verb=F.lower("method"), named=named, body=body, params=params, answer=answer,
    )
    by = f.withColumn("o", op).groupBy("service", "document").agg(F.array_join(F.sort_array(F.collect_list("o")), ",").alias("o"))  # at most 400
    whole = F.concat(F.lit('{"openapi":"3.0.3","info":{"title":"t","version":"1"},"paths":{'), "o", F.lit('},"components":{"schemas":'), F.lit(BASE), F.lit("}}"))
    broken = F.length("service") % 7
    return by.select("service", "document", F.when(broken == 1, F.left(whole, F.length(whole) - 9)).when(broken == 2, F.replace(whole, F.lit('"openapi":"3.0.3"'), F.lit('"swagger":"2.0"'))).otherwise(whole).alias("text"))


READ = f"with {FACTS_SQL.replace('from pages', 'from pages where length(regexp_extract(url, ' + chr(39) + '^[a-z]+://([^/?#]+)' + chr(39) + ', 1)) % 7 not in (1, 2)')} "


@query("src_21_openapi_operations", READ + f"select service, document, op, method, path, raw as raw_path, {BODY_SQL} as body, {RETURNS_SQL} as returns from shaped")
def openapi_operations(s, d):
    return R.read_api(documents(s, d))["operations"].select("service", "document", "op", "method", "path", "raw_path", "body", "returns")


@query("src_21_openapi_fields", READ + FIELDS_SQL)
def openapi_fields(s, d):
    return R.read_api(documents(s, d))["fields"].select("id", "name", "type", "optional")


@query("src_21_openapi_problems", r"select distinct regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as service, 'd' || (page_id // 400) as document, case length(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) % 7 when 1 then 'not JSON' else 'convert it to version 3 first' end as problem from pages where length(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) % 7 in (1, 2)")
def openapi_problems(s, d):
    return R.read_api(documents(s, d))["problems"].select("service", "document", "problem")


PARTS_SQL = """
  select service as document, method || ' ' || path as op, 'request' as part, null as status, unnest(['body.at', 'body.id', 'body.lang', 'body.size', 'body.size.html']) as field,
    unnest(['string | null', 'number', '''' || lang || ''' | ''xx''', 'type:' || service || '#' || shape || 'BodySize', 'number']) as type, unnest([true, false, true, true, true]) as optional from shaped where secure
  union all select service, method || ' ' || path, 'request', null, 'query.' || unnest(asked), 'string', true from facts
  union all select service, method || ' ' || path, unnest(['success', 'failure']), null, unnest(['200', '404']), unnest([null, 'gone']), false from facts"""


@query("src_21_openapi_parts", READ + PARTS_SQL)
def openapi_parts(s, d):
    return R.spec_tables(R.read_api(documents(s, d)))[1].drop("kind")


@query(
    "src_21_declared_changes",
    READ + """select service as document, method || ' ' || path as op, field, change, case when change in ('request-property-removed') then 'warning' when change = 'optional-property-added' then 'info' else 'warning' end as level from (
      select service, method, path, 'body.lang' as field, 'request-property-type-changed' as change from facts where secure and lang <> 'yy'
      union all select service, method, path, 'query.' || unnest(asked), 'request-property-removed' from facts)""",
)
def declared_changes(s, d):
    """A revision of all documents in which no route asks for anything and languages are others, compared with them by the readers' tables."""
    docs = documents(s, d)
    later = F.regexp_replace(F.regexp_replace("text", r',\{"in":"query","name":"[^"]*","schema":\{"type":"string"\}\}', ""), r'\{"enum":\["[^"]*","xx"\]\}', '{"enum":["yy","xx"]}')
    base, head = (R.spec_tables(R.read_api(x)) for x in (docs, docs.withColumn("text", later)))
    return P.spec_changes(base[0], head[0], base[1], head[1]).select("document", "op", "field", "change", "level")


ENDS_SQL = r"""ends as (
  select page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as service, 'd' || (page_id // 400) as document, split_part(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/', 2) as lang, starts_with(url, 'https') as secure, contains(url, '#') as marked from pages
)"""


def ends(s, d):
    url = F.col("url")
    return V.read(s, d, "pages").select(
        "page_id", F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1).alias("service"), F.concat(F.lit("d"), F.expr("page_id div 400")).alias("document"), url.contains("#").alias("marked"),
        F.split_part(F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1), F.lit("/"), F.lit(2)).alias("lang"), url.startswith("https").alias("secure"),
    )


def event_documents(s, d):
    """Version 3 documents: an operation a page, its message behind two references; those of marked pages lead nowhere, and of every
    eleventh page in a ring. Hosts whose name's length is even have version 2 instead."""
    e = ends(s, d)
    v = dict(id=F.col("page_id").cast("string"), lang=F.col("lang"), action=F.when(F.col("secure"), "send").otherwise("receive"), word=F.when(F.col("secure"), "subscribe").otherwise("publish"))
    payload = '{"type":"object","required":["id"],"properties":{"id":{"type":"number"},"@lang@":{"type":"boolean"}}}'
    link = F.when(F.col("marked"), filled('{"$ref":"#/components/messages/none@id@"}', **v)).when(F.col("page_id") % 11 == 0, filled('{"$ref":"#/channels/@lang@~1@id@/messages/m"}', **v)).otherwise(filled('{"$ref":"#/components/messages/m@id@"}', **v))
    channel = F.concat(filled('"@lang@/@id@":{"address":"@lang@.@id@","messages":{"m":', **v), link, F.lit("}}"))
    op = filled('"op@id@":{"action":"@action@","channel":{"$ref":"#/channels/@lang@~1@id@"},"messages":[{"$ref":"#/channels/@lang@~1@id@/messages/m"}]}', **v)
    message = filled(f'"m@id@":{{"payload":{payload}}}', **v)
    older = filled(f'"@lang@.@id@":{{"@word@":{{"operationId":"op@id@","message":{{"payload":{payload}}}}},"description":"d"}}', **v)
    some = lambda c: F.array_join(F.sort_array(F.collect_list(c)), ",")  # noqa: E731  (at most 400)
    by = e.withColumns({"c": channel, "o": op, "m": message, "older": older}).groupBy("service", "document").agg(*[some(x).alias(x) for x in ("c", "o", "m", "older")])
    new = filled('{"asyncapi":"3.0.0","channels":{@c@},"operations":{@o@},"components":{"messages":{@m@}}}', c=F.col("c"), o=F.col("o"), m=F.col("m"))
    return by.select("service", "document", F.when(F.length("service") % 2 == 0, filled('{"asyncapi":"2.6.0","channels":{@older@}}', older=F.col("older"))).otherwise(new).alias("text"))


@query("src_21_asyncapi_ends", f"with {ENDS_SQL} select service, document, 'op' || page_id as op, case when secure then 'send' else 'receive' end as kind, lang || '.' || page_id as channel, case when length(service) % 2 = 0 or not (marked or page_id % 11 = 0) then 'type:' || service || '#Op' || page_id || 'Payload' end as body from ends")
def asyncapi_ends(s, d):
    return R.read_api(event_documents(s, d))["operations"].select("service", "document", "op", "kind", "channel", "body")


@query("src_21_asyncapi_links", f"with {ENDS_SQL} select service, '[\"op' || page_id || '\",\"' || lang || '/' || page_id || '\"]' as key, case when marked then 'message dangling' else 'message ring' end as problem from ends where length(service) % 2 = 1 and (marked or page_id % 11 = 0)")
def asyncapi_links(s, d):
    """References between messages that lead nowhere or in a ring are told, not dropped."""
    return R.read_api(event_documents(s, d))["problems"].select("service", "key", "problem")


@query("src_21_declared_graph", f"with {ENDS_SQL} select service, type, count(*) as n from (select service, unnest(case when secure then ['calls', 'emits'] else ['handles', 'handles', 'consumes'] end) as type from ends) group by 1, 2")
def declared_graph(s, d):
    """The edges that documents of events declare, by the service of their operation."""
    _, e = R.api_graph(R.read_api(event_documents(s, d)))
    own = F.when(F.col("type") == "handles", F.when(F.col("from_id").startswith("entry:"), F.col("from_id")).otherwise(F.col("to_id"))).when(F.col("type").isin("emits",), F.col("from_id")).otherwise(F.col("to_id"))
    host = F.regexp_extract(own, r"^(?:entry:|producer:|consumer:)?([^:]+):", 1)
    return e.select(host.alias("service"), "type").groupBy("service", "type").agg(F.count("*").alias("n"))


def written_tables(s, d):
    """The facts as the tables that documents are written from."""
    f = facts(s, d)
    op = F.concat_ws(" ", F.lit("get"), "lang", "page_id")
    f = f.withColumns({"op": op, "body_type": F.concat(F.lit("type:"), "service", F.lit("#In"), "page_id"), "base": F.concat(F.lit("type:"), "service", F.lit("#Base")), "path": F.regexp_replace(F.regexp_replace("raw", "/{2,}", "/"), r"\{n\}", ":param")})
    none = F.lit(None).cast("string")
    returns = F.when(F.col("secure"), F.concat("base", F.lit("[]"))).when(F.size("asked") > 0, F.concat(F.lit("string | "), "base", F.lit(" | null"))).when(F.col("page_id") % 3 == 0, F.concat(F.lit("Record<string, "), "base", F.lit(">"))).otherwise(F.lit("void"))
    ops = f.select("service", "document", "op", F.lit("http").alias("kind"), "method", "path", "raw", none.alias("channel"), none.alias("summary"), F.when(F.col("secure"), F.col("body_type")).alias("body"), returns.alias("returns")).withColumnRenamed("raw", "raw_path")
    params = f.select("service", "document", "op", F.lit("query").alias("place"), F.explode("asked").alias("name"), F.lit("string").alias("type"), F.lit(True).alias("optional"))
    params = params.unionByName(f.select("service", "document", "op", F.lit("path").alias("place"), F.lit("n").alias("name"), F.lit("number").alias("type"), F.lit(False).alias("optional")))
    answers = f.filter("page_id % 4 = 0").select("service", "document", "op", F.lit("404").alias("status"), F.lit('not "here"').alias("description"), none.alias("type"))
    secure = f.filter("secure")
    field = lambda df, i, n, t, o: df.select(i.alias("id"), F.lit(n).alias("name"), t.alias("type"), F.lit(o).alias("optional"))
    shared = f.select("service", "base").distinct()
    fields = [
        field(secure, F.col("body_type"), "at", F.lit("Date | undefined"), False), field(secure, F.col("body_type"), "lang", F.concat(F.lit("'"), "lang", F.lit("' | 'xx'")), False),
        field(secure, F.col("body_type"), "more", F.concat("base", F.lit("[]")), True), field(shared, F.col("base"), "next", F.col("base"), True), field(shared, F.col("base"), "n", F.lit("number"), False),
    ]
    rows = fields[0]
    for x in fields[1:]:
        rows = rows.unionByName(x)
    kind = lambda df, i, n: df.select(i.alias("id"), "service", n.alias("name"), F.lit("object").alias("kind"), F.lit(None).cast("array<string>").alias("members"), none.alias("alias"))
    types = kind(secure, F.col("body_type"), F.concat(F.lit("In"), "page_id")).unionByName(kind(shared, F.col("base"), F.lit("Base")))
    return {"operations": ops, "parameters": params, "answers": answers, "types": types, "fields": rows}


@query(
    "snk_04_openapi",
    f"""with {FACTS} select service, 'get ' || lang || ' ' || page_id as op, method, path, regexp_replace(raw, '/{{2,}}', '/', 'g') as raw_path, case when secure then 'type:' || service || '#In' || page_id end as body,
      case when secure then 'type:' || service || '#Base[]' when len(asked) > 0 then 'string | type:' || service || '#Base | null' when page_id % 3 = 0 then 'object' end as returns from facts""",
)
def openapi_written(s, d):
    """All routes written as documents of about 50 paths or schemas each, and read back."""
    return R.read_api(W.write_api(written_tables(s, d), most=50))["operations"].select("service", "op", "method", "path", "raw_path", "body", "returns")


@query(
    "snk_04_openapi_fields",
    f"""with {FACTS} select distinct 'type:' || service || '#Base' as id, unnest(['n', 'next']) as name, unnest(['number', 'type:' || service || '#Base']) as type, unnest([false, true]) as optional from facts where secure or len(asked) > 0 or page_id % 3 = 0
    union all select 'type:' || service || '#In' || page_id, unnest(['at', 'lang', 'more']), unnest(['string', '''' || lang || ''' | ''xx''', 'type:' || service || '#Base[]']), unnest([true, false, true]) from facts where secure""",
)
def openapi_written_fields(s, d):
    """Only types that some operation comes to are written; dates cross as strings, and a ring of types ends in a reference."""
    return R.read_api(W.write_api(written_tables(s, d), most=50))["fields"].select("id", "name", "type", "optional")


@query("snk_04_openapi_sizes", f"with {FACTS} select service, count(*) as paths, count(*) filter (secure) + max(case when secure or len(asked) > 0 or page_id % 3 = 0 then 1 else 0 end) as schemas from facts group by 1")
def openapi_sizes(s, d):
    """How many paths and schemas the documents of each service hold, by their own JSON."""
    w = W.write_api(written_tables(s, d), most=50).select("service", F.parse_json("text").alias("v"))
    n = lambda path: F.coalesce(F.size(F.map_keys(R.at(F.col("v"), path, "map<string,variant>"))), F.lit(0))
    return w.groupBy("service").agg(F.sum(n("$.paths")).alias("paths"), F.sum(n("$.components.schemas")).alias("schemas"))


@query(
    "snk_05_asyncapi",
    f"""with {ENDS_SQL} select service, 'op' || page_id as summary, case when secure then 'send' else 'receive' end as kind, lang || '/' || page_id as channel,
      case when marked then null when page_id % 2 = 0 then 'type:' || service || '#Ev' else 'string[]' end as body from ends""",
)
def asyncapi_written(s, d):
    """All ends of channels written as documents of about 50 channels each, and read back: an end's own name is its summary there."""
    e = ends(s, d)
    none = F.lit(None).cast("string")
    ev = F.concat(F.lit("type:"), "service", F.lit("#Ev"))
    ops = e.select("service", "document", F.concat(F.lit("op"), "page_id").alias("op"), F.when(F.col("secure"), "send").otherwise("receive").alias("kind"), none.alias("method"), none.alias("path"), none.alias("raw_path"), F.concat_ws("/", "lang", "page_id").alias("channel"), none.alias("summary"), F.when(F.col("marked"), none).when(F.col("page_id") % 2 == 0, ev).otherwise(F.lit("string[]")).alias("body"), none.alias("returns"))
    hosts = e.select("service", ev.alias("id")).distinct()
    types = hosts.select("id", "service", F.lit("Ev").alias("name"), F.lit("object").alias("kind"), F.lit(None).cast("array<string>").alias("members"), none.alias("alias"))
    fields = hosts.select("id", F.lit("n").alias("name"), F.lit("number").alias("type"), F.lit(False).alias("optional"))
    nothing = {"parameters": "service string, op string, place string, name string, type string, optional boolean", "answers": "service string, op string, status string, description string, type string"}
    api = {"operations": ops, "types": types, "fields": fields, **{k: s.createDataFrame([], v) for k, v in nothing.items()}}
    return R.read_api(W.write_api(api, most=50))["operations"].select("service", "summary", "kind", "channel", "body")


@query(
    "spc_05_reference_schemas",
    f"""with {FACTS}, r as (select distinct service, lang, len(asked) > 0 as a, secure from facts)
    select service, '''' || lang || ''' | ''xx'' | null' as ref, '{{"type":["string","null"],"enum":["' || lang || '","xx",null]}}' as schema from r group by 1, 2, 3
    union all select service, 'type:' || service || '#Base[] | undefined', '{{"type":"array","items":{{"$ref":"#/components/schemas/Base"}}}}' from r where secure group by 1, 2, 3
    union all select service, 'Record<string, (type:' || service || '#None | number)[]>', '{{"type":"object","additionalProperties":{{"type":"array","items":{{"anyOf":[{{"x-unread":"type-not-found"}},{{"type":"number"}}]}}}}}}' from r where a group by 1, 2, 3
    union all select service, '{{ ' || lang || '?: Date; n: [string, string] }} & type:' || service || '#Base', '{{"allOf":[{{"type":"object","properties":{{"' || lang || '":{{"type":"string","format":"date-time"}},"n":{{"type":"array","items":{{"type":"string"}},"minItems":2,"maxItems":2}}}},"required":["n"]}},{{"$ref":"#/components/schemas/Base"}}]}}' from r where not secure group by 1, 2, 3""",
)
def reference_schemas(s, d):
    """JSON Schema of references with unions, literals, arrays, records, tuples, objects in place and named types."""
    f = facts(s, d)
    quote = F.concat(F.lit("'"), "lang", F.lit("' | 'xx' | null"))
    refs = f.select("service", quote.alias("ref")).union(f.filter("secure").select("service", F.concat(F.lit("type:"), "service", F.lit("#Base[] | undefined"))))
    refs = refs.union(f.filter("size(asked) > 0").select("service", F.concat(F.lit("Record<string, (type:"), "service", F.lit("#None | number)[]>")))).union(f.filter("not secure").select("service", F.concat(F.lit("{ "), "lang", F.lit("?: Date; n: [string, string] } & type:"), "service", F.lit("#Base")))).distinct()
    names = f.select("service", F.concat(F.lit("type:"), "service", F.lit("#Base")).alias("id"), F.lit("Base").alias("name")).distinct()
    return W.schema_texts(refs, names)
