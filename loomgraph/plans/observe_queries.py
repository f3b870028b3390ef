"""Spans credited to the graph, browser calls, mounts and deployments; compared with SQL that works the matches out itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import observe as OB
from ..sources import views as V
from .function_queries import PATH
from .graph_queries import N
from .link_queries import CALLS_SQL, MATCH, ROUTES_SQL, SEG, calls, routes
from .registry import query

# pages as server spans of three services; every fourth one tells its route
WEB_SQL = f"select page_id as span_id, 'app' || (page_id % 3) as service, case when page_id % 5 = 0 then 'POST' else 'GET' end as method, {PATH} as path, case when page_id % 4 = 0 then regexp_replace({PATH}, '[0-9]+', '{{id}}', 'g') end as route from pages"


def web_spans(s, d):
    p = V.read(s, d, "pages")
    path = S.url_path(F.col("url"))
    return p.select(
        F.col("page_id").alias("span_id"), F.concat(F.lit("app"), (F.col("page_id") % 3).cast("string")).alias("service"), F.when(F.col("page_id") % 5 == 0, "POST").otherwise("GET").alias("method"),
        path.alias("path"), F.when(F.col("page_id") % 4 == 0, F.regexp_replace(path, "[0-9]+", "{id}")).alias("route"),
    )


def own_routes(s, d):
    return routes(s, d).select("route_id", F.col("app").alias("service"), "method", "path")


FITS = """len(list_filter(range(1, len(r.r) + 1), lambda i: not (r.r[i] = '*' or r.r[i] = ':param' or case when contains(r.r[i], ':param') then starts_with(lower(c.c[i]), split_part(lower(r.r[i]), ':param', 1)) and ends_with(lower(c.c[i]), split_part(lower(r.r[i]), ':param', 2)) and length(c.c[i]) > length(replace(r.r[i], ':param', '')) else lower(r.r[i]) = lower(c.c[i]) end))) = 0"""


def normal(column: str) -> str:
    """The operator's normal form of a path, in SQL: no empty segments, and ":param" for those in braces."""
    return f"'/' || array_to_string(list_transform({SEG.format(column)}, lambda x: case when regexp_full_match(x, '\\{{[^/}}]+\\}}') then ':param' else x end), '/')"


SCORED = f"""with w as ({WEB_SQL}), rr as ({ROUTES_SQL}),
  c as (select *, coalesce(route, path) as p, {SEG.format("path")} as c from w),
  r as (select route_id, app as service, upper(method) as rm, {normal("path")} as rp, {SEG.format("path")} as r from rr),
  h as (select span_id, route_id, len(list_filter(r.r, lambda x: not contains(x, ':param') and x <> '*')) as score from c join r on c.service = r.service and len(c.c) = len(r.r) and (r.rm = c.method or r.rm = 'ALL') where c.route is null and {FITS}
    union all select span_id, route_id, len(list_filter(r.r, lambda x: not contains(x, ':param'))) from (select *, {normal("route")} as t from c where route is not null) c join r on c.service = r.service and c.t = r.rp and (r.rm = c.method or r.rm = 'ALL')),
  b as (select *, rank() over (partition by span_id order by score desc) as k from h), g as (select span_id, count(*) as n, min(route_id) as route_id, max(score) as score from b where k = 1 group by 1) """


@query("join_27_span_routes", SCORED + "select w.span_id, case when g.n is null then 'not-found' when g.n > 1 then 'ambiguous' else 'match' end as outcome, case when g.n = 1 then g.route_id end as route_id, cast(g.score as int) as score from w left join g using (span_id)")
def span_routes(s, d):
    return OB.score_routes(web_spans(s, d), own_routes(s, d))


KIND = "case when parent_id is null then 'server' when span_id % 5 = 0 then 'client' when span_id % 7 = 0 then 'producer' when span_id % 11 = 0 then 'consumer' else 'server' end"
#: Each event is a span of one of seven services, by its number, so a trace goes through several.
CROSS_SQL = f"""select *, {KIND} as kind, case when span_id % 5 = 0 or span_id % 7 = 0 or span_id % 11 = 0 then 'd' || (span_id % 13) end as destination from (select * replace ('svc' || (span_id % 7) as service) from ({V.SPANS_SQL}))"""


def cross_spans(s, d):
    x = V.spans(s, d).withColumn("service", F.concat(F.lit("svc"), (F.col("span_id") % 7).cast("string")))
    n = F.col("span_id")
    kind = F.when(F.col("parent_id").isNull(), "server").when(n % 5 == 0, "client").when(n % 7 == 0, "producer").when(n % 11 == 0, "consumer").otherwise("server")
    return x.withColumn("kind", kind).withColumn("destination", F.when((n % 5 == 0) | (n % 7 == 0) | (n % 11 == 0), F.concat(F.lit("d"), (n % 13).cast("string"))))


@query(
    "join_28_credited_joins",
    f"""with x as ({CROSS_SQL}), c as (select y.*, p.service as from_service from x y join x p on p.trace_id = y.trace_id and p.span_id = y.parent_id where y.kind = 'server' and p.service <> y.service),
      j as (select from_service || ' -http_calls-> entry:' || service || ':' || entry as "join", error or status >= 500 as bad from c
        union all select service || ' -http_calls-> external_api:' || destination, error or status >= 500 from x where kind = 'client' and destination is not null and (trace_id, span_id) not in (select (trace_id, parent_id) from c)
        union all select service || ' -emits-> channel:' || destination, error or status >= 500 from x where kind = 'producer' and destination is not null
        union all select 'channel:' || destination || ' -consumes-> ' || service, error or status >= 500 from x where kind = 'consumer' and destination is not null)
    select "join", count(*) as count, count(*) filter (bad) as errors from j group by 1""",
)
def credited_joins(s, d):
    return OB.credit_joins(cross_spans(s, d), F.coalesce("error", F.lit(False)) | (F.coalesce("status", F.lit(0)) >= 500))


CALLS = "['GetItem', 'PutItem', 'Publish', 'Scan'][l_suppkey % 4 + 1]"


@query(
    "join_29_cloud_calls",
    f"""with s as (select l_orderkey * 10 + l_linenumber as span_id, case when l_suppkey % 4 = 2 then 'SNS' else 'DynamoDB' end as api, {CALLS} as operation, 'arn:x:y/' || upper(p_name) as resource from lineitem join part on p_partkey = l_partkey),
      t as (select case when p_size % 2 = 0 then 'table' else 'channel' end as type, lower(p_name) as name, count(distinct p_partkey) as n, min('part:' || p_partkey) as node from part group by 1, 2),
      k(api, operation, "join", type, op) as (values ('DynamoDB', 'GetItem', 'queries', 'table', 'read'), ('DynamoDB', 'PutItem', 'queries', 'table', 'write'), ('SNS', 'Publish', 'emits', 'channel', 'write'))
    select span_id, case when k."join" is null then 'unknown call' when t.n is null then 'not-found' when t.n > 1 then 'ambiguous' else 'match' end as outcome, k."join", case when t.n = 1 then t.node end as node, k.op
    from s left join k using (api, operation) left join t on t.type = k.type and t.name = lower(regexp_extract(resource, '([^:/]+)$', 1))""",
)
def cloud_calls(s, d):
    p = V.read(s, d, "part")
    k = F.col("l_suppkey") % 4
    names = p.select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("arn:x:y/"), F.upper("p_name")).alias("resource"))
    ops = F.element_at(F.array(*[F.lit(x) for x in ("GetItem", "PutItem", "Publish", "Scan")]), (k + 1).cast("int"))
    spans = V.read(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("span_id"), F.when(k == 2, "SNS").otherwise("DynamoDB").alias("api"), ops.alias("operation"), "l_partkey").join(names, "l_partkey")
    nodes = p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.when(F.col("p_size") % 2 == 0, "table").otherwise("channel").alias("type"), F.col("p_name").alias("label"))
    return OB.match_cloud(spans, nodes)


MOUNTS = ("/api", "/en")


@query(
    "join_06_mount_assumed",
    MATCH
    + f""", first as (select call_id, case when candidates is null then 'not-found' when len(candidates) > 1 then 'ambiguous' else 'match' end as outcome, case when len(candidates) = 1 then candidates[1] end as route_id from calls left join g using (call_id)),
      l as (select c.call_id, c.method, c.app, m.m, case when starts_with(c.path, m.m || '/') then substr(c.path, length(m.m) + 1) else m.m || c.path end as path from calls c join first f using (call_id) cross join (values ('/api'), ('/en')) m(m) where f.outcome = 'not-found'),
      lc as (select *, {SEG.format("path")} as c from l),
      lh as (select c.call_id, c.m, c.path, route_id, coalesce(r.app = c.app, false) as own, len(list_filter(r.r, lambda x: x = '*')) as wild, len(list_filter(r.r, lambda x: contains(x, ':param'))) as params, len(list_filter(r.r, lambda x: x <> '*' and not contains(x, ':param'))) as literals
        from lc c join r on (r.method = c.method or r.method = 'ALL') and (case when r.r[-1] = '*' then len(c.c) >= len(r.r) else len(c.c) = len(r.r) end) where {FITS}),
      lb as (select distinct call_id, route_id from (select *, rank() over (partition by call_id, path order by own desc, wild, params, literals desc) as k from lh) where k = 1),
      lm as (select call_id, count(*) as n, min(route_id) as m_route from lb group by 1)
    select call_id, case when outcome = 'not-found' and n is not null then case when n > 1 then 'ambiguous' else 'match' end else outcome end as outcome,
      case when outcome = 'not-found' and n is not null then case when n = 1 then m_route end else route_id end as route_id, case when outcome <> 'not-found' then 'read' when n is not null then 'mount' end as footing from first left join lm using (call_id)""",
)
def mount_assumed(s, d):
    return OB.match_mounted(calls(s, d), routes(s, d), MOUNTS)


@query(
    "join_10_browser_calls",
    f"""with rr as ({ROUTES_SQL}), u as (select call_id, 'app' || (call_id % 4) as service, case when call_id % 13 <> 0 then method end as verb, case when call_id % 17 = 0 then path || '/${{x}}' else path end as path,
        case when call_id % 10 = 1 then 'app' || (call_id % 3) end as target, case when call_id % 10 = 2 then 'b' || (call_id % 3) end as base, case when call_id % 10 = 3 then call_id % 7 + 1 end as annotation from ({CALLS_SQL})),
      q as (select base, count(distinct service) as claims, min(service) as claimed from (values ('b0', 'app0'), ('b1', 'app2'), ('b1', 'app1'), ('b2', 'app1')) b(base, service) group by 1),
      c as (select u.*, case when claims = 1 then claimed end as claimed, {SEG.format("path")} as c from u left join q using (base) where path is not null and verb is not null and not contains(path, '${{')),
      r as (select route_id, app as rs, upper(method) as rm, {SEG.format("path")} as r from rr),
      p as (select call_id, route_id, case when annotation = route_id then 0 when target = rs then 1 when claimed = rs then 2 when service = rs then 3 else 4 end as stage from c join r on len(c.c) = len(r.r) and (rm = upper(verb) or rm = 'ALL') where {FITS}),
      g as (select call_id, stage, count(distinct route_id) as n, min(route_id) as route_id from p group by 1, 2), b as (select *, row_number() over (partition by call_id order by stage) as k from g)
    select u.call_id, case when path is null or verb is null or contains(path, '${{') then 'dynamic' when b.n is null then 'noRoute' when b.n > 1 then 'ambiguous' else 'linked' end as outcome, ['annotation', 'target', 'base', 'same service', 'unique route'][b.stage + 1] as stage, case when b.n = 1 then b.route_id end as route_id
    from u left join (select * from b where k = 1) b using (call_id)""",
)
def browser_calls(s, d):
    c, i = calls(s, d), F.col("call_id")
    u = c.select(
        "call_id", F.concat(F.lit("app"), (i % 4).cast("string")).alias("service"), F.when(i % 13 != 0, F.col("method")).alias("verb"), F.when(i % 17 == 0, F.concat("path", F.lit("/${x}"))).otherwise(F.col("path")).alias("path"),
        F.when(i % 10 == 1, F.concat(F.lit("app"), (i % 3).cast("string"))).alias("target"), F.when(i % 10 == 2, F.concat(F.lit("b"), (i % 3).cast("string"))).alias("base"), F.when(i % 10 == 3, i % 7 + 1).alias("annotation"),
    )
    bases = s.createDataFrame([("b0", "app0"), ("b1", "app2"), ("b1", "app1"), ("b2", "app1")], "base string, service string")
    return OB.browser_calls(u, own_routes(s, d), bases)


@query(
    "join_16_deployment_roots",
    "with r as (select p_partkey as route_id, case when p_size % 9 <> 0 then p_brand end as root, 'v' || p_size as below from part), o as (select distinct p_brand as root, '/' || lower(p_type) as path from part where p_size = 1 or (p_size = 2 and p_type = 'ECONOMY')), n as (select root, count(distinct path) as n, min(path) as owner from o group by 1) select route_id, case when r.root is null then 'not rooted' when n is null then 'not-found' when n > 1 then 'ambiguous' else 'linked' end as outcome, case when n = 1 then owner || '/' || below end as path from r left join n using (root)",
)
def deployment_roots(s, d):
    p = V.read(s, d, "part")
    r = p.select(F.col("p_partkey").alias("route_id"), F.when(F.col("p_size") % 9 != 0, F.col("p_brand")).alias("root"), F.concat(F.lit("v"), F.col("p_size").cast("string")).alias("below"))
    roots = p.filter("p_size = 1 or (p_size = 2 and p_type = 'ECONOMY')").select(F.col("p_brand").alias("root"), F.concat(F.lit("/"), F.lower("p_type")).alias("path"))
    return OB.deployed(r, roots)


@query(
    "join_17_environment_values",
    "with reads as (select distinct l_partkey as node, 'V' || (l_suppkey % 3) as variable from lineitem), reach as (select distinct l_orderkey as entry, l_partkey as node from lineitem), v as (select o_orderkey as entry, 'V' || (o_custkey % 3) as variable, o_orderpriority as value from orders), g as (select node, variable, count(distinct value) as n, min(value) as value from reads join reach using (node) join v using (entry, variable) group by 1, 2) select node, variable, case when n is null then 'not set' when n > 1 then 'unsettled' else 'set' end as state, case when n = 1 then g.value end as value from reads left join g using (node, variable)",
)
def environment_values(s, d):
    line = V.read(s, d, "lineitem")
    reads = line.select(F.col("l_partkey").alias("node"), F.concat(F.lit("V"), (F.col("l_suppkey") % 3).cast("string")).alias("variable")).distinct()
    reach = line.select(F.col("l_orderkey").alias("entry"), F.col("l_partkey").alias("node")).distinct()
    variables = V.read(s, d, "orders").select(F.col("o_orderkey").alias("entry"), F.concat(F.lit("V"), (F.col("o_custkey") % 3).cast("string")).alias("variable"), F.col("o_orderpriority").alias("value"))
    return OB.completed_from_environment(reads, reach, variables)


@query(
    "join_18_function_urls",
    "with reads as (select c_custkey as node, 'URL' || (c_custkey % 40) as variable from customer), urls as (select 'URL' || (s_suppkey % 50) as variable, s_suppkey as function from supplier), entries as (select s_suppkey as function, 'entry:' || s_nationkey as entry from supplier where s_acctbal > 0) select distinct node, entry from reads join urls using (variable) join entries using (function)",
)
def function_urls(s, d):
    c, p = V.read(s, d, "customer"), V.read(s, d, "supplier")
    name = lambda k, m: F.concat(F.lit("URL"), (F.col(k) % m).cast("string")).alias("variable")
    reads = c.select(F.col("c_custkey").alias("node"), name("c_custkey", 40))
    urls = p.select(name("s_suppkey", 50), F.col("s_suppkey").alias("function"))
    entries = p.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("function"), F.concat(F.lit("entry:"), F.col("s_nationkey").cast("string")).alias("entry"))
    return OB.function_urls(reads, urls, entries)


@query("trv_20_trace_tree", f"with recursive x as ({V.SPANS_SQL}), w as (select trace_id, span_id, 0 as depth from x where parent_id is null union all select x.trace_id, x.span_id, w.depth + 1 from w join x on x.trace_id = w.trace_id and x.parent_id = w.span_id) select trace_id, max(depth) as depth, count(*) as spans, sum(depth) as steps from w group by 1")
def trace_depths(s, d):
    """Depth of each span below its trace's roots by its parents: each round doubles the steps that a span has looked up."""
    from ..operators.traces import depths

    return depths(V.spans(s, d)).groupBy("trace_id").agg(F.max("depth").alias("depth"), F.count("*").alias("spans"), F.sum("depth").alias("steps"))


@query("join_32_guards", f"with n as ({N}), g as (select l_orderkey, l_linenumber, l_suppkey, l_tax from lineitem where l_discount >= 0.05) select o_orderkey as entry, count(g.l_suppkey) as guards, count(*) filter (g.l_tax = 0) as opted_out, case when count(g.l_suppkey) = 0 then 'open' when count(g.l_suppkey) = count(*) filter (g.l_tax = 0) then 'skipped' else 'guarded' end as access from orders left join g on l_orderkey = o_orderkey group by 1")
def guards(s, d):
    """Guards are discounted lines of an order; one without tax is an opt-out. Access by what is left."""
    g = V.read(s, d, "lineitem").filter("l_discount >= 0.05").groupBy(F.col("l_orderkey").alias("entry")).agg(F.count("*").alias("guards"), F.count_if(F.col("l_tax") == 0).alias("opted_out"))
    o = V.read(s, d, "orders").select(F.col("o_orderkey").alias("entry")).join(g, "entry", "left").fillna(0, ["guards", "opted_out"])
    return o.withColumn("access", F.when(F.col("guards") == 0, "open").when(F.col("guards") == F.col("opted_out"), "skipped").otherwise("guarded"))
