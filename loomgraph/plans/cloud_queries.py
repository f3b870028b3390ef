"""Calls of cloud services in the trees of their traces, over all events as spans and a graph of suppliers, parts and customers.

A supplier is code of a service, and calls the next one of its nation; parts are tables and channels, customers steps of workflows.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cloud as C
from ..operators import outgoing as G
from ..sources import views as V
from .registry import query

APIS = ("DynamoDB", "SQS", "SNS", "EventBridge", "Kinesis", "S3", "Lambda", "SFN", "DynamoDB", "Textract")
READS = ("GetItem", "ReceiveMessage", "ListTopics", "ListRules", "GetRecords", "GetObject", "GetFunction", "DescribeExecution", "Query", "Detect")
WRITES = ("PutItem", "SendMessage", "Publish", "PutEvents", "PutRecord", "PutObject", "Invoke", "StartExecution", "UpdateItem", "Start")
CHANNELS = ("dynamodb", "sqs", "sns", "kinesis", "s3", "eventbridge")


def _of(values, i):
    return F.get(F.array(*[F.lit(x) for x in values]), i.cast("int"))


def _name(front, key, m):
    return F.concat(F.lit(front), (F.col(key) % m).cast("string"))


def cloud_spans(s, d):
    """Every third event that has one before it is a call; its name is written bare, as an ARN or as a queue's address, or not at all."""
    n = F.col("span_id")
    root, i = F.col("parent_id").isNull(), F.split_part("trace_id", F.lit("/"), F.lit(1)).cast("long") % 10
    kind = F.when(root, "server").when(n % 3 == 0, "client").when(n % 7 == 0, "consumer").otherwise("internal")
    x = V.spans(s, d).select("trace_id", "span_id", "parent_id", "service", kind.alias("kind"), i.alias("i"))
    client, api = F.col("kind") == "client", _of(APIS, F.col("i"))
    name = F.when(api == "Lambda", F.concat(F.lit("fn"), (n % 8).cast("string"))).when(api == "SFN", F.concat(F.lit("wf"), (n % 4).cast("string"))).otherwise(F.concat(F.lit("t"), (n % 13).cast("string")))
    lead = F.create_map(*[F.lit(v) for a, v in (("DynamoDB", "dynamodb:eu:1:table/"), ("SQS", "sqs:eu:1:"), ("SNS", "sns:eu:1:"), ("EventBridge", "events:eu:1:event-bus/"), ("Kinesis", "kinesis:eu:1:stream/"), ("S3", "s3:::"), ("Lambda", "lambda:eu:1:function:"), ("SFN", "states:eu:1:stateMachine:"), ("Textract", "x:eu:1:")) for v in (a, v)])
    written = F.when(n % 4 == 1, F.concat(F.lit("arn:aws:"), lead[api], name)).when((api == "SQS") & (n % 4 == 2), F.concat(F.lit("https://q.eu/1/"), name)).otherwise(name)
    return x.select(
        "trace_id", "span_id", "parent_id", "kind", "service",
        F.when(F.col("kind").isin("server", "consumer") | (client & (n % 10 == 9)), F.concat(F.lit("fn"), (n % 8).cast("string"))).alias("faas"),
        F.when((F.col("kind") == "internal") & (n % 5 == 0), F.concat(F.lit("wf"), (n % 3).cast("string"))).alias("workflow"),
        F.when((F.col("kind") == "internal") & (n % 5 == 0), F.concat(F.lit("s"), (n % 4).cast("string"))).alias("state"),
        F.when(client, api).alias("api"), F.when(client, F.when(n % 5 < 2, _of(READS, F.col("i"))).otherwise(_of(WRITES, F.col("i")))).alias("operation"),
        F.when(client & (n % 11 != 3), F.array(written)).alias("targets"),
    )


SPANS = f"""x0 as (select trace_id, span_id, parent_id, service, case when parent_id is null then 'server' when span_id % 3 = 0 then 'client' when span_id % 7 = 0 then 'consumer' else 'internal' end as kind, cast(split_part(trace_id, '/', 1) as bigint) % 10 as i from ({V.SPANS_SQL})),
  x1 as (select *, kind = 'client' as client, {list(APIS)}[i + 1] as api0, case i when 6 then 'fn' || (span_id % 8) when 7 then 'wf' || (span_id % 4) else 't' || (span_id % 13) end as name from x0),
  x as (select trace_id, span_id, parent_id, kind, service, case when kind in ('server', 'consumer') or (client and span_id % 10 = 9) then 'fn' || (span_id % 8) end as faas,
    case when kind = 'internal' and span_id % 5 = 0 then 'wf' || (span_id % 3) || '/s' || (span_id % 4) end as step_name,
    case when client then api0 end as api, case when client then case when span_id % 5 < 2 then {list(READS)}[i + 1] else {list(WRITES)}[i + 1] end end as operation, case when client and span_id % 11 <> 3 then name end as name,
    case when client and span_id % 11 <> 3 then case when span_id % 4 = 1 then 'arn:aws:' || map {{'DynamoDB': 'dynamodb:eu:1:table/', 'SQS': 'sqs:eu:1:', 'SNS': 'sns:eu:1:', 'EventBridge': 'events:eu:1:event-bus/', 'Kinesis': 'kinesis:eu:1:stream/', 'S3': 's3:::', 'Lambda': 'lambda:eu:1:function:', 'SFN': 'states:eu:1:stateMachine:', 'Textract': 'x:eu:1:'}}[api0] || name
      when api0 = 'SQS' and span_id % 4 = 2 then 'https://q.eu/1/' || name else name end end as target from x1)"""


def cloud_graph(s, d):
    """(nodes, edges): code by supplier, functions and workflows as ways in, tables and channels by part, steps by customer."""
    sup, part, cust, line = (V.read(s, d, t) for t in ("supplier", "part", "customer", "lineitem"))
    code, service = F.concat(F.lit("code:"), F.col("s_suppkey").cast("string")), _name("svc", "s_suppkey", 6)
    fn, wf = _name("fn", "s_suppkey", 7), _name("wf", "s_suppkey", 3)
    sup = sup.select("s_suppkey", "s_nationkey", code.alias("code"), service.alias("service"), fn.alias("fn"), F.concat(F.lit("invoke:"), service, F.lit("/"), fn).alias("invoke"), wf.alias("wf"), F.concat(F.lit("workflow:"), service, F.lit("/"), wf).alias("flow"))
    none = F.lit(None).cast("string")
    node = lambda df, *c: df.select(*[x.alias(n) for x, n in zip(c, ("id", "type", "kind", "label", "service"))]).distinct()
    low = _name("t", "p_partkey", 11)
    label = F.when(F.col("p_size") > 45, F.upper(low)).otherwise(low)
    owner = _name("svc", "p_size", 5)
    spelled = _of(CHANNELS, F.col("p_size") % 6)
    channel = F.concat(spelled, F.lit("/"), low, F.when(spelled == "eventbridge", F.concat(F.lit("/e"), (F.col("p_size") % 4).cast("string"))).otherwise(""))
    step = F.concat(_name("wf", "c_custkey", 3), F.lit("/"), _name("s", "c_custkey", 4))
    at = _name("svc", "c_nationkey", 6)
    steps = cust.groupBy(F.concat(F.lit("step:"), at, F.lit("/"), step).alias("id"), step.alias("label"), at.alias("service")).agg(F.min("c_custkey").alias("k"), F.min("c_nationkey").alias("n"))
    nodes = (
        node(sup, F.col("code"), F.lit("method"), none, F.col("code"), F.col("service"))
        .unionByName(node(sup, F.col("invoke"), F.lit("entry"), F.lit("invoke"), F.col("fn"), F.col("service")))
        .unionByName(node(sup, F.col("flow"), F.lit("entry"), F.lit("workflow"), F.col("wf"), F.col("service")))
        .unionByName(node(part, F.concat(F.lit("table:"), owner, F.lit("/"), label), F.lit("table"), none, label, owner))
        .unionByName(node(part, F.concat(F.lit("channel:"), channel), F.lit("channel"), none, channel, none))
        .unionByName(node(steps, F.col("id"), F.lit("function"), F.lit("state"), F.col("label"), F.col("service")))
    )
    edge = lambda df, a, b, t: df.select(a.alias("from_id"), b.alias("to_id"), F.lit(t).alias("type"))
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    chain = sup.withColumn("next", F.lead("code").over(w)).withColumn("starts", F.lead("invoke", 2).over(w)).withColumn("runs", F.lead("flow", 3).over(w))
    sold = line.join(part.select(F.col("p_partkey").alias("l_partkey"), channel.alias("channel"), F.concat(F.lit("table:"), owner, F.lit("/"), label).alias("table")), "l_partkey")
    of = lambda k: F.concat(F.lit("code:"), F.col(k).cast("string"))
    emit = sold.groupBy("channel").agg(F.min("l_suppkey").alias("lo"), F.max("l_suppkey").alias("hi"))
    ask = sold.groupBy("table", (F.col("l_suppkey") % 6).alias("m")).agg(F.min("l_suppkey").alias("lo"))
    run = steps.join(sup.groupBy(F.col("s_nationkey").alias("n")).agg(F.min("s_suppkey").alias("s_suppkey")), "n").join(sup.drop("service"), "s_suppkey")
    edges = (
        edge(sup, F.col("invoke"), F.col("code"), "handles").unionByName(edge(chain.filter("next is not null"), F.col("code"), F.col("next"), "calls"))
        .unionByName(edge(chain.filter("starts is not null"), F.col("code"), F.col("starts"), "calls")).unionByName(edge(chain.filter("runs is not null"), F.col("code"), F.col("runs"), "triggers"))
        .unionByName(edge(emit, of("lo"), F.concat(F.lit("channel:"), F.col("channel")), "emits")).unionByName(edge(emit, of("hi"), F.concat(F.lit("channel:"), F.col("channel")), "emits"))
        .unionByName(edge(ask, of("lo"), F.col("table"), "queries"))
        .unionByName(edge(run, F.col("id"), F.col("code"), "calls")).unionByName(edge(run.filter("k % 2 = 0"), F.col("id"), F.col("invoke"), "calls")).unionByName(edge(run.filter("k % 3 = 0"), F.col("id"), F.col("flow"), "calls"))
    )
    return nodes, edges.distinct()


GRAPH = f"""su as (select s_suppkey as k, s_nationkey as nation, 'code:' || s_suppkey as code, 'svc' || (s_suppkey % 6) as service, 'fn' || (s_suppkey % 7) as fn, 'wf' || (s_suppkey % 3) as wf, 'invoke:svc' || (s_suppkey % 6) || '/fn' || (s_suppkey % 7) as invoke, 'workflow:svc' || (s_suppkey % 6) || '/wf' || (s_suppkey % 3) as flow from supplier),
  pa as (select p_partkey, 'svc' || (p_size % 5) as service, case when p_size > 45 then 'T' else 't' end || (p_partkey % 11) as label, {list(CHANNELS)}[p_size % 6 + 1] || '/t' || (p_partkey % 11) || case when p_size % 6 = 5 then '/e' || (p_size % 4) else '' end as channel from part),
  st as (select 'step:svc' || (c_nationkey % 6) || '/wf' || (c_custkey % 3) || '/s' || (c_custkey % 4) as id, 'wf' || (c_custkey % 3) || '/s' || (c_custkey % 4) as label, 'svc' || (c_nationkey % 6) as service, min(c_custkey) as k, min(c_nationkey) as n from customer group by all),
  nodes as (select distinct * from (select code as id, 'method' as type, null as kind, code as label, service from su union all select invoke, 'entry', 'invoke', fn, service from su union all select flow, 'entry', 'workflow', wf, service from su
    union all select 'table:' || service || '/' || label, 'table', null, label, service from pa union all select 'channel:' || channel, 'channel', null, channel, null from pa union all select id, 'function', 'state', label, service from st)),
  ch as (select code, lead(code) over w as nx, lead(invoke, 2) over w as iv, lead(flow, 3) over w as fl from su window w as (partition by nation order by k)),
  so as (select l_suppkey as k, channel, 'table:' || service || '/' || label as tb from lineitem join pa on p_partkey = l_partkey), em as (select channel, min(k) as lo, max(k) as hi from so group by 1), ru as (select st.id, st.k, su.* exclude (k) from st join su on su.k = (select min(k) from su z where z.nation = st.n)),
  edges as (select distinct * from (select invoke as a, code as b, 'handles' as type from su union all select code, nx, 'calls' from ch where nx is not null union all select code, iv, 'calls' from ch where iv is not null union all select code, fl, 'triggers' from ch where fl is not null
    union all select 'code:' || unnest([lo, hi]), 'channel:' || channel, 'emits' from em union all select 'code:' || min(k), tb, 'queries' from so group by tb, k % 6
    union all select id, code, 'calls' from ru union all select id, invoke, 'calls' from ru where k % 2 = 0 union all select id, flow, 'calls' from ru where k % 3 = 0))"""

# each span's way up by steps of one, and the first of each kind on it
PLACED = f"""with recursive {SPANS}, {GRAPH},
  sv as (select distinct service from nodes where service is not null), xo as (select x.* exclude (service), sv.service as own from x left join sv using (service)),
  so1 as (select trace_id, span_id, min(n.id) as step from xo join nodes n on n.kind = 'state' and n.label = step_name and (own is null or own = n.service) group by 1, 2 having count(*) = 1),
  m as (select xo.*, step, api is not null as call, kind in ('server', 'consumer') as takes from xo left join so1 using (trace_id, span_id)),
  up as (select trace_id, span_id, parent_id as at, 1 as hop from m where call and parent_id is not null union all select up.trace_id, up.span_id, m.parent_id, hop + 1 from up join m on m.trace_id = up.trace_id and m.span_id = up.at where m.parent_id is not null),
  ab as (select up.trace_id, up.span_id, arg_min(case when m.step is not null then 'step:' || m.step else 'function:' || m.faas end, hop) filter (m.step is not null or (m.takes and m.faas is not null)) as ran, arg_min(m.step, hop) filter (m.step is not null) as above,
    arg_min({{'s': m.span_id, 'c': m.call, 'api': m.api, 'op': m.operation}}, hop) filter (m.call or m.takes) as outer_ from up join m on m.trace_id = up.trace_id and m.span_id = up.at group by 1, 2),
  calls as (select row_number() over () as c, m.trace_id, m.span_id, own, m.api, m.operation, target, name as told, coalesce(ran, 'function:' || faas) as scope, above as step, case when outer_.c and outer_.api = m.api and outer_.op = m.operation then outer_.s end as within from m left join ab using (trace_id, span_id) where call)"""

KNOWN = "(values ('DynamoDB', 'table', 'dynamodb'), ('SQS', 'channel', 'sqs'), ('SNS', 'channel', 'sns'), ('EventBridge', 'channel', 'eventbridge'), ('Kinesis', 'channel', 'kinesis'), ('S3', 'channel', 's3'), ('Lambda', 'invoke', null), ('SFN', 'workflow', null)) t(api, lookup, transport)"
MATCHED = (
    PLACED
    + f""", fs as (select 'function:' || n.label as scope, e.b as node from nodes n join edges e on e.a = n.id and e.type = 'handles' where n.kind = 'invoke' union select fs.scope, e.b from fs join edges e on e.a = fs.node and e.type = 'calls' join nodes n on n.id = e.b where n.type <> 'entry' and n.kind is distinct from 'state'),
  ss as (select id as step, id as node from nodes where kind = 'state' union select e.a, e.b from edges e join nodes a on a.id = e.a and a.kind = 'state' join nodes b on b.id = e.b where e.type = 'calls' and b.kind is distinct from 'state'),
  sc as (select * from fs union select 'step:' || step, node from ss),
  rs as (select step, lookup, min(label) as label from (select distinct step, n.id, n.label, case when e.type = 'queries' and n.type = 'table' then 'table' when e.type = 'emits' and n.type = 'channel' then 'channel' when e.type = 'calls' and e.a = step and n.type = 'entry' then n.kind end as lookup from ss join edges e on e.a = ss.node join nodes n on n.id = e.b) where lookup is not null group by 1, 2 having count(*) = 1),
  r0 as (select c.*, t.lookup, t.transport, list_contains({[op for *_, ops in C.CALLS for op in ops]}, c.operation) as sends, case when c.api = 'EventBridge' then coalesce(told, 'default') else told end as own_name from calls c left join {KNOWN} using (api)),
  r as (select r0.*, coalesce(own_name, case when sends or r0.lookup = 'table' then rs.label end) as name, case when r0.lookup = 'table' then 'dynamodb/' || coalesce(own_name, rs.label) when r0.lookup = 'channel' then case when own_name is null then case when sends then rs.label end when transport <> 'eventbridge' then transport || '/' || own_name end end as channel from r0 left join rs on rs.step = r0.step and rs.lookup = r0.lookup),
  tb as (select c, count(*) as n, min(t.id) as node from r join nodes t on t.type = 'table' and lower(t.label) = lower(name) and (own is null or own = t.service) where lookup = 'table' group by 1),
  scoped as (select distinct scope from sc),
  can as (select r.c, e.a, e.type, e.b, case when r.scope in (from scoped) then (r.scope, e.a) in (select (scope, node) from sc) else r.own is null or r.own = n.service end as ok from r join edges e on e.type = 'queries' join nodes n on n.id = e.a join tb on tb.c = r.c and tb.n = 1 and tb.node = e.b),
  si as (select c, min(a) as site from can where ok group by 1 having count(distinct a) = 1),
  cl as (select r.c, n.id as channel, 1 as n from r join nodes n on n.type = 'channel' and n.label = r.channel),
  bu as (select r.c, n.id, exists (select 1 from edges e join sc on sc.node = e.a and sc.scope = r.scope where e.type = 'emits' and e.b = n.id) as mine from r join nodes n on n.type = 'channel' and starts_with(n.label, 'eventbridge/' || own_name || '/') where r.transport = 'eventbridge' and sends),
  bo as (select c, case when count(*) filter (mine) = 1 then min(id) filter (mine) when count(*) = 1 then min(id) end as channel, case when count(*) filter (mine) = 1 then 1 else count(*) end as n from bu group by 1),
  cn as (from cl union all from bo),
  wi as (select r.c, n.id from r join nodes n on n.type = 'entry' and n.kind = r.lookup and n.label = r.name where sends), en as (select c, count(*) as n from wi group by 1),
  tg as (select cn.c, cn.channel as b, 'emits' as want from cn join r on r.c = cn.c and r.sends where cn.channel is not null union all select c, id, null from wi),
  jc as (select r.c, e.a, e.type, e.b from tg join r on r.c = tg.c join edges e on e.b = tg.b and (want = e.type or (want is null and e.type in ('calls', 'triggers'))) join nodes n on n.id = e.a where case when r.scope in (from scoped) then (r.scope, e.a) in (select (scope, node) from sc) else r.own is null or r.own = n.service end),
  jn as (select c, count(*) as n, min(a) as a, min(type) as type, min(b) as b from jc group by 1),
  res as (select r.trace_id, r.span_id, r.target, r.within,
    case when lookup is null then 'unknown call' when name is null then case when sends or lookup = 'table' then 'unnamed' else 'not counted' end
      when lookup = 'table' then case when tb.n > 1 then 'ambiguous' when tb.n = 1 then 'match' when cn.channel is null then 'not-found' when sends then 'match' else 'not counted' end
      when lookup = 'channel' then case when not sends then 'not counted' when cn.channel is not null then 'match' when cn.n > 1 then 'ambiguous' when transport = 's3' then 'not counted' else 'not-found' end
      when not sends then 'not counted' when en.n is null then 'not-found' else 'match' end as outcome,
    case when lookup = 'table' then case when tb.n = 1 then tb.node when tb.n is null and sends then cn.channel end when lookup = 'channel' then case when sends then cn.channel end when jn.n = 1 then jn.b end as node,
    case when lookup = 'table' then si.site when lookup in ('invoke', 'workflow') and jn.n = 1 and not starts_with(jn.a, 'step:') then jn.a end as site,
    case when sends and (cn.channel is not null or en.n is not null) then case when jn.n is null then 'no join' when jn.n > 1 then 'ambiguous' else 'match' end end as join_outcome,
    case when sends and (cn.channel is not null or en.n is not null) and jn.n = 1 then jn.a || ' -' || jn.type || '-> ' || jn.b end as "join"
    from r left join tb using (c) left join si using (c) left join cn using (c) left join en using (c) left join jn using (c)) """
)


def matched(s, d):
    return C.match_calls(cloud_spans(s, d), *cloud_graph(s, d))


@query("join_29_calls_placed", MATCHED + """select trace_id, span_id, target, outcome, node, site, join_outcome, "join", within from res""")
def calls_placed(s, d):
    return matched(s, d)


@query("join_29_calls_counted", MATCHED + """select what, id, count(*) as count from (select 'node' as what, node as id from res where within is null union all select 'site', site from res where within is null union all select 'join', "join" from res where within is null) where id is not null group by 1, 2""")
def calls_counted(s, d):
    return C.call_counts(matched(s, d))


def outgoing_tables(s, d):
    """Orders as calls, suppliers as services: (calls, routes, markers, bindings, claims, values, urls).

    A customer's nation and balance give the variable, suppliers of that nation and balance claim it; discounted lines are annotations.
    """
    o, cust, sup, line = (V.read(s, d, t) for t in ("orders", "customer", "supplier", "lineitem"))
    env = lambda n, b: F.concat(F.lit("URL_"), F.col(n).cast("string"), F.lit("_"), F.floor(F.col(b) / 1000).cast("string"))
    c = cust.select(F.col("c_custkey").alias("o_custkey"), env("c_nationkey", "c_acctbal").alias("url"), "c_mktsegment", "c_nationkey", F.floor(F.col("c_acctbal") / 1000).alias("b"))
    of, status = F.col("o_orderpriority"), F.lower("o_orderstatus")
    path = F.concat(F.lit("/orders/"), F.col("o_orderkey").cast("string"), F.lit("/"), status)
    calls = o.join(c, "o_custkey").select(
        F.col("o_orderkey").alias("call_id"), of.alias("service"), F.when(status == "f", "POST").alias("method"), ((status == "p") & (F.col("o_totalprice") > 3e5)).alias("unread"),
        F.when(F.col("o_totalprice") < 5e4, F.concat(path, F.lit("/${x}"))).otherwise(path).alias("path"), F.when(~of.isin("4-NOT SPECIFIED", "5-LOW"), F.col("url")).alias("env"), F.lit(None).cast("string").alias("variable"),
        F.when((of == "4-NOT SPECIFIED") & (status == "o"), "host").alias("host"), F.when(of == "5-LOW", F.col("c_mktsegment")).alias("binding"), (status != "p").alias("typed"),
    )
    spread = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(p).alias("path"), F.lit(f).alias("prefix"), F.lit(a).alias("api"), F.lit(least).alias("least")) for m, p, f, a, least in ROUTES])
    routes = sup.select("s_suppkey", F.col("s_name").alias("service"), "s_acctbal", F.inline(spread)).filter("s_acctbal >= least").select(F.concat_ws(" ", "service", "method", "path", "api").alias("route_id"), "service", "method", "path", "prefix", "api")
    marker = F.when(F.col("l_quantity") > 25, "/orders/1/f").otherwise("/nowhere/1")
    markers = line.filter("l_discount >= 0.1").join(sup.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("service")), "l_suppkey").select(F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").alias("ord"), "service", F.lit("GET").alias("method"), marker.alias("path"))
    bindings = cust.groupBy("c_mktsegment").agg(F.min("c_nationkey").alias("s_nationkey")).join(sup.groupBy("s_nationkey").agg(F.min("s_name").alias("lo"), F.max("s_name").alias("hi")), "s_nationkey")
    bindings = bindings.select(F.lit("5-LOW").alias("service"), F.col("c_mktsegment").alias("binding"), F.explode(F.when(F.col("c_mktsegment") < "F", F.array("lo")).otherwise(F.array("lo", "hi"))).alias("target"))
    claims = sup.select(env("s_nationkey", "s_acctbal").alias("env"), F.col("s_name").alias("service"))
    first = sup.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_name").alias("lo"), F.max("s_name").alias("hi"))
    kinds = c.join(first, "c_nationkey").filter("b < 7").select("url", "b", "lo", "hi").distinct()
    row = lambda k, t, p: F.struct(k.alias("kind"), t.alias("target"), p.alias("start"))
    none = F.lit(None).cast("string")
    values = kinds.select(F.col("url").alias("env"), F.explode(F.when(F.col("b") < 1, F.array(row(F.lit("external"), none, none))).when(F.col("b") < 3, F.array(row(F.lit("service"), F.col("lo"), none), row(F.lit("service"), F.col("hi"), none))).otherwise(F.array(row(F.lit("service"), F.col("lo"), F.when(F.col("b") > 4, "/v1"))))).alias("v"))
    values = values.select(F.explode(F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).alias("service"), "env", "v.kind", "v.target", "v.start")
    urls = line.filter("l_tax = 0 and l_linenumber <= 2").select(F.col("l_orderkey").alias("call_id"), F.concat(F.lit("fn:"), F.col("l_suppkey").cast("string")).alias("entry"))
    return calls, routes, markers, bindings, claims, values, urls


#: What every supplier serves from some balance on: method, path, the prefix before all its routes, API, balance.
ROUTES = (("GET", "/orders/:param/f", None, "main", -1e4), ("POST", "/v1/orders/:param/f", "v1", "main", 2e3), ("GET", "/orders/:param/o", None, "main", 4e3), ("GET", "/orders/:param/o", None, "second", 6e3), ("ALL", "/orders/*", None, "rest", 8e3))


@query(
    "join_09_calls_in_stages",
    """with c0 as (select *, 'URL_' || c_nationkey || '_' || cast(floor(c_acctbal / 1000) as bigint) as url, cast(floor(c_acctbal / 1000) as bigint) as b from customer),
      c as (select o_orderkey as id, o_orderpriority as service, lower(o_orderstatus) as st, case when lower(o_orderstatus) = 'f' then 'POST' else 'GET' end as method, not (lower(o_orderstatus) = 'p' and o_totalprice > 3e5) and o_totalprice >= 5e4 as read,
        case when o_orderpriority not in ('4-NOT SPECIFIED', '5-LOW') then url end as env, o_orderpriority = '4-NOT SPECIFIED' and o_orderstatus = 'O' as host, case when o_orderpriority = '5-LOW' then c_mktsegment end as binding from orders join c0 on c_custkey = o_custkey),
      r as (select s_name as service, m, p, api, s_name || ' ' || m || ' ' || p || ' ' || api as id , prefix from supplier join (values ('GET', '/orders/:param/f', null, 'main', -1e4), ('POST', '/v1/orders/:param/f', 'v1', 'main', 2e3), ('GET', '/orders/:param/o', null, 'main', 4e3), ('GET', '/orders/:param/o', null, 'second', 6e3), ('ALL', '/orders/*', null, 'rest', 8e3)) t(m, p, prefix, api, least) on s_acctbal >= least),
      mk as (select l_orderkey as id, l_linenumber as ord, s_name as service from lineitem join supplier on s_suppkey = l_suppkey where l_discount >= 0.1 and l_quantity > 25),
      m as (select id, count(distinct (ord, service)) - 1 as also, min({'ord': ord, 'service': service}).service as service from mk group by 1),
      bd as (select c_mktsegment as binding, case when c_mktsegment < 'F' or lo = hi then lo end as target from (select c_mktsegment, min(c_nationkey) as n from customer group by 1) join (select s_nationkey as n, min(s_name) as lo, max(s_name) as hi from supplier group by 1) using (n)),
      cl as (select 'URL_' || s_nationkey || '_' || cast(floor(s_acctbal / 1000) as bigint) as env, count(distinct s_name) as n, min(s_name) as by_ from supplier group by 1),
      va as (select distinct url as env, case when b < 1 then 'external' else 'service' end as kind, case when b >= 3 or lo = hi then lo end as target, case when b > 4 then '/v1' end as start from c0 join (select s_nationkey as n, min(s_name) as lo, max(s_name) as hi from supplier group by 1) on n = c_nationkey where b < 7),
      ur as (select l_orderkey as id, min('fn:' || l_suppkey) as url, count(distinct l_suppkey) - 1 as more from lineitem where l_tax = 0 and l_linenumber <= 2 group by 1),
      x as (select c.*, bd.target as bt, bd.binding is not null as bd, coalesce(cl.n, 0) as n, cl.by_, case when c.service in ('1-URGENT', '2-HIGH') then va.kind end as kind, va.target as vt, va.start, ur.url, ur.more, m.service as ms, m.also from c left join bd using (binding) left join cl using (env) left join va using (env) left join ur using (id) left join m using (id)),
      y as (select *, case when binding is not null then case when bt is not null then 'ask' when not bd and st = 'p' then 'dynamic' else 'unknownBinding' end when env is null then case when host then 'external' else 'dynamic' end when n = 0 and url is not null then 'linked' when n = 0 and kind = 'external' then 'external' when (n = 0 and kind = 'service' and vt is not null) or n = 1 then 'ask' else 'unknownEnv' end as said,
        case when binding is not null then bt when n = 0 then vt else by_ end as goes, case when binding is not null then 'binding' when n = 0 and url is not null then 'functionUrl' when n = 0 then 'value' else 'env' end as way from x),
      sv as (select service, bool_or(p = '/v1/orders/:param/f') as post, bool_or(p = '/orders/:param/o' and api = 'main') as o1, bool_or(api = 'second') as o2, bool_or(api = 'rest') as rest from r group by 1),
      z as (select y.*, coalesce(start, '') = '/v1' and way = 'value' as whole, sv.post, sv.o1, sv.o2, sv.rest,
        case when st = 'f' then case when sv.rest then 'ALL /orders/* rest' when sv.post then 'POST /v1/orders/:param/f main' end when st = 'o' and sv.o2 then '2' when st = 'o' and sv.o1 then 'GET /orders/:param/o main' when sv.rest then 'ALL /orders/* rest' end as plain,
        case when st = 'f' and sv.post then 'POST /v1/orders/:param/f main' end as first from y left join sv on sv.service = goes)
    select id as call_id, case when ms is not null then 'linked' when said <> 'ask' then said when not read then 'dynamic' when (whole and first is not null) or plain not in ('2') then 'linked' when plain = '2' and not whole then 'ambiguous' else 'noRoute' end as outcome,
      case when ms is not null then 'marker' when said = 'linked' then 'functionUrl' when said = 'ask' and read and ((whole and first is not null) or plain not in ('2')) then way end as way, case when ms is not null then ms when said = 'ask' then goes end as target,
      case when ms is not null then ms || ' GET /orders/:param/f main' when said = 'linked' then url when said = 'ask' and read then case when whole and first is not null then goes || ' ' || first when plain <> '2' then goes || ' ' || plain end end as route_id,
      case when ms is not null then also when said = 'linked' then more else 0 end as also from z""",
)
def calls_in_stages(s, d):
    """The stages of outgoing calls over all orders; suppliers of some balance have the same route in two APIs, or one for all paths."""
    return G.outgoing_calls(*outgoing_tables(s, d))
