"""Statements, names, route classes, families, API choices, verdicts, gap sites, deploy reasons, SARIF and spec changes.

Each query makes its facts from a whole table by expressions that both engines read; the SQL works out the answer by itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audit as A
from ..operators import linking as L
from ..operators import shapes as H
from ..operators import specs as P
from ..operators import traverse as T
from ..sources import views as V
from .graph_queries import TR, WITH
from .link_queries import MATCH, calls, routes
from .registry import query
from .telemetry_queries import SP


def facts(s, d, table: str, **columns: str):
    """The named SQL expressions over a whole table."""
    return V.read(s, d, table).selectExpr(*[f"{sql} as {name}" for name, sql in columns.items()])


def said(table: str, **columns: str) -> str:
    return "select " + ", ".join(f"{sql} as {name}" for name, sql in columns.items()) + f" from {table}"


def pick(key: str, *values: str) -> str:
    """One of several SQL expressions by a number."""
    return "case " + " ".join(f"when {key} % {len(values)} = {i} then {v}" for i, v in enumerate(values)) + " end"


STATEMENTS = dict(
    k="o_orderkey",
    t=pick(
        "o_orderkey",
        "'WITH recent (a) AS MATERIALIZED (SELECT a FROM Orders_' || o_custkey || '), x AS (SELECT 1 FROM recent) SELECT * FROM x JOIN \"Sales\".\"Lines\" l ON 1 = 1'",
        "'insert into audit.log_' || (o_custkey % 10) || ' values (1, 2), (3, 4)'",
        "'UPDATE Loans SET state = 1 WHERE id = ' || o_custkey || ' AND state = 0'",
        "'update loans set state = 1 where id = 4 returning id'",
        "'delete from `carts` where id in (1, 2)'",
        "'truncate table [Old Rows]'",
        "'select * from a join b on a.id = b.id where a.id = any(' || o_custkey || ')'",
        "'call something(' || o_custkey || ')'",
    ),
)
#: Statements cut into tokens, and what their neighbours say; i counts tokens from 1.
TOKENS_SQL = r"""select k, list_transform(regexp_extract_all(t, '--[^\n]*|''[^'']*''|"[^"]*"|`[^`]*`|\[[^\]]*\]|\w[\w$]*|\S'), lambda x: case when regexp_matches(x, '^\w') then lower(x) else x end) as t from s"""
FOUND_SQL = r"""select *, list_filter(range(1, len(t) + 1), lambda i: t[i] in ('from', 'join') or (t[i] = 'into' and t[i - 1] = 'insert') or t[i] in ('update', 'truncate')) as named,
  list_filter(range(1, len(t) + 1), lambda i: coalesce(t[i - 1] in ('with', 'recursive', ','), false) and regexp_matches(t[i], '^[a-z_]') and (t[i + 1] = 'as' or (t[i + 1] = '(' and list_contains(t[i:], 'as') and t[i + list_position(t[i:], ')')] = 'as'))) as defined,
  list_filter(range(1, len(t) + 1), lambda i: t[i] in ('select', 'insert', 'update', 'delete') and t[i - 1] = ')') as verbs from x"""


@query(
    "fn_14_statements",
    f"with s as ({said('orders', **STATEMENTS)}), x as ({TOKENS_SQL}), f as ({FOUND_SQL})"
    r""" select k, case case when t[1] = 'with' then t[verbs[1]] else t[1] end when 'select' then 'read' when 'insert' then 'write' when 'update' then 'write' when 'delete' then 'delete' when 'truncate' then 'delete' end as operation,
      list_sort(list_distinct(list_filter(list_transform(named, lambda i: lower(replace(replace(replace(replace(case when t[i + 2] = '.' then t[i + 3] when t[i] = 'truncate' and t[i + 1] = 'table' then t[i + 2] else t[i + 1] end, '"', ''), '`', ''), '[', ''), ']', ''))), lambda v: not list_contains(list_transform(defined, lambda i: t[i]), v)))) as tables,
      len(list_filter(range(1, len(t)), lambda i: (t[i] in ('in', 'any', 'unnest') and t[i + 1] = '(') or (t[i] = ')' and t[i + 1] = ',' and t[i + 2] = '(' and list_contains(t, 'values')))) > 0 as batch,
      t[1] = 'update' and (list_contains(t, 'returning') or len(list_filter(range(1, len(t)), lambda i: t[i] = 'and' and t[i + 2] = '=' and list_position(t, 'where') < i)) > 0) as conditional from f""",
)
def statements(s, d):
    t = F.col("t")
    return facts(s, d, "orders", **STATEMENTS).select("k", S.sql_operation(t).alias("operation"), S.sql_tables(t).alias("tables"), S.sql_is_batch(t).alias("batch"), S.sql_is_conditional(t).alias("conditional"))


NAMES = dict(
    k="c_custkey",
    name=pick("c_custkey", "'isPublic'", "'AllowAnonymous'", "'skip_tenant_check'", "'verifyToken'", "'LibrarianAuth'", "'remember'", "'StrictAuth'", "'no-auth'", "'OpenAccess'", "'members_only'", "'parse'", "'JWTTokenReader'") + " || '_' || c_mktsegment",
)


#: Stated once more, so that a wrong list shows; words begin at a capital after another letter, before a small one, or after a sign.
STEMS_SQL = "['auth', 'verif', 'permission', 'access', 'allowed', 'entitle', 'role', 'member', 'employee', 'session', 'token', 'signature', 'credential']"
OPEN_SQL = "(public|anonymous|allow-?_?anon|guest|unauthenticated|no[_-]?auth|skip[_-]?auth|without[_-]?auth|open[_-]?access)"
SKIPS_SQL = "(skip|bypass|ignore|exclude|exempt|disable|optional|allow|without|public|anonymous|guest|unauth|no[_-]?auth|open[_-]?access)"


@query(
    "fn_18_access_names",
    f"with n as ({said('customer', **NAMES)}), c as (select *, string_split(name, '') as c from n)"
    f" select k, regexp_matches(lower(name), '{OPEN_SQL}') as public, regexp_matches(lower(name), '{SKIPS_SQL}') as opt_out,"
    " len(list_filter(range(1, len(c) + 1), lambda i: (i = 1 or not regexp_matches(c[i - 1], '[A-Za-z]') or (regexp_matches(c[i], '[A-Z]') and (regexp_matches(c[i - 1], '[a-z]') or coalesce(regexp_matches(c[i + 1], '[a-z]'), false))))"
    f" and len(list_filter({STEMS_SQL}, lambda s: starts_with(lower(substr(name, i::int)), s))) > 0)) > 0 as auth_check from c",
)
def access_names(s, d):
    n = F.col("name")
    return facts(s, d, "customer", **NAMES).select("k", S.sounds_public(n).alias("public"), S.sounds_like_opt_out(n).alias("opt_out"), S.sounds_like_auth_check(n).alias("auth_check"))


ROUTE_FACTS = dict(
    k="p_partkey",
    method=pick("p_size", "'GET'", "'POST'", "'PUT'"),
    path=pick(
        "p_partkey", "'/health'", "'/api/v1/status'", "'/orders/payment-status'", "'/a/b/c/_db-status'", "'/.well-known/' || p_size", "'/users/1/notifications'", "'/oauth/callback'", "'/Webhooks/stripe'",
        "'/orders/stream'", "'/orders/live-stream'", "'/orders/' || p_size", "'/public/things/' || p_size", "'/internal/x'", "'/orders'", "'/'",
    ),
    handler=pick("p_size", "'stripeWebhook'", "'fetchWebhookSettings'", "'list'", "'onCallbackDone'", "null", "'healthProbe'", "'get'"),
    controller=pick("p_partkey", "'HealthController'", "'OrdersController'", "null", "'PaymentsCallbackController'"),
    decorator=pick("p_partkey", "null", "'HealthCheck'", "'Get'", "'Cron'", "'Post'", "'Get'", "'Put'", "'Get'", "'Get'", "'Get'", "'Get'"),
    public_note="case when p_partkey % 13 = 0 then 'why' end",
)


@query(
    "gra_05_route_facts",
    f"with r as ({said('part', **ROUTE_FACTS)}), x as (select *, lower(regexp_extract(path, '([^/]*)$', 1)) as last, list_filter(string_split(lower(path), '/'), lambda v: v <> '') as p from r),"
    r""" n as (select *, list_filter(p, lambda v: v in ('webhook', 'webhooks', 'hooks', 'callback', 'callbacks') or (v in ('notify', 'notifications') and method <> 'GET'))[1] as got,
      case when suffix(handler, 'Webhook') then 'webhook' when starts_with(handler, 'onCallback') then 'callback' when suffix(handler, 'Probe') then 'probe'
        when controller = 'HealthController' then 'probe' when controller = 'PaymentsCallbackController' then 'callback' end as named from x),
    c as (select *, case when path like '/public/%' then 'declared||configuration' when public_note is not null then 'declared||note'
      when path like '/internal/%' or decorator = 'Cron' or coalesce(controller, '') || '.' || coalesce(handler, '') = 'OrdersController.get' then 'infrastructure|configured|configuration'
      when decorator = 'HealthCheck' then 'infrastructure|probe|decorator' when regexp_matches(last, '^_.*(status|health)$') or (len(p) <= 2 and (last in ('health', 'status') or suffix(last, '-status'))) then 'infrastructure|probe|path'
      when p[1] = '.well-known' then 'infrastructure|discovery|path' when got is not null then 'infrastructure|' || (case when starts_with(got, 'callback') then 'callback' else 'webhook' end) || '|path'
      when named is not null then 'infrastructure|' || named || '|name' when last = 'stream' or suffix(last, '-stream') then 'stream||path' else 'actionable||none' end as told from n)
    select k, split_part(told, '|', 1) as class, nullif(split_part(told, '|', 2), '') as role, split_part(told, '|', 3) as rule from c""",
)
def route_facts(s, d):
    r = facts(s, d, "part", **ROUTE_FACTS).withColumn("decorators", F.array_compact(F.array("decorator")))
    told = A.classify_routes(r, public=("/public/**",), paths=("/internal/*",), decorators=("Cron",), names=("OrdersController.get",))
    return told.select("k", "class", "role", "rule")


BOXES = dict(k="p_partkey", service="p_brand", name=pick("p_partkey", "replace(p_name, ' ', '-')", "replace(p_name, ' ', '.') || '.' || lower(p_type)", "'@' || replace(p_name, ' ', '/')", "lower(p_type)", "'pay-' || p_size"))


@query(
    "gra_23_families",
    f"with b as ({said('part', **BOXES)}), "
    r"x as (select *, nullif(regexp_extract(name, '^([-_./@:]*[^-_./@:]+[-_./@:]+[^-_./@:]+[-_./@:]+)[^-_./@:]', 1), '') as two, nullif(regexp_extract(name, '^([-_./@:]*[^-_./@:]+[-_./@:]+)[^-_./@:]', 1), '') as one from b), "
    "y as (select *, case when count(two) over (partition by service, two) >= 3 then two end as a from x), z as (select *, case when a is null then one end as rest from y) "
    "select k, coalesce(a, case when count(rest) over (partition by service, rest) >= 3 then rest end, '') as family from z",
)
def families(s, d):
    return A.families(facts(s, d, "part", **BOXES), ["service"]).select("k", "family")


CANDIDATES = dict(
    call="o_orderkey",
    setting=pick("o_custkey", "'BILLING_API_URL'", "'ordersServiceUrl'", "'STOCK_HOST'", "'API_URL'", "'billing_orders_url'"),
    api=pick("j", "case when o_orderkey % 17 = 0 then null else 'stock-api' end", "'billing-api'", "'ordersApi'", "'ledger'"),
    entry="j",
)
GENERIC = ", ".join(f"'{w}'" for w in A.GENERIC)
WORDS = r"list_filter(string_split_regex(lower(regexp_replace({}, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda w: w <> '' and w not in (" + GENERIC + "))"


@query(
    "join_20_api_choice",
    f"with o as (select *, unnest(range(1, 2 + o_orderkey % 5)) as j from orders), c as ({said('o', **CANDIDATES)}), a as (select call, api, count(*) as entries, min(entry) as entry, len(list_intersect({WORDS.format('api')}, {WORDS.format('min(setting)')})) as score from c group by call, api),"
    " w as (select *, max(score) over (partition by call) as best, count(*) over (partition by call) as apis, bool_or(api is null) over (partition by call) as unread from a), v as (select *, count(*) over (partition by call) as winners from w where coalesce(score, -1) = coalesce(best, -1)),"
    " u as (select call, any_value(apis) as apis, any_value(unread) or any_value(apis) < 2 as none, any_value(winners) = 1 and any_value(best) > 0 as sure, min(api) as api, min(entry) as entry, min(entries) as entries from v group by 1)"
    " select call, case when none then 'none' when not sure then 'tie' when entries > 1 then 'narrowed' else 'one' end as outcome, case when not none and sure then api end as api, case when not none and sure and entries = 1 then entry end as entry, case when not none and sure then entries end as entries, apis from u",
)
def api_choice(s, d):
    o = V.read(s, d, "orders").withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), 1 + F.col("o_orderkey") % 5)))
    return A.choose_api(o.selectExpr(*[f"{sql} as {name}" for name, sql in CANDIDATES.items()]))


PROVIDERS = dict(id="'provider:' || p_partkey", service="p_brand", label="p_name", kind=pick("p_size", "'external'", "'controller'", "'class'", "'class'", "'class'", "'class'"))
METHODS = dict(id="'method:' || l_partkey || '.' || l_orderkey || '.' || l_linenumber", owner="'provider:' || l_partkey", calls="l_quantity > 47", injects="l_discount > 0.08 and l_returnflag = 'R' and l_tax < 0.02")
CODE = f"""with p as ({said("part", **PROVIDERS)}), m as (select id, owner, bool_or(calls) as called, bool_or(injects) as injected from ({said("lineitem", **METHODS)}) group by 1, 2),
  x as (select distinct p_brand as service, p_name as label from part where p_size = 7), g as (select distinct p_brand as service from part where p_brand like '%2'),
  v as (select id, service, kind, case when kind = 'external' then 'library' when (service, label) in (select (service, label) from x) then 'exported' when id in (select owner from m where injected) then 'injected'
    when id in (select owner from m where called) then 'methods reached' when service in (select service from g) then 'not reached, injections unresolved' else 'not reached' end as reason from p),
  verdicts as (select *, case reason when 'library' then 'unknown' when 'exported' then 'unknown' when 'injected' then 'alive' when 'methods reached' then 'alive' when 'not reached' then 'dead' else 'likely-dead' end as verdict from v) """


def code(s, d):
    """(providers, methods, edges, exported, gaps): every part a class, every line a method of it."""
    p, lines = facts(s, d, "part", **PROVIDERS), facts(s, d, "lineitem", **METHODS)
    edge = lambda cond, to, kind: lines.filter(cond).select(F.lit("x").alias("from_id"), F.col(to).alias("to_id"), F.lit(kind).alias("type"))
    edges = edge("calls", "id", "calls").unionByName(edge("injects", "owner", "injects"))
    part = V.read(s, d, "part")
    exported = part.filter("p_size = 7").select(F.col("p_brand").alias("service"), F.col("p_name").alias("label"))
    gaps = part.filter("p_brand like '%2'").groupBy(F.col("p_brand").alias("service")).agg(F.count("*").alias("n"))
    return p, lines.select("id", "owner").distinct(), edges, exported, gaps


@query("gra_08_provider_verdicts", CODE + "select id, service, kind, verdict, reason from verdicts")
def provider_verdicts(s, d):
    return A.provider_verdicts(*code(s, d))


@query("gra_09_method_verdicts", CODE + "select m.id, case when called then 'alive' when v.verdict in ('alive', 'unknown') then 'likely-dead' else v.verdict end as verdict, case when called then 'called' when v.verdict = 'alive' then 'class used' when v.verdict = 'unknown' then 'class reached from outside' else 'class not reached' end as reason from m join verdicts v on v.id = m.owner")
def method_verdicts(s, d):
    p, m, edges, exported, gaps = code(s, d)
    return A.method_verdicts(m, edges, A.provider_verdicts(p, m, edges, exported, gaps))


@query("gra_10_liveliest_route", CODE + ", r as (select service as controller, id as route, verdict, case verdict when 'alive' then 0 when 'unknown' then 1 when 'likely-dead' then 2 else 3 end as o from verdicts), k as (select *, row_number() over (partition by controller order by o, route) as n, count(*) over (partition by controller) as routes from r) select controller, verdict, route, routes from k where n = 1")
def liveliest(s, d):
    """Each service as a controller whose routes are its classes."""
    v = A.provider_verdicts(*code(s, d))
    return A.controller_verdicts(v.select(F.col("service").alias("controller"), F.col("id").alias("route")), v.select(F.col("id").alias("route"), "verdict"))


@query("str_12_overlay", CODE + ", q as (select 'provider:' || l_partkey as id, count(*) as n from lineitem where l_shipdate >= timestamp '2000-06-01' group by 1) select id, case when q.n is not null then 'alive' when verdict = 'unknown' and kind = 'external' then 'likely-dead' else verdict end as verdict, case when q.n is not null then 'seen' when kind <> 'controller' then 'never-seen' end as evidence from verdicts left join q using (id)")
def traffic_overlay(s, d):
    """Lines shipped lately are traffic; a class without is never seen, a library's class from outside only."""
    v = A.provider_verdicts(*code(s, d))
    seen = V.read(s, d, "lineitem").filter("l_shipdate >= timestamp_ntz'2000-06-01'").groupBy(F.concat(F.lit("provider:"), F.col("l_partkey").cast("string")).alias("id")).agg(F.count("*").alias("count"))
    outside = F.when(F.col("kind") == "external", "outside").otherwise("inside").alias("reachable_from")
    never = v.filter("kind <> 'controller'").join(seen, "id", "left_anti").select("id", outside, F.lit("strong").alias("confidence"))
    return A.overlay(v, seen, never).select("id", "verdict", "evidence")


SITES = dict(gap="l_suppkey", saying="l_returnflag || l_linestatus", sites="case when l_linenumber = 1 then cast(l_quantity as int) + 2 else 1 end", w="case when l_shipdate < timestamp '1998-01-01' then 0 else 1 end")


@query(
    "join_24_site_match",
    f"with x as ({said('lineitem', **SITES)}), s as (select gap, saying, coalesce(sum(sites) filter (w = 0 and sites = 1), 0) as b, coalesce(sum(sites) filter (w = 1 and sites = 1), 0) as h from x group by 1, 2),"
    " f as (select gap, coalesce(sum(sites) filter (w = 0 and sites > 1), 0) as fb, coalesce(sum(sites) filter (w = 1 and sites > 1), 0) as fh from x group by 1),"
    " t as (select gap, sum(b) as b, sum(h) as h, sum(least(b, h)) as k from s group by 1), u as (select gap, fb, fh, k, least(b - k, fh) as ih, least(h - k, fb) as ib, b, h from t join f using (gap))"
    " select gap, cast(h + fh - (k + ih + ib + least(fb - ib, fh - ih)) as bigint) as added, cast(b + fb - (k + ih + ib + least(fb - ib, fh - ih)) as bigint) as removed, cast(k + ih + ib + least(fb - ib, fh - ih) as bigint) as kept from u",
)
def site_match(s, d):
    x = facts(s, d, "lineitem", **{**SITES, "w": SITES["w"].replace("timestamp '", "timestamp_ntz'")})
    return A.match_sites(x.filter("w = 0"), x.filter("w = 1"))


STATE = "case when {} then 'existing' else 'new' end"
FINDINGS = dict(state=STATE.format("o_orderstatus = 'F'"), code="o_orderpriority", key="'o' || o_orderkey", severity="case when o_orderpriority like '1%' then 'error' else 'warning' end")
BROKEN = dict(state=STATE.format("c_acctbal < 0"), code="c_mktsegment", key="'c' || c_custkey", severity="case when c_nationkey < 12 then 'error' else 'warning' end", heuristic="c_nationkey % 2 = 0")
LOST = dict(code="case when s_acctbal < 0 then 'target-gone' else 'no-consumer' end", key="'s' || s_suppkey", heuristic="s_nationkey % 2 = 0")
REASONS = f"""with c as ({said("orders", **FINDINGS)}), r as ({said("customer", **BROKEN)}), j as ({said("supplier", **LOST)}),
  reasons as (select 'contract' as kind, code, key, false as heuristic, state = 'existing' as already from c where severity = 'error' union all select 'rule', code, key, heuristic, state = 'existing' from r where severity = 'error' and not heuristic
    union all select 'join', code, key, heuristic, false from j union all select 'join', 'no-target', 'p' || p_partkey, false, false from part where p_size = 50) """


def reasons(s, d):
    asked = V.read(s, d, "part").filter("p_size = 50").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"))
    return A.check_reasons(facts(s, d, "orders", **FINDINGS), facts(s, d, "customer", **BROKEN), facts(s, d, "supplier", **LOST), asked)


@query("dif_08_reasons_listed", REASONS + "select * from reasons")
def reasons_listed(s, d):
    return reasons(s, d)


@query("dif_07_verdict", REASONS + "select case when count(*) filter (not already) > 0 then 'unsafe' else 'unknown' end as verdict, count(*) filter (kind = 'contract' and not already) as contracts, count(*) filter (kind = 'rule' and not already) as rules, count(*) filter (kind = 'join' and code in ('target-gone', 'no-target')) as targets, count(*) filter (kind = 'join' and code = 'no-consumer') as ends, (select count(*) from nation) as unread, (select count(*) from region) as gaps from reasons")
def verdict(s, d):
    return A.safety(reasons(s, d), V.read(s, d, "nation"), V.read(s, d, "region"))


RESULTS = dict(rule="'r-' || event_type", level="case event_type when 'error' then 'error' when 'click' then 'warning' when 'view' then 'note' else 'none' end", uri="'src/' || (user_id % 10) || '.ts'", line="event_id % 100", message="'event ' || event_id", key="'u' || (user_id % 50)")


@query(
    "snk_06_sarif",
    f"with f as ({said('events', **RESULTS)}), r as (select *, case level when 'error' then 1 when 'warning' then 2 else 3 end as k from f where level <> 'none'), t as (select *, row_number() over (order by k, uri, line, rule, key, message) as n, count(*) over () as total from r),"
    " u as (select *, dense_rank() over (order by rule) - 1 as rule_index, row_number() over (partition by rule, key order by n) as occurrence from t where n <= 5000)"
    " select cast(n - 1 as int) as place, rule, rule_index, level, uri, line, message, sha256(rule || '|' || key) || ':' || occurrence as print, case when total > 5000 then (total - 5000) || ' results left out by the bound on this output' end as cut from u",
)
def sarif_log(s, d):
    """The written log, read back: a row for each of its results."""
    log = "version string, runs array<struct<invocations: array<struct<toolExecutionNotifications: array<struct<message: struct<text: string>>>>>, results: array<struct<ruleId: string, ruleIndex: bigint, level: string, message: struct<text: string>, locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: bigint>>>>, partialFingerprints: map<string, string>>>>>"
    run = A.sarif(facts(s, d, "events", **RESULTS)).select(F.from_json("document", log)["runs"][0].alias("run"))
    cut = F.try_element_at(F.col("run.invocations")[0]["toolExecutionNotifications"], F.lit(1))["message"]["text"]
    x = run.select(cut.alias("cut"), F.posexplode("run.results").alias("place", "r"))
    at = F.col("r.locations")[0]["physicalLocation"]
    return x.select(
        "place", F.col("r.ruleId").alias("rule"), F.col("r.ruleIndex").alias("rule_index"), "r.level", at["artifactLocation"]["uri"].alias("uri"), at["region"]["startLine"].alias("line"),
        F.col("r.message.text").alias("message"), F.col("r.partialFingerprints")["findingKey/v1"].alias("print"), "cut",
    )


#: Parts of an operation by case (number of the part modulo 24) and side.
PARTS = [
    (6, "b", "request", None, "body.a", "string", True), (6, "h", "request", None, "body.a", "string", False),
    (7, "h", "request", None, "query.n", "string", False), (8, "h", "request", None, "query.n", "string", True), (9, "b", "request", None, "body.a", "string", False),
    (10, "b", "request", None, "body.a", "string", False), (10, "h", "request", None, "body.a", "number", False),
    *[(c, side, "success", None, "200", "", False) for c in range(11, 16) for side in "bh"],
    (11, "b", "response", "200", "total", "string", False), (12, "b", "response", "200", "total", "string", False), (12, "h", "response", "200", "total", "number", False),
    (13, "b", "response", "200", "total", "string", False), (13, "h", "response", "200", "total", "string", True), (14, "h", "response", "200", "more", "string", True), (15, "h", "response", "200", "more", "string", False),
    (16, "b", "success", None, "200", "", False), (16, "h", "success", None, "201", "", False), (16, "b", "response", "200", "total", "string", False),
    (17, "h", "failure", None, "404", "missing", False), (18, "b", "failure", None, "404", "missing", False), (18, "h", "failure", None, "404", "gone", False),
    (19, "b", "guard", None, "A", "", False), (19, "h", "guard", None, "A", "", False), (19, "h", "guard", None, "B", "", False),
    *[(c, side, "message", None, "payload", "object", False) for c in (20, 21, 22) for side in "bh"],
    (20, "b", "message", None, "payload.a", "string", False), (21, "b", "message", None, "payload.a", "string", False), (21, "h", "message", None, "payload.a", "Date", False),
    (22, "b", "message", None, "payload.a", "string", False), (22, "h", "message", None, "payload.a", "string", True), (22, "h", "message", None, "payload.b", "string", True),
]
KIND = "case when p_partkey % 24 in (3, 20, 21, 22) then 'send' when p_partkey % 24 = 4 then 'receive' else 'http' end"


def side(method: str, path: str) -> dict:
    return dict(
        document="p_brand", kind=KIND, method=method, path=path, channel="'ch' || p_partkey", callers="cast(p_size % 3 as bigint)", public="p_size % 7 = 0", c="p_partkey % 24",
        op=f"case {KIND} when 'http' then {method} || ' ' || {path} else {KIND} || ' ch' || p_partkey end",
    )


OPS_B = side("'GET'", "'/p' || p_partkey || '/items'")
OPS_H = side("case when p_partkey % 24 = 1 then 'PUT' else 'GET' end", "case when p_partkey % 24 = 2 then '/p' || p_partkey || '/:param/items' else '/p' || p_partkey || '/items' end")


@query(
    "spc_01_change_kinds",
    f"""with b as ({said("part", **OPS_B)}), h as ({said("part", **OPS_H)}), e(c, change, field) as (values (0, 'endpoint-removed', null), (1, 'method-removed', null), (2, 'path-param-added', null), (3, 'channel-removed', null), (4, 'channel-consumer-removed', null),
      (6, 'request-property-became-required', 'body.a'), (7, 'request-property-added-required', 'query.n'), (8, 'optional-property-added', 'query.n'), (9, 'request-property-removed', 'body.a'), (10, 'request-property-type-changed', 'body.a'), (11, 'response-property-removed', 'total'),
      (12, 'response-property-type-changed', 'total'), (13, 'response-property-became-optional', 'total'), (14, 'optional-property-added', 'more'), (16, 'response-status-removed', 'status 200'), (17, 'response-status-added', 'status 404'), (18, 'description-changed', 'status 404'),
      (19, 'security-added', 'guards'), (20, 'message-property-removed', 'payload.a'), (21, 'message-property-type-changed', 'payload.a'), (22, 'message-property-became-optional', 'payload.a'), (22, 'optional-property-added', 'payload.b'))
    select document, kind, op, field, change, case when change in ('request-property-removed', 'response-status-added', 'security-added', 'channel-consumer-removed') then 'warning' when change in ('optional-property-added', 'description-changed') then 'info' when callers = 0 and not public then 'warning' else 'error' end as level,
      change not in ('request-property-removed', 'response-status-added', 'security-added', 'channel-consumer-removed', 'optional-property-added', 'description-changed') and callers = 0 and not public as uncalled from b join e using (c)
    union all select document, kind, op, null, 'endpoint-added', 'info', false from h where c in (1, 5)""",
)
def change_kinds(s, d):
    """Every part is an operation of its brand's document; by its number it changes in one of 24 ways between the revisions."""
    parts = s.createDataFrame(PARTS, "c long, side string, part string, status string, field string, type string, optional boolean")
    b, h = facts(s, d, "part", **OPS_B).filter("c <> 5"), facts(s, d, "part", **OPS_H).filter("c not in (0, 3, 4)")
    of = lambda ops, w: ops.select("document", "kind", "op", "c").join(F.broadcast(parts.filter(F.col("side") == w)), "c").drop("c", "side")  # noqa: E731  (the list above)
    return P.spec_changes(b, h, of(b, "b"), of(h, "h"))


GUARDED = dict(
    route="'r' || c_custkey", method="'GET'", path=pick("c_nationkey", "'/open/' || c_custkey", "'/items/' || c_custkey", "'/items'"), controller=pick("c_custkey", "'Ctl'", "null"),
    public_note=pick("c_custkey", "null", "null", "null", "null", "null", "null", "null", "''", "'partners'"), auth_note="case when c_custkey % 11 = 3 then 'signed' end", open="c_custkey % 13 = 5",
    refuses="c_custkey % 7 = 1", middleware_read="c_custkey % 17 <> 2",
)
GATES = dict(route="'r' || o_custkey", layer=pick("o_orderkey", "'guard'", "'middleware'", "'pipe'", "'guard'", "'guard'"), skipped_by="case when o_orderkey % 5 in (0, 1, 3) then 'Open' end")
HANDLERS = dict(route="'r' || o_custkey", label=pick("o_orderkey", "'Ctl.get'", "'worker'", "'Ctlx.get'"))
FEW, MANY, HELD = "o_totalprice > 140000", "o_orderstatus = 'P'", "o_totalprice < 100000"


@query(
    "gra_15_audit_rows",
    f"with r as ({said('customer', **GUARDED)}), g as (select * from ({said('orders where ' + FEW, **GATES)}) where layer in ('guard', 'middleware')), h as (select x.route, bool_or(x.label like 'Ctl.%' and r.controller is not null) as app, bool_or(not (x.label like 'Ctl.%' and r.controller is not null)) as other from ({said('orders where ' + MANY, **HANDLERS)}) x join r using (route) group by 1),"
    f" f as (select * from r where route not in (select route from g where layer = 'middleware' or skipped_by is null)), d as (select distinct 'r' || o_custkey as route from orders where {HELD})"
    " select route, 'route-shadowed' as reason, 'action' as level from h where app and other union all select route, case when public_note = '' then 'marker-reason-missing' when public_note is not null then 'route-public-declared' when auth_note is not null then 'route-guard-skipped' when refuses then 'route-checked-in-body' when not middleware_read then 'route-unguarded' when route in (select route from g) then 'route-guard-skipped' else 'route-unguarded' end,"
    " case when public_note is null and auth_note is null and not refuses and middleware_read and route not in (select route from g) then 'action' else 'info' end from f where public_note is not null or (not open and path not like '/open/%' and route in (select route from d))",
)
def audit_rows(s, d):
    """Every customer is a route; its dear orders are gates, its open ones handlers, its cheap ones the data it comes to."""
    o = V.read(s, d, "orders")
    of = lambda where, columns: o.filter(where).selectExpr(*[f"{sql} as {name}" for name, sql in columns.items()])
    return A.route_audit(facts(s, d, "customer", **GUARDED), of(FEW, GATES), of(MANY, HANDLERS), of(HELD, {"route": GATES["route"]}), public=("GET /open/**",))


GAPS = dict(service="'s' || l_suppkey", reason=pick("l_partkey", "'call-through-token'", "'call-module-ref'", "'di-token-unknown'", "'other'", "'di-token-ambiguous'"), cause="case when l_linenumber = 2 then 'own' when l_linenumber = 3 then '' end", package="case when l_returnflag = 'R' then 'pkg' || l_tax end", sites="case when l_linestatus = 'F' then l_linenumber end")


@query(
    "gra_24_cause_parts",
    f"with g as ({said('lineitem', **GAPS, listed='l_linenumber = 5')}), p as (select service, case when nullif(cause, '') is not null then cause when reason = 'call-through-token' then 'untyped-di-token' when reason = 'call-module-ref' then 'container-lookup' when reason = 'di-token-unknown' then 'token-not-provided' when reason = 'di-token-ambiguous' then 'token-ambiguous' else reason end as cause, package, coalesce(sites, 1) as sites from g where not listed"
    " union all select service, 'a', null, 2 from g where listed union all select service, 'b', 'q', 3 from g where listed) select service, cause, package, cast(sum(sites) as bigint) as sites, count(*) as rows from p group by 1, 2, 3",
)
def cause_parts(s, d):
    listed = "case when l_linenumber = 5 then array(named_struct('cause', 'a', 'package', cast(null as string), 'sites', 2), named_struct('cause', 'b', 'package', 'q', 'sites', 3)) end"
    return A.folded_causes(facts(s, d, "lineitem", **GAPS, causes=listed), ["service"])


@query(
    "gra_25_busiest_blind_spots",
    SP + ', g as (select service, entry as kind, k as name, count(*) as n, max("at") as t from spans group by 1, 2, 3), r as (select *, row_number() over (partition by service, kind order by n desc, name) as o from g)'
    " select service, kind, cast(sum(n) as bigint) as count, count(*) as places, max(t) as last_seen, list(name order by o) filter (o <= 3) as names, greatest(count(*) - 3, 0) as more from r group by 1, 2",
)
def busiest_blind_spots(s, d):
    x = V.spans(s, d).select("service", F.col("entry").alias("kind"), F.col("k").alias("name"), F.lit(1).alias("count"), F.col("at").alias("last_seen"))
    return A.blind_spots(x, 3).withColumn("names", F.col("names.name"))


def bodies(s, d):
    """(entry, body): events as nested bodies; by their number a key is left out, null or of another type."""
    i = F.col("event_id")
    tag = F.when(i % 5 == 0, F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit(1).alias("w")), F.struct(F.lit("x").alias("name"), F.lit(2).alias("w"))))
    body = F.to_json(F.struct(i.alias("id"), F.when(i % 3 == 0, F.struct(F.col("user_id").alias("uid"), F.when(i % 2 == 0, "a").alias("role"))).alias("user"), tag.alias("tags"), F.when(i % 7 == 0, F.lit("late")).alias("note")))
    mixed = F.when(i % 11 == 0, F.regexp_replace(body, r'"id":(\d+)', r'"id":"$1"')).when(i % 23 == 0, F.lit("{")).otherwise(body)
    return V.read(s, d, "events").select(F.col("event_type").alias("entry"), mixed.alias("body"))


SHAPES = """with e as (select event_type as entry, event_id as i from events where event_id % 23 <> 0 or event_id % 11 = 0),
  p as (select entry, '' as path, 'object' as t from e union all select entry, 'id', case when i % 11 = 0 then 'string' else 'number' end from e union all select entry, 'user', 'object' from e where i % 3 = 0 union all select entry, 'user.uid', 'number' from e where i % 3 = 0
    union all select entry, 'user.role', 'string' from e where i % 6 = 0 union all select entry, 'tags', 'array' from e where i % 5 = 0 union all select entry, 'tags[]', 'object' from e where i % 5 = 0 union all select entry, 'tags[].w', 'number' from e where i % 5 = 0
    union all select entry, 'tags[].name', 'string' from e where i % 5 = 0 union all select entry, 'note', 'string' from e where i % 7 = 0),
  g as (select entry, path, list_sort(list(distinct t)) as types, count(*) as n from p group by 1, 2), s as (select g.*, u.n as of from g join g u on u.entry = g.entry and u.path = regexp_extract(g.path, '^(.*)\\.[^.]*$', 1)) """


@query("agg_18_body_shapes", SHAPES + "select entry, path, types, n, of, n < of and not suffix(path, '[]') as optional from s")
def shapes_of_bodies(s, d):
    return H.body_shapes(bodies(s, d), ["entry"])


@query("fn_21_shape_at", SHAPES + "select entry, path, types, n from s where path = 'tags[].w'")
def shape_at(s, d):
    return H.shape_at(H.body_shapes(bodies(s, d), ["entry"]), "tags[].w").select("entry", "path", "types", "n")


DECLARED = [("id", "number", False), ("user", "User", False), ("user.uid", "number", False), ("user.age", "number", True), ("user.name", "string", False), ("tags", "Tag[]", True), ("tags[].name", "string", False), ("note", "boolean | null", True), ("never", "string", True), ("absent.deep", "string", False)]


@query(
    "con_07_traffic_compared",
    SHAPES + ", d(path, type, opt) as (values ('id', 'number', false), ('user', 'object', false), ('user.uid', 'number', false), ('user.age', 'number', true), ('user.name', 'string', false), ('tags', 'array', true), ('tags[].name', 'string', false), ('note', 'boolean', true), ('never', 'string', true)),"
    " h as (select entry, path as parent, n as held from g), w as (select distinct entry from g), x as (select d.*, w.entry, s.types, s.n, coalesce(s.of, h.held) as of from d cross join w left join s on s.entry = w.entry and s.path = d.path left join h on h.entry = w.entry and h.parent = regexp_extract(d.path, '^(.*)\\.[^.]*$', 1))"
    " select entry, path, 'missing_required' as kind, 'warning' as severity, 0 as seen, of from x where n is null and not opt and of > 0 union all select entry, path, 'declared_never_sent', 'info', 0, of from x where n is null and opt and of >= 10 union all select entry, path, 'optionality_mismatch', 'warning', n, of from x where not opt and n < of"
    " union all select entry, path, 'type_mismatch', 'warning', n, of from x where n is not null and types <> [type] union all select entry, path, 'extra_field', 'info', n, of from s where path in ('user.role', 'tags[].w')",
)
def traffic_compared(s, d):
    shapes = H.body_shapes(bodies(s, d), ["entry"])
    declared = V.read(s, d, "events").select(F.col("event_type").alias("entry")).distinct().select("entry", F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("type"), F.lit(o).alias("optional")) for p, t, o in DECLARED])).alias("x")).select("entry", "x.*")
    return H.compare_traffic(shapes, declared, ["entry"], least=10)


@query(
    "trv_06_walk_back",
    WITH + f", t as {TR}, m as (select 'nation:3' as id, 0 as k union select t.from_id, k + 1 from m join t on t.to_id = m.id where k < 40), r as (select id, min(k) as depth from m group by 1), f as (select 1 as d union select 1 + (select count(*) from r where r.depth <= f.d and cast(split_part(r.id, ':', 2) as int) % 4 = 0) from f) select id, cast(depth as int) as depth, cast((select max(d) from f) as int) as walked from r where depth <= (select max(d) from f)",
)
def walk_back(s, d):
    """Back from one nation; every fourth nation is a workflow's step, which lengthens the walk by a hop."""
    t = V.trade_edges(s, d)
    steps = V.nodes(s, d).filter("type = 'nation'").filter(F.substring_index("id", ":", -1).cast("int") % 4 == 0)
    got, depth = T.walk_back(t, s.createDataFrame([("nation:3",)], "id string"), steps, 1)
    return got.select("id", "depth", F.lit(depth).alias("walked"))


USES = dict(
    from_id="'a' || l_orderkey", to_id="'b' || l_linenumber", type=pick("l_linenumber", "'handles'", "'calls'", "'hits'", "'emits'", "'queries'"),
    params="'Array<type:p' || (l_partkey % 50) || '>'", returns="case when l_returnflag = 'R' then 'Promise<type:p' || (l_suppkey % 50) || '|type:p' || (l_partkey % 50) || '>' end",
)


@query(
    "agg_15_type_uses",
    f"with e as ({said('lineitem', **USES, p='l_partkey % 50', q='l_suppkey % 50')}), u as (select 'type:p' || p as type, type as k, 'params' as side from e union all select 'type:p' || q, type, 'returns' from e where returns is not null union all select 'type:p' || p, type, 'returns' from e where returns is not null and p <> q),"
    " g as (select type, case k when 'handles' then case side when 'params' then 'taking' else 'returning' end when 'calls' then 'calls' when 'hits' then 'crossings' when 'emits' then 'channels' end as used_by from u where k <> 'queries' union all select 'type:p' || (p_size % 50), 'nested' from part where p_size % 50 <> p_partkey % 50)"
    " select type, used_by, count(*) as n from g group by 1, 2",
)
def type_uses(s, d):
    held = V.read(s, d, "part").selectExpr("'type:p' || (p_partkey % 50) as id", "array('type:p' || (p_size % 50)) as refs")
    return A.type_usage(facts(s, d, "lineitem", **USES), held).groupBy("type", "used_by").agg(F.count("*").alias("n"))


@query(
    "gra_16_rank_missing",
    "with h as (select page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host, url from pages), x as (select *, regexp_replace(regexp_replace(lower(host), '[^a-z0-9]+', '', 'g'), '(service|svc|api)$', '') as key from h where host <> ''),"
    " k as (select key, 'channel' as kind from x union all select key, 'host' from x where starts_with(url, 'https') union all select key, 'package' from x where contains(url, '?')), g as (select key, kind, count(*) as n from k group by 1, 2)"
    " select key, count(*) as score, cast(sum(n) as bigint) as places, list(kind order by kind) as kinds, count(*) >= 2 or bool_or(kind = 'host') as worth from g where key not in (select key from x where page_id % 11 = 0) group by 1",
)
def rank_missing(s, d):
    """Hosts of pages as signals of up to three kinds; those of every eleventh page are configured services."""
    p = V.read(s, d, "pages").withColumn("host", F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)).filter("host <> ''")
    kinds = F.array_compact(F.array(F.lit("channel"), F.when(F.col("url").startswith("https"), "host"), F.when(F.col("url").contains("?"), "package")))
    x = p.select(F.explode(kinds).alias("kind"), F.col("host").alias("name"), F.col("host").alias("token"), F.col("page_id").alias("place"))
    return A.rank_missing(x, p.filter("page_id % 11 = 0").select(F.col("host").alias("name")))


@query("snk_09_inventory_rows", MATCH + ", u as (select unnest(candidates) as route_id, c.app as caller from g join calls c using (call_id)), n as (select route_id, count(distinct caller) as callers from u group by 1) select route_id, app, upper(method) as method, path, route_id % 3 = 0 as guarded, coalesce(callers, 0) as callers from routes left join n using (route_id)")
def inventory_rows(s, d):
    r, c = routes(s, d), calls(s, d)
    hits = L.match_routes(c, r).select("call_id", F.explode("candidates").alias("route_id")).join(c.select("call_id", F.col("app").alias("caller")), "call_id")
    return A.route_inventory(r, hits, r.filter("route_id % 3 = 0")).select("route_id", "app", "method", "path", "guarded", "callers")
