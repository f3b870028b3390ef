"""Rules, verdicts, specs, further lookups and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import bitmaps as B
from ..operators import diff as D
from ..operators import linking as L
from ..operators.orders import numbered_over_all
from ..operators import rules as R
from ..operators import traverse as T
from ..sources import views as V
from .graph_queries import CH, TR, WITH, N
from .link_queries import ROUTES_SQL, calls, routes, versions
from .link_queries import BASE, HEAD
from .registry import query
from .telemetry_queries import BAD, SP

TRADE = f"with recursive nodes as {N}, t as {TR} "
RULES = (
    R.Rule("asia-europe", "forbid", {"service": "ASIA"}, {"service": "EURO*"}),
    R.Rule("only-africa", "only", {"service": "AFRICA"}, {"id": "nation:1*"}),
    R.Rule("tagged", "tags", tag="even", may=("even",), severity="warning"),
    R.Rule("reach", "reachable", {"id": "nation:0"}, {"service": "AMERICA"}),
    R.Rule("must", "reachable", {"id": "nation:*"}, {"id": "nation:3"}, must=True),
    R.Rule("nobody", "forbid", {"service": "ATLANTIS"}, {"service": "*"}),
)
WALK = ", w as (select from_id as a, to_id as b, 1 as k from t union select w.a, t.to_id, k + 1 from w join t on t.from_id = w.b where k < 16), far as (select distinct a, b from w where a <> b) "


def tagged(s, d):
    n = V.nodes(s, d).filter("type = 'nation'")
    return n.withColumn("tag", F.when(F.substring_index("id", ":", -1).cast("int") % 2 == 0, "even").otherwise("odd"))


@query(
    "gra_21_rules",
    TRADE + WALK + """, h as (select t.from_id, t.to_id, a.service as sa, b.service as sb from t join nodes a on a.id = from_id join nodes b on b.id = to_id)
    select 'asia-europe' as rule, 'error' as severity, from_id, to_id from h where sa = 'ASIA' and starts_with(sb, 'EURO')
    union all select 'only-africa', 'error', from_id, to_id from h where starts_with(to_id, 'nation:1') and sa <> 'AFRICA'
    union all select 'tagged', 'warning', from_id, to_id from h where cast(split_part(from_id, ':', 2) as int) % 2 = 0 and cast(split_part(to_id, ':', 2) as int) % 2 = 1
    union all select 'reach', 'error', a, b from far join nodes on id = b where a = 'nation:0' and service = 'AMERICA'
    union all select 'must', 'error', id, null from nodes where type = 'nation' and id not in (select a from far where b = 'nation:3')
    union all select 'nobody', 'unchecked', null, null""",
)
def rules(s, d):
    return R.evaluate(tagged(s, d), V.trade_edges(s, d), RULES)


def one_rule(name: str, i: int, where: str):
    @query(name, TRADE + WALK + f", h as (select t.from_id, t.to_id, a.service as sa, b.service as sb from t join nodes a on a.id = from_id join nodes b on b.id = to_id) {where}")
    def run(s, d):
        return R.evaluate(tagged(s, d), V.trade_edges(s, d), [RULES[i]]).select("from_id", "to_id")


one_rule("gra_17_forbid", 0, "select from_id, to_id from h where sa = 'ASIA' and starts_with(sb, 'EURO')")
one_rule("gra_18_only", 1, "select from_id, to_id from h where starts_with(to_id, 'nation:1') and sa <> 'AFRICA'")
one_rule("gra_19_tags", 2, "select from_id, to_id from h where cast(split_part(from_id, ':', 2) as int) % 2 = 0 and cast(split_part(to_id, ':', 2) as int) % 2 = 1")
one_rule("gra_20_reachable", 3, "select a as from_id, b as to_id from far join nodes on id = b where a = 'nation:0' and service = 'AMERICA'")


@query("set_06_rule_delta", TRADE + ", b as (select from_id, to_id from t where confidence = 'static'), h as (select from_id, to_id from t where cast(split_part(from_id, ':', 2) as int) % 3 <> 0) select from_id, to_id, case when b.x is null then 'new' when h.y is null then 'fixed' else 'existing' end as state from (select *, 1 as x from b) b full join (select *, 1 as y from h) h using (from_id, to_id)")
def rule_delta(s, d):
    t = V.trade_edges(s, d)
    return D.delta(t.filter("confidence = 'static'"), t.filter(F.substring_index("from_id", ":", -1).cast("int") % 3 != 0), ["from_id", "to_id"])


@query("gra_02_representative_cycle", TRADE + ", w as (select from_id as a, to_id as b, [from_id, to_id] as p from t union all select w.a, t.to_id, list_append(p, t.to_id) from w join t on t.from_id = w.b where w.a <> w.b and not list_contains(p[2:], t.to_id) and len(p) < 8), c as (select a as id, array_to_string(p, '>') as path, len(p) - 1 as length from w where a = b) select id, length, path from (select *, row_number() over (partition by id order by length, path) as k from c) where k = 1")
def representative(s, d):
    """For each nation the shortest way back to itself, the first by name among equals."""
    return T.shortest_cycles(V.trade_edges(s, d))


@query("gra_10_verdicts", WITH + f", c as {CH} select type, case when type = 'supplier' and id in (select from_id from c where type = 'emits') then 'alive' when type = 'customer' and id in (select to_id from c where type = 'consumes') then 'alive' when type = 'region' then 'unknown' else 'dead' end as verdict, count(*) as n from nodes where type in ('supplier', 'customer', 'region') group by 1, 2")
def verdicts(s, d):
    c = V.channels(s, d)
    used = c.filter("type = 'emits'").select(F.col("from_id").alias("id")).unionByName(c.filter("type = 'consumes'").select(F.col("to_id").alias("id"))).distinct().withColumn("u", F.lit(1))
    n = V.nodes(s, d).filter("type in ('supplier', 'customer', 'region')").join(used, "id", "left")
    return n.groupBy("type", F.when(F.col("type") == "region", "unknown").when(F.col("u").isNotNull(), "alive").otherwise("dead").alias("verdict")).agg(F.count("*").alias("n"))


@query("gra_15_route_audit", f"with r as ({ROUTES_SQL}), g as (select route_id, path, method, app, route_id % 3 = 0 as guarded, path like '/en%' as public from r) select route_id, case when exists (select 1 from g o where o.app = g.app and o.path <> g.path and o.path like '/%/*' and starts_with(g.path, replace(o.path, '*', ''))) then 'shadowed' when public then 'public' else 'unguarded' end as state from g where not guarded")
def route_audit(s, d):
    r = routes(s, d)
    g = r.withColumn("first", F.concat(F.lit("/"), F.element_at(S.segments(F.col("path")), 1), F.lit("/")))
    wide = r.filter("path like '/%/*'").select("app", F.replace("path", F.lit("*"), F.lit("")).alias("first"), F.lit(1).alias("w"), F.col("path").alias("by"))
    out = g.filter("route_id % 3 <> 0").join(wide, ["app", "first"], "left")
    state = F.when(F.col("w").isNotNull() & (F.col("by") != F.col("path")), "shadowed").when(F.col("path").startswith("/en"), "public").otherwise("unguarded")
    return out.select("route_id", state.alias("state")).distinct()


@query("gra_16_missing_sources", "with s as (select regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as key, 'page' as kind from pages union all select regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), 'secure' from pages where starts_with(url, 'https') union all select regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), 'query' from pages where contains(url, '?')) select key, count(distinct kind) as score, count(*) as n from s where key not in (select regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) from pages where page_id % 11 = 0) group by 1")
def missing_sources(s, d):
    p = V.read(s, d, "pages").withColumn("key", F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1))
    kinds = F.filter(F.array(F.lit("page"), F.when(F.col("url").startswith("https"), "secure"), F.when(F.col("url").contains("?"), "query")), lambda x: x.isNotNull())
    known = p.filter("page_id % 11 = 0").select("key")
    return p.join(known, "key", "left_anti").select("key", F.explode(kinds).alias("kind")).groupBy("key").agg(F.count_distinct("kind").alias("score"), F.count("*").alias("n"))


@query("gra_22_busiest", WITH + f", t as {TR}, r as (select to_id as seed, to_id as id, 0 as k from t union select r.seed, t.from_id, k + 1 from r join t on t.to_id = r.id where k < 3), m as (select seed, count(distinct id) as doors from r group by 1) select to_id as id, count(*) as in_degree, max(doors) as doors from t join m on seed = to_id group by 1")
def busiest(s, d):
    t = V.trade_edges(s, d)
    ids = t.select(F.col("from_id").alias("id")).union(t.select("to_id"))
    doors = B.ways_in(t, ids, 3).select("id", F.col("ways").alias("doors"))
    return t.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("in_degree")).join(doors, "id")


@query("gra_24_causes", "with c as (select source, unnest(list_distinct(regexp_extract_all(lower(text), 'license|token|copyright'))) as cause from documents) select cause, source, count(*) as n from c group by 1, 2")
def causes(s, d):
    c = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("(license|token|copyright)"), 1))
    return V.read(s, d, "documents").select("source", F.explode(c).alias("cause")).groupBy("cause", "source").agg(F.count("*").alias("n"))


@query("gra_25_blind_spots", SP + ", g as (select service, entry, k, count(*) as n from spans where status = 404 group by 1, 2, 3), r as (select *, row_number() over (partition by service, entry order by n desc, k) as o from g) select service, entry, list(k order by o) as names from r where o <= 3 group by 1, 2")
def blind_spots(s, d):
    g = V.spans(s, d).filter("status = 404").groupBy("service", "entry", "k").agg(F.count("*").alias("n"))
    r = g.withColumn("o", F.row_number().over(Window.partitionBy("service", "entry").orderBy(F.desc("n"), "k"))).filter("o <= 3")
    return r.groupBy("service", "entry").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "k"))), lambda x: x["k"]).alias("names"))


@query("join_05_optional_segments", "with r as (select p_partkey as k, '/' || p_type || '/' || p_size || case when p_partkey % 2 = 0 then '?' else '' end as path from part) select k, replace(path, '?', '') as path from r union all select k, regexp_replace(path, '/[^/]*\\?$', '') from r where suffix(path, '?')")
def optional_segments(s, d):
    path = F.concat(F.lit("/"), "p_type", F.lit("/"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "?").otherwise(""))
    both = F.when(path.endswith("?"), F.array(F.replace(path, F.lit("?"), F.lit("")), F.regexp_replace(path, r"/[^/]*\?$", ""))).otherwise(F.array(path))
    return V.read(s, d, "part").select(F.col("p_partkey").alias("k"), F.explode(both).alias("path"))


@query("join_07_could_reach", f"with r as ({ROUTES_SQL}), c as (select page_id as call_id, '/' || split_part(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/', 2) as head from pages) select call_id, count(*) as routes from c join r on starts_with(r.path, c.head || '/') where length(head) > 1 group by 1")
def could_reach(s, d):
    """Calls of which only the first segment was read: routes that begin with it, joined by that segment."""
    first = lambda p: F.element_at(S.segments(p), 1)
    c = calls(s, d).filter(F.size(S.segments(F.col("path"))) > 0).select("call_id", first(F.col("path")).alias("head"))
    r = routes(s, d).filter(F.size(S.segments(F.col("path"))) > 1).select(first(F.col("path")).alias("head"))
    n = r.groupBy("head").agg(F.count("*").alias("routes"))
    return c.join(n, "head").select("call_id", "routes")


@query(
    "join_09_outgoing_calls",
    """with c as (select o_orderkey as call_id, o_custkey % 9 as env, o_custkey % 11 as bind, o_orderkey % 4 as kind, o_orderpriority as name from orders),
      b as (select s_nationkey % 11 as bind, count(*) as n, min(s_suppkey) as svc from supplier where s_suppkey < 8 group by 1), e as (select n_nationkey % 9 as env, count(*) as n, min(n_name) as svc from nation where n_nationkey < 12 group by 1)
    select call_id, case when kind = 0 then 'linked' when kind = 1 then case when b.n = 1 then 'linked' else 'unknownBinding' end when kind = 2 then case when e.n = 1 then 'linked' else 'unknownEnv' end when name = '5-LOW' then 'external' else 'dynamic' end as outcome,
      case when kind = 0 then 'marker' when kind = 1 and b.n = 1 then 'binding' when kind = 2 and e.n = 1 then 'env' end as way from c left join b using (bind) left join e using (env)""",
)
def outgoing_calls(s, d):
    """First rule that fits: marker, binding with one service, variable with one service, host known, else dynamic."""
    o = V.read(s, d, "orders").select(F.col("o_orderkey").alias("call_id"), (F.col("o_custkey") % 9).alias("env"), (F.col("o_custkey") % 11).alias("bind"), (F.col("o_orderkey") % 4).alias("kind"), F.col("o_orderpriority").alias("name"))
    b = V.read(s, d, "supplier").filter("s_suppkey < 8").groupBy((F.col("s_nationkey") % 11).cast("long").alias("bind")).agg(F.count("*").alias("bn"))
    e = V.read(s, d, "nation").filter("n_nationkey < 12").groupBy((F.col("n_nationkey") % 9).cast("long").alias("env")).agg(F.count("*").alias("en"))
    x = o.join(F.broadcast(b), "bind", "left").join(F.broadcast(e), "env", "left")
    k, one_b, one_e = F.col("kind"), F.coalesce(F.col("bn") == 1, F.lit(False)), F.coalesce(F.col("en") == 1, F.lit(False))
    outcome = F.when(k == 0, "linked").when(k == 1, F.when(one_b, "linked").otherwise("unknownBinding")).when(k == 2, F.when(one_e, "linked").otherwise("unknownEnv")).when(F.col("name") == "5-LOW", "external").otherwise("dynamic")
    return x.select("call_id", outcome.alias("outcome"), F.when(k == 0, "marker").when((k == 1) & one_b, "binding").when((k == 2) & one_e, "env").alias("way"))


@query("join_11_procedure_calls", "with e as (select p_name as key, p_brand as service, min(p_partkey) as entry from part group by 1, 2), g as (select key, count(*) as n, min(entry) as entry from e group by 1), c as (select l_orderkey as o, l_linenumber as l, p_name as key, 'Brand#' || (l_suppkey % 25) as service from lineitem join part on p_partkey = l_partkey) select o, l, coalesce(e.entry, case when g.n = 1 then g.entry end) as entry from c left join e using (key, service) left join g using (key)")
def procedure_calls(s, d):
    """The call of every line: a procedure of its own service, else the one that a single service has."""
    p = V.read(s, d, "part").select("p_partkey", F.col("p_name").alias("key"), F.col("p_brand").alias("service"))
    e = p.groupBy("key", "service").agg(F.min("p_partkey").alias("own"))
    g = e.groupBy("key").agg(F.count("*").alias("n"), F.min("own").alias("any"))
    service = F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 25).cast("string"))
    c = V.read(s, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("p_partkey"), service.alias("service")).join(p.select("p_partkey", "key"), "p_partkey")
    return c.join(e, ["key", "service"], "left").join(g, "key", "left").select("o", "l", F.coalesce("own", F.when(F.col("n") == 1, F.col("any"))).alias("entry"))


@query("join_20_choice_by_words", "with a as (select distinct p_name as name, string_split(p_name, ' ') as w from part), b as (select a.name, b.name as other, len(list_intersect(a.w, b.w)) as n from a join a b on a.name <> b.name) select name, case when count(*) = 1 then min(other) end as chosen, count(*) as equals from b where n = (select max(n) from b c where c.name = b.name) and n > 0 group by 1")
def choice_by_words(s, d):
    a = V.read(s, d, "part").select(F.col("p_name").alias("name")).distinct().withColumn("word", F.explode(S.words(F.col("name"))))
    both = a.join(a.select(F.col("name").alias("other"), "word"), "word").filter("name <> other").groupBy("name", "other").agg(F.count("*").alias("n"))
    best = both.withColumn("k", F.rank().over(Window.partitionBy("name").orderBy(F.desc("n")))).filter("k = 1")
    return best.groupBy("name").agg(F.when(F.count("*") == 1, F.min("other")).alias("chosen"), F.count("*").alias("equals"))


@query("join_30_boundaries", f"with recursive nodes as {N}, c as {CH} select a.service as sender, b.service as receiver, x.to_id as channel, count(*) as n from c x join c y on x.to_id = y.from_id join nodes a on a.id = x.from_id join nodes b on b.id = y.to_id where x.type = 'emits' and y.type = 'consumes' group by 1, 2, 3")
def boundaries(s, d):
    """Each side of a channel is counted by service before they meet; channels are between suppliers and customers."""
    n, c = V.nodes(s, d), V.channels(s, d)
    a, b = n.filter("type = 'supplier'").select(F.col("id").alias("from_id"), F.col("service").alias("sender")), n.filter("type = 'customer'").select(F.col("id").alias("to_id"), F.col("service").alias("receiver"))
    emits = c.filter("type = 'emits'").join(a, "from_id").groupBy(F.col("to_id").alias("channel"), "sender").agg(F.count("*").alias("x"))
    takes = c.filter("type = 'consumes'").join(b, "to_id").groupBy(F.col("from_id").alias("channel"), "receiver").agg(F.count("*").alias("y"))
    return emits.join(takes, "channel").select("sender", "receiver", "channel", (F.col("x") * F.col("y")).alias("n"))


@query("join_31_crossings", TRADE + "select from_id, to_id, case when confidence = 'heuristic' then 0 else 1 end as place from t join nodes a on a.id = from_id join nodes b on b.id = to_id where (a.service = 'ASIA' and b.service = 'EUROPE') or (a.service = 'EUROPE' and b.service = 'ASIA')")
def crossings(s, d):
    n = V.nodes(s, d)
    a, b = n.select(F.col("id").alias("from_id"), F.col("service").alias("x")), n.select(F.col("id").alias("to_id"), F.col("service").alias("y"))
    own = V.trade_edges(s, d).join(a, "from_id").join(b, "to_id").filter("(x = 'ASIA' and y = 'EUROPE') or (x = 'EUROPE' and y = 'ASIA')")
    return own.select("from_id", "to_id", F.when(F.col("confidence") == "heuristic", 0).otherwise(1).alias("place")).orderBy("place", "from_id", "to_id")


@query("join_24_gap_sites", f"with b as (select p, count(*) as n from ({BASE}) group by 1), h as (select p, count(*) as n from ({HEAD}) group by 1) select p, greatest(coalesce(h.n, 0) - coalesce(b.n, 0), 0) as more, greatest(coalesce(b.n, 0) - coalesce(h.n, 0), 0) as fewer from b full join h using (p)")
def gap_sites(s, d):
    b, h = versions(s, d)
    a, c = b.groupBy("p").agg(F.count("*").alias("x")), h.groupBy("p").agg(F.count("*").alias("y"))
    j = a.join(c, "p", "full").fillna(0, ["x", "y"])
    return j.select("p", F.greatest(F.col("y") - F.col("x"), F.lit(0)).alias("more"), F.greatest(F.col("x") - F.col("y"), F.lit(0)).alias("fewer"))


@query("trv_10_reach_joins", TRADE + ", r as (select 'nation:2' as id, 0 as k union select t.to_id, k + 1 from r join t on t.from_id = r.id where k < 3) select distinct t.from_id, t.to_id from t join r on r.id = t.from_id where k < 3")
def reach_joins(s, d):
    t = V.trade_edges(s, d)
    got = T.reach(t, s.createDataFrame([("nation:2",)], "id string"), "out", None, 3).filter("depth < 3").select(F.col("id").alias("from_id"))
    return t.join(got, "from_id", "left_semi").select("from_id", "to_id")


@query("trv_14_data_reached", WITH + ", r as (select id, id as seed, 0 as k from nodes where type = 'part' union select e.to_id, r.seed, k + 1 from r join edges e on e.from_id = r.id where k < 2 and e.type in ('supplied_by', 'based_in')) select seed, count(distinct id) as reached from r where starts_with(id, 'nation') group by 1")
def data_reached(s, d):
    seeds = V.nodes(s, d).filter("type = 'part'").select("id", F.col("id").alias("seed"))
    got = T.reach(V.edges(s, d), seeds, "out", ["supplied_by", "based_in"], 2, by="seed")
    return got.filter(F.col("id").startswith("nation")).groupBy("seed").agg(F.count("*").alias("reached"))


@query("trv_16_methods_reached", WITH + ", r as (select id, 0 as k from nodes where type = 'customer' and kind = 'BUILDING' union select e.to_id, k + 1 from r join edges e on e.from_id = r.id where k < 3) select type, count(distinct id) as n from r join nodes using (id) group by 1")
def methods_reached(s, d):
    seeds = V.nodes(s, d).filter("type = 'customer' and kind = 'BUILDING'").select("id")
    return T.reach(V.edges(s, d), seeds, "out", None, 3).join(V.nodes(s, d), "id").groupBy("type").agg(F.count("*").alias("n"))


@query("trv_17_config_along_flow", WITH + ", r as (select 'order:5' as id, 0 as k union select e.to_id, k + 1 from r join edges e on e.from_id = r.id where k < 12 and e.type in ('contains', 'supplied_by', 'based_in')) select service, count(distinct id) as keys from r join nodes using (id) where type = 'nation' group by 1")
def config_along_flow(s, d):
    got = T.reach(V.edges(s, d), s.createDataFrame([("order:5",)], "id string"), "out", ["contains", "supplied_by", "based_in"], 12)
    return got.join(V.nodes(s, d).filter("type = 'nation'"), "id").groupBy("service").agg(F.count("*").alias("keys"))


@query("win_03_top_besides_self", "select p_partkey as k, (select max(p_retailprice) from part q where q.p_brand = p.p_brand and q.p_partkey <> p.p_partkey) as most from part p")
def besides_self(s, d):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = V.read(s, d, "part").select(F.col("p_partkey").alias("k"), F.row_number().over(w).alias("p"), F.nth_value("p_retailprice", 1).over(full).alias("a"), F.nth_value("p_retailprice", 2).over(full).alias("b"))
    return x.select("k", F.when(F.col("p") == 1, F.col("b")).otherwise(F.col("a")).alias("most"))


@query("win_05_positional_rank", "with p as (select s_suppkey as k, row_number() over (order by s_suppkey) as place, case when s_suppkey % 3 = 0 then s_acctbal end as score from supplier), a as (select k, place, row_number() over (order by place) as o from p where score is not null), b as (select k, row_number() over (order by score desc, k) as o from p where score is not null) select b.k, a.place from a join b using (o) union all select k, place from p where score is null")
def positional_rank(s, d):
    """Rows with a score are sorted among the places that such rows have; the others keep theirs."""
    k = F.col("k")
    p = numbered_over_all(V.read(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_acctbal")).alias("score")), [k])
    has = p.filter("score is not null")
    a = numbered_over_all(has.select("place"), [F.col("place")], "o")
    b = numbered_over_all(has.select("k", "score"), [F.desc("score"), k], "o").select("k", "o")
    return b.join(a, "o").select("k", "place").unionByName(p.filter("score is null").select("k", "place"))


@query("set_04_observed_diff", SP + ", a as (select distinct service, entry, k from spans where \"at\" < timestamp '2024-01-16'), b as (select distinct service, entry, k from spans where \"at\" >= timestamp '2024-01-16') select state, count(*) as n from (select case when a.x is null then 'appeared' when b.y is null then 'gone' else 'compared' end as state from (select *, 1 as x from a) a full join (select *, 1 as y from b) b using (service, entry, k)) group by 1")
def observed_diff(s, d):
    x, cut = V.spans(s, d), F.lit("2024-01-16").cast("timestamp_ntz")
    keys = ["service", "entry", "k"]
    names = F.when(F.col("state") == "new", "appeared").when(F.col("state") == "fixed", "gone").otherwise("compared")
    return D.delta(x.filter(F.col("at") < cut), x.filter(F.col("at") >= cut), keys).groupBy(names.alias("state")).agg(F.count("*").alias("n"))


SPEC = "select p_type || ' ' || p_name as op, p_brand as prop, min(p_size) as type from part where {} group by 1, 2"


@query("spc_01_spec_diff", f"with b as ({SPEC.format('p_partkey % 5 <> 0')}), h as ({SPEC.format('p_partkey % 7 <> 0')}), bo as (select distinct op from b), ho as (select distinct op from h) select 'operation' as what, coalesce(bo.op, ho.op) as op, null as prop, case when bo.op is null then 'added' else 'removed' end as change, case when bo.op is null then 'info' else 'error' end as level from bo full join ho on bo.op = ho.op where bo.op is null or ho.op is null union all select 'property', op, prop, case when b.type is null then 'added' when h.type is null then 'removed' else 'changed' end, case when b.type is null then 'info' when h.type is null then 'warning' else 'error' end from b full join h using (op, prop) where b.type is distinct from h.type and op in (select op from bo) and op in (select op from ho)")
def spec_diff(s, d):
    def spec(where):
        return V.read(s, d, "part").filter(where).groupBy(F.concat_ws(" ", "p_type", "p_name").alias("op"), F.col("p_brand").alias("prop")).agg(F.min("p_size").alias("type"))

    b, h = spec("p_partkey % 5 <> 0"), spec("p_partkey % 7 <> 0")
    ops = D.delta(b, h, ["op"])
    gone = ops.filter("state <> 'existing'").select(F.lit("operation").alias("what"), "op", F.lit(None).cast("string").alias("prop"), F.when(F.col("state") == "new", "added").otherwise("removed").alias("change"), F.when(F.col("state") == "new", "info").otherwise("error").alias("level"))
    props = D.diff_rows(b, h, ["op", "prop"], ["type"]).join(ops.filter("state = 'existing'").select("op"), "op", "left_semi")
    level = F.when(F.col("change") == "added", "info").when(F.col("change") == "removed", "warning").otherwise("error")
    return gone.unionByName(props.select(F.lit("property").alias("what"), "op", "prop", "change", level.alias("level")))


@query("agg_15_type_usage", "select p_type as type, count(*) filter (l_returnflag = 'R') as taking, count(*) filter (l_returnflag = 'A') as returning, count(*) filter (l_returnflag = 'N') as nested from lineitem join part on p_partkey = l_partkey group by 1")
def type_usage(s, d):
    x = V.read(s, d, "lineitem").join(V.read(s, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    c = lambda f: F.count_if(F.col("l_returnflag") == f)
    return x.groupBy(F.col("p_type").alias("type")).agg(c("R").alias("taking"), c("A").alias("returning"), c("N").alias("nested"))


@query("agg_21_ways_in", WITH + "select service, count(*) filter (id in (select to_id from edges where type = 'placed_by')) as read, count(*) as found from nodes where type = 'customer' group by 1")
def ways_in(s, d):
    used = V.edges(s, d).filter("type = 'placed_by'").select(F.col("to_id").alias("id")).distinct().withColumn("u", F.lit(1))
    return V.nodes(s, d).filter("type = 'customer'").join(used, "id", "left").groupBy("service").agg(F.count("u").alias("read"), F.count("*").alias("found"))


@query("agg_23_confirmed_guesses", f"with c as {CH}, o as (select distinct 'supplier:' || l_suppkey as from_id, 'channel:' || p_brand || '.' || l_partkey || '.' || l_linenumber as to_id from lineitem join part on p_partkey = l_partkey where l_quantity > 25) select count(*) as guesses, count(o.to_id) as confirmed from c left join o using (from_id, to_id) where type = 'emits' and confidence = 'heuristic'")
def confirmed(s, d):
    seen = V.read(s, d, "lineitem").filter("l_quantity > 25").join(V.read(s, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    seen = seen.select(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("from_id"), F.concat(F.lit("channel:"), "p_brand", F.lit("."), F.col("l_partkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")).alias("to_id")).distinct().withColumn("o", F.lit(1))
    g = V.channels(s, d).filter("type = 'emits' and confidence = 'heuristic'").join(seen, ["from_id", "to_id"], "left")
    return g.agg(F.count("*").alias("guesses"), F.count("o").alias("confirmed"))


@query("flt_17_accepted_split", "select k, p_type like 'S%' or p_brand = 'Brand#3' as accepted from (select p_partkey as k, p_type, p_brand from part)")
def accepted(s, d):
    """Rows that any entry of a list of patterns accepts are set aside; the list is small and part of the program."""
    entries = (("p_type", "S*"), ("p_brand", "Brand#3"))
    test = F.lit(False)
    for c, p in entries:
        test = test | R.glob(F.col(c), p)
    return V.read(s, d, "part").select(F.col("p_partkey").alias("k"), test.alias("accepted"))


@query("flt_18_predicate", SP + f"select service, count(*) as missed from spans where {BAD} and entry <> 'view' group by 1")
def missed(s, d):
    from ..operators.telemetry import failed

    return V.spans(s, d).filter(failed() & (F.col("entry") != "view")).groupBy("service").agg(F.count("*").alias("missed"))


@query("flt_19_kind_decode", "with k(entry, own) as (values ('error', 'gap'), ('click', 'note')) select event_id, coalesce(case when event_id % 5 = 0 then 'stored' end, own, 'finding') as kind from events left join k on entry = event_type")
def kind_decode(s, d):
    dim = s.createDataFrame([("error", "gap"), ("click", "note")], "event_type string, own string")
    e = V.read(s, d, "events").join(F.broadcast(dim), "event_type", "left")
    return e.select("event_id", F.coalesce(F.when(F.col("event_id") % 5 == 0, "stored"), "own", F.lit("finding")).alias("kind"))


@query("flt_24_combined_search", WITH + ", h as (select id, label, 'node' as what, 0 as place from nodes where label ilike '%ring%' union all select 'doc:' || doc_id, source, 'doc', 1 from documents where text ilike '%ring%') select id, label, what from h order by place, length(label), id limit 40")
def combined_search(s, d, text: str = "ring"):
    n = V.nodes(s, d).filter(F.col("label").ilike(f"%{text}%")).select("id", "label", F.lit("node").alias("what"), F.lit(0).alias("place"))
    x = V.read(s, d, "documents").filter(F.col("text").ilike(f"%{text}%"))
    x = x.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("label"), F.lit("doc").alias("what"), F.lit(1).alias("place"))
    return n.unionByName(x).orderBy("place", F.length("label"), "id").limit(40).select("id", "label", "what")


@query("dif_02_impacted", f"with b as ({BASE}), h as ({HEAD}) select coalesce(b.id, h.id) as id, case when h.id is null then 'base' else 'head' end as side from b full join h on b.id = h.id where h.id is null or (b.id is not null and b.p is distinct from h.p)")
def impacted(s, d):
    c = D.diff_rows(*versions(s, d), ["id"], ["p"], ["at"]).filter("change in ('changed', 'removed')")
    return c.select("id", F.when(F.col("change") == "removed", "base").otherwise("head").alias("side"))


@query("dif_08_check_reasons", f"with b as ({BASE}), h as ({HEAD}) select case when b.id is null then 'added' when h.id is null then 'removed' else 'changed' end as reason, count(*) as n from b full join h on b.id = h.id where b.id is null or h.id is null or b.p is distinct from h.p group by 1")
def check_reasons(s, d):
    return D.diff_rows(*versions(s, d), ["id"], ["p"]).groupBy(F.col("change").alias("reason")).agg(F.count("*").alias("n"))


@query("con_07_traffic_vs_declared", "with seen as (select event_type as entry, count(*) as n, count(*) filter (cast(json_extract_string(props, '$.k') as int) > 50) as k from events group by 1), d(entry, path, optional) as (values ('view', 'k', false), ('click', 'k', true), ('error', 'm', false)) select d.entry, d.path, case when d.path = 'k' and not optional and k < n then 'optionality_mismatch' when d.path = 'm' then 'declared_never_sent' else 'agrees' end as kind from d join seen using (entry) where n >= 50")
def traffic_vs_declared(s, d):
    declared = s.createDataFrame([("view", "k", False), ("click", "k", True), ("error", "m", False)], "entry string, path string, optional boolean")
    e = V.read(s, d, "events").select(F.col("event_type").alias("entry"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    total = e.groupBy("entry").agg(F.count("*").alias("n"))
    sent = e.filter("k > 50").groupBy("entry").agg(F.count("*").alias("c")).withColumn("path", F.lit("k"))
    x = declared.join(total, "entry").filter("n >= 50").join(sent, ["entry", "path"], "left")
    kind = F.when(F.col("c").isNull(), "declared_never_sent").when(~F.col("optional") & (F.col("c") < F.col("n")), "optionality_mismatch").otherwise("agrees")
    return x.select("entry", "path", kind.alias("kind"))


@query("snk_04_documents", "select p_brand as service, count(*) as operations from part group by 1")
def documents(s, d):
    """One JSON document for each service, written by to_json and read back."""
    op = F.struct(F.concat_ws("-", "p_type", "p_partkey").alias("operationId"), F.struct(F.lit("integer").alias("type")).alias("schema"))
    doc = V.read(s, d, "part").groupBy(F.col("p_brand").alias("service")).agg(F.to_json(F.struct(F.lit("3.0.3").alias("openapi"), F.sort_array(F.collect_list(F.struct(op["operationId"].alias("operationId")))).alias("paths"))).alias("json"))
    back = F.from_json("json", "openapi string, paths array<struct<operationId:string>>")
    return doc.select("service", F.size(back["paths"]).cast("long").alias("operations"))


@query("snk_06_report", "select event_id, 'error' as level, sha256(event_type || '|' || user_id || '|' || event_id) as fingerprint from events where event_type = 'error' order by event_id limit 5000")
def report(s, d):
    e = V.read(s, d, "events").filter("event_type = 'error'").orderBy("event_id").limit(5000)
    return e.select("event_id", F.lit("error").alias("level"), F.sha2(F.concat_ws("|", "event_type", "user_id", "event_id"), 256).alias("fingerprint"))


@query("snk_09_route_inventory", f"with r as ({ROUTES_SQL}) select app, method, count(*) as routes, count(*) filter (path like '%:param%') as with_params from r group by 1, 2")
def inventory(s, d):
    return routes(s, d).groupBy("app", "method").agg(F.count("*").alias("routes"), F.count_if(F.col("path").contains(":param")).alias("with_params"))


@query("snk_07_catalogue", TRADE + "select lower(replace(service, ' ', '-')) as name, coalesce(len(list(distinct lower(replace(to_service, ' ', '-'))) filter (to_service is not null)), 0) as depends from (select distinct service from nodes where service is not null) left join (select a.service as service, b.service as to_service from t join nodes a on a.id = from_id join nodes b on b.id = to_id where a.service <> b.service) using (service) group by 1")
def catalogue(s, d):
    from ..sources.graphs import catalogue as written
    from .graph_queries import service_joins

    c = written(V.nodes(s, d), service_joins(s, d))
    spec = F.from_json("document", "spec struct<dependsOn:array<string>>")["spec"]["dependsOn"]
    return c.select("name", F.size(spec).cast("long").alias("depends"))
