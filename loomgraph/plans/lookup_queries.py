"""Scans, lookups and filters of types and of rows that could not be followed; orders, first rows and bounded tops."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import orders as O
from ..operators import rules as R
from ..operators import unresolved as U
from ..sources import declared as DC
from ..sources import views as V
from .graph_queries import N
from .link_queries import CALLS_SQL, calls
from .registry import query

UN = f"with u as ({DC.UNRESOLVED_SQL}), r as ({DC.REASONS_SQL}), dec as (select u.* replace (coalesce(u.kind, r.reason_kind) as kind), risk from u left join r using (reason)) "


def unresolved(s, d):
    return U.decoded(DC.unresolved(s, d), DC.reasons(s))


@query("src_04_type_scan", f"select id, name, repo from ({DC.TYPES_SQL}) order by name, id limit 100000")
def type_scan(s, d):
    return DC.types(s, d).orderBy("name", "id").limit(100_000).select("id", "name", "repo")


@query("src_05_unresolved_scan", UN + "select id, reason, level, kind, risk, sites from dec")
def unresolved_scan(s, d):
    return unresolved(s, d).select("id", "reason", "level", "kind", "risk", "sites")


@query("flt_05_types_by_name", f"select id, repo, cast(len(k) + 1 as int) as fields from ({DC.TYPES_SQL}) where name = 'ECONOMY'")
def types_by_name(s, d):
    return DC.types(s, d).filter("name = 'ECONOMY'").select("id", "repo", F.size("fields").alias("fields"))


@query("flt_07_unresolved_lookup", UN + "select id, file, line, sites from dec where reason = '1-URGENT' and service = 'svc2' order by id limit 200")
def unresolved_lookup(s, d):
    return unresolved(s, d).filter("reason = '1-URGENT' and service = 'svc2'").orderBy("id").limit(200).select("id", "file", "line", "sites")


REFS_SQL = "select distinct ref from (select 'part:' || p_partkey as ref from part where p_size % 5 = 0 union all select p_name from part union all select upper(p_name) from part where p_size = 7 union all select split_part(p_name, ' ', 2) from part where p_size = 8 union all select 'none ' || p_partkey from part where p_size = 9)"


@query(
    "flt_12_symbol_resolution",
    f"""with refs as ({REFS_SQL}), t as (select 'part:' || p_partkey as id, p_name as label from part),
      k as (select stage, key, count(distinct id) as n, min(id) as id from (select id, 1 as stage, id as key from t union all select id, 2, label from t union all select id, 3, lower(label) from t union all select id, 4, lower(split_part(split_part(label, '.', -1), ' ', -1)) from t) group by 1, 2),
      h as (select ref, k.stage, k.n, k.id, row_number() over (partition by ref order by k.stage) as i from refs join k on k.key = case when stage < 3 then ref else lower(ref) end)
    select ref, case when h.n is null then 'missing' when h.n > 1 then 'ambiguous' else 'found' end as outcome, h.stage, case when h.n = 1 then h.id end as id, coalesce(h.n, 0) as n from refs left join (select * from h where i = 1) h using (ref)""",
)
def symbol_resolution(s, d):
    p = V.read(s, d, "part")
    id_ = F.concat(F.lit("part:"), F.col("p_partkey").cast("string"))
    parts = [p.filter("p_size % 5 = 0").select(id_.alias("ref")), p.select("p_name"), p.filter("p_size = 7").select(F.upper("p_name")), p.filter("p_size = 8").select(F.get(F.split("p_name", " "), F.lit(1))), p.filter("p_size = 9").select(F.concat(F.lit("none "), F.col("p_partkey").cast("string")))]
    refs = parts[0]
    for x in parts[1:]:
        refs = refs.union(x)
    return U.resolve(refs, p.select(id_.alias("id"), F.col("p_name").alias("label")))


ASKED_SQL = "select p_brand || '.' || p_partkey || '.1' as ref from part union select 'channel:' || p_brand || '.' || p_partkey || '.2' from part union select 'Brand.' || p_size from part"


@query("flt_13_channel_resolution", f"with c as (select distinct to_id from ({V.CHANNELS_SQL}) where type = 'emits'), a as ({ASKED_SQL}) select ref, case when starts_with(ref, 'channel:') then ref else 'channel:' || ref end as channel, c.to_id is not null as known from a left join c on c.to_id = case when starts_with(ref, 'channel:') then ref else 'channel:' || ref end")
def channel_resolution(s, d):
    p = V.read(s, d, "part")
    name = F.concat("p_brand", F.lit("."), F.col("p_partkey").cast("string"))
    asked = p.select(F.concat(name, F.lit(".1")).alias("ref")).union(p.select(F.concat(F.lit("channel:"), name, F.lit(".2")))).union(p.select(F.concat(F.lit("Brand."), F.col("p_size").cast("string")))).distinct()
    own = V.channels(s, d).filter("type = 'emits'").select(F.col("to_id").alias("channel"), F.lit(True).alias("known")).distinct()
    return asked.withColumn("channel", U.channel_id(F.col("ref"))).join(own, "channel", "left").select("ref", "channel", F.coalesce("known", F.lit(False)).alias("known"))


@query("flt_14_selectors", f"select id from ({N}) where service like 'A%A' and type = 'supplier' and label like 'Supplier#%1' union all select id from ({N}) where type = 'nation' and label like '%2%'")
def selectors(s, d):
    n = V.nodes(s, d)
    return R.selected(n, {"service": "A*A", "type": "supplier", "label": "Supplier#*1"}).union(R.selected(n, {"type": "nation", "label": "*2*"}))


PATTERNS = ("GET /en/*", "/de/**", "POST /*/*", "/fr/4**", "put /en/**")


@query("flt_16_route_patterns", f"with c as ({CALLS_SQL}), p(pattern, verb, re) as (values ('GET /en/*', 'GET', '/en/[^/]*/?'), ('/de/**', null, '/de(/[^/]+)*/?'), ('POST /*/*', 'POST', '/[^/]*/[^/]*/?'), ('/fr/4**', null, '/fr/4[^/]*/?'), ('put /en/**', 'PUT', '/en(/[^/]+)*/?')) select call_id, pattern from c join p on (verb is null or verb = upper(method)) and regexp_full_match(path, re)")
def route_patterns(s, d):
    hit = F.array(*[F.struct(F.lit(p).alias("pattern"), U.route_pattern(p, F.col("method"), F.col("path")).alias("on")) for p in PATTERNS])
    return calls(s, d).select("call_id", F.explode(F.filter(hit, lambda x: x["on"])).alias("x")).select("call_id", "x.pattern")


ACCEPT = [{"reason": "5-*", "service": "svc1"}, {"file": "f9*.ts", "level": "info"}, {"symbol": "customer:1*7"}]


@query("flt_17_accepted_rows", UN + "select service, count(*) filter (a) as aside, count(*) filter (not a) as stays from (select *, (reason like '5-%' and service = 'svc1') or (file like 'f9%.ts' and level = 'info') or symbol like 'customer:1%7' as a from dec) group by 1")
def accepted_rows(s, d):
    stays, aside = U.split_accepted(unresolved(s, d), ACCEPT)
    both = stays.select("service", F.lit(0).alias("a")).union(aside.select("service", F.lit(1)))
    return both.groupBy("service").agg(F.count_if(F.col("a") == 1).alias("aside"), F.count_if(F.col("a") == 0).alias("stays"))


@query("flt_18_missed_rows", UN + "select id, reason, service from dec where level <> 'nothing' and kind = 'gap'")
def missed_rows(s, d):
    return unresolved(s, d).filter(U.missed()).select("id", "reason", "service")


@query("flt_19_row_classes", UN + "select kind, risk, level, count(*) as n, sum(sites) as sites from dec group by 1, 2, 3")
def row_classes(s, d):
    return unresolved(s, d).groupBy("kind", "risk", "level").agg(F.count("*").alias("n"), F.sum("sites").alias("sites"))


@query("flt_20_demoted_by_marker", UN + f", m as ({DC.MARKERS_SQL}) select id, case when m.marker is not null and level = 'action' then 'info' else level end as level, m.marker as answered_by from dec left join r using (reason) left join m on m.service = dec.service and m.marker = r.marker")
def demoted_by_marker(s, d):
    return U.demoted(unresolved(s, d), DC.markers(s, d), DC.reasons(s)).select("id", "level", "answered_by")


KINDS = "['http', 'cron', 'rpc', 'invoke', 'event', 'workflow', 'bot_command'][cast(e_user % 7 as int) + 1]"


@query("flt_21_external_triggers", f"with e as (select distinct event_type, user_id as e_user from events), k as (select event_type || '/' || e_user as entry, {KINDS} as kind from e) select kind, count(*) as n from k where kind not in ('cron', 'invoke', 'workflow', 'bot_command') group by 1")
def external_triggers(s, d):
    e = V.read(s, d, "events").select("event_type", "user_id").distinct()
    kinds = F.array(*[F.lit(x) for x in ("http", "cron", "rpc", "invoke", "event", "workflow", "bot_command")])
    k = e.select(F.element_at(kinds, (F.col("user_id") % 7).cast("int") + 1).alias("kind"))
    return k.filter(~U.never_dead(F.col("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("win_01_first_per_key", "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as k from orders) where k = 1")
def first_per_key(s, d):
    o = V.read(s, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return O.first_per(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("win_02_row_numbers", UN + "select id, service, row_number() over (partition by service, reason order by sites desc, id) as place from dec")
def row_numbers(s, d):
    return O.numbered(unresolved(s, d), ["service", "reason"], [F.desc("sites"), F.col("id")]).select("id", "service", F.col("place").cast("long").alias("place"))


@query("win_04_first_n_per_service", UN + "select service, id, place from (select service, id, row_number() over (partition by service order by file, line, id) as place from dec) where place <= 3")
def first_n(s, d):
    return O.first_of_each(unresolved(s, d), ["service"], [F.col("file"), F.col("line"), F.col("id")], 3).select("service", "id", F.col("place").cast("long").alias("place"))


@query("top_05_bounded_top", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def bounded_top(s, d):
    return O.top(V.read(s, d, "orders"), [F.desc("o_totalprice"), F.col("o_orderkey")], 25).select("o_orderkey", "o_totalprice")


@query("top_06_cut_with_report", UN + "select service, reason, count(*) as found, count(*) - 40 as left_out from dec group by 1, 2 having count(*) > 40")
def cut_with_report(s, d):
    kept, report = O.cut_with_report(unresolved(s, d), ["service", "reason"], [F.col("id")], 40)
    # what was kept and what was left out make the whole
    n = kept.groupBy("service", "reason").agg(F.count("*").alias("kept"))
    return report.join(n, ["service", "reason"]).filter("kept + left_out = found").select("service", "reason", "found", "left_out")


@query("srt_01_binary_order", "with n as (select distinct p_name || case p_size % 3 when 0 then 'É' when 1 then 'z' else 'Z' end as name from part) select name, row_number() over (order by hex(encode(name))) as place from n")
def binary_order(s, d):
    n = V.read(s, d, "part").select(F.concat("p_name", F.when(F.col("p_size") % 3 == 0, "É").when(F.col("p_size") % 3 == 1, "z").otherwise("Z")).alias("name")).distinct()
    return O.numbered_over_all(n.withColumn("key", O.binary_key(F.col("name"))), [F.col("key")]).select("name", "place")


LOCALE = "(translate(lower(name), 'éü', 'eu'), lower(name), translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ'))"


@query("srt_02_locale_order", f"with n as (select distinct p_brand, case p_size % 4 when 0 then upper(p_type) when 1 then lower(p_type) when 2 then lower(p_type) || 'é' else lower(p_type) || 'e' end as name from part) select p_brand, name, row_number() over (partition by p_brand order by translate(lower(name), 'éü', 'eu'), lower(name), translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ')) as place from n")
def locale_order(s, d):
    t = F.col("p_type")
    k = F.col("p_size") % 4
    n = V.read(s, d, "part").select("p_brand", F.when(k == 0, F.upper(t)).when(k == 1, F.lower(t)).when(k == 2, F.concat(F.lower(t), F.lit("é"))).otherwise(F.concat(F.lower(t), F.lit("e"))).alias("name")).distinct()
    return O.numbered(n, ["p_brand"], [O.locale_key(F.col("name"))]).select("p_brand", "name", F.col("place").cast("long").alias("place"))


@query("srt_03_call_order", "select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by coalesce(case when l_quantity > 10 then l_partkey % 40 end, 2147483647), coalesce(case when l_tax > 0 then l_suppkey % 9 end, 2147483647), l_linenumber, l_partkey, l_suppkey) as place from lineitem")
def call_order(s, d):
    line, col = F.when(F.col("l_quantity") > 10, F.col("l_partkey") % 40), F.when(F.col("l_tax") > 0, F.col("l_suppkey") % 9)
    seq = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    return O.numbered(V.read(s, d, "lineitem"), ["l_orderkey"], [O.call_order(line, col, seq)]).select("l_orderkey", "l_linenumber", F.col("place").cast("long").alias("place"))


@query("srt_04_level_order", UN + "select service, level, min(id) as first, row_number() over (partition by service order by case level when 'action' then 0 when 'info' then 1 else 2 end) as place from dec group by 1, 2")
def level_order(s, d):
    g = unresolved(s, d).groupBy("service", "level").agg(F.min("id").alias("first"))
    return O.numbered(g, ["service"], [O.place(F.col("level"), O.LEVEL)]).select("service", "level", "first", F.col("place").cast("long").alias("place"))


@query("set_01_union_first_wins", "select id, p from (select o_orderkey as id, o_orderpriority as p from orders where o_orderkey % 3 <> 0 union all select o_orderkey, 'second' from orders where o_orderkey % 2 = 0 and o_orderkey % 3 = 0 union all select o_orderkey, 'third' from orders where o_orderkey % 6 = 3)")
def union_first_wins(s, d):
    o = V.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("p"))
    return O.union_first_wins([o.filter("id % 3 <> 0"), o.filter("id % 2 = 0").withColumn("p", F.lit("second")), o.withColumn("p", F.lit("third"))], ["id"]).select("id", "p")


@query("trv_18_owners", "with m as (select p_brand || '#f.ts:' || replace(p_name, ' ', '.') || '.m' || p_size as symbol from part) select regexp_extract(symbol, '^(.+)\\.[^.]*$', 1) as owner, count(distinct symbol) as methods, min(symbol) as first from m group by 1")
def owners(s, d):
    m = V.read(s, d, "part").select(F.concat("p_brand", F.lit("#f.ts:"), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit(".m"), F.col("p_size").cast("string")).alias("symbol"))
    return m.groupBy(S.owner_of(F.col("symbol")).alias("owner")).agg(F.count_distinct("symbol").alias("methods"), F.min("symbol").alias("first"))


@query("doc_01_doctor", UN + "select reason, any_value(hint) as hint, count(*) filter (m) as missed, sum(case when m then sites else 0 end) as sites, count(*) filter (kind = 'note') as notes, count(*) filter (kind = 'finding') as findings, count(distinct service) as services from (select dec.*, r.hint, level <> 'nothing' and kind = 'gap' as m from dec left join r using (reason)) group by 1")
def doctor(s, d):
    return U.doctor(unresolved(s, d), DC.reasons(s))


@query("doc_02_near_reasons", f"with a as (select distinct replace(o_orderpriority, '-', ' ') as asked from orders union select distinct lower(o_orderpriority) || 's' from orders), r as ({DC.REASONS_SQL}), n as (select asked, reason, levenshtein(lower(asked), lower(reason)) as k from a cross join r where asked not in (select reason from r)) select asked, list_slice(list(reason order by k, reason), 1, 3) as near from n where k <= greatest(2, floor(length(asked) / 3)) group by 1")
def near_reasons(s, d):
    o = V.read(s, d, "orders")
    asked = o.select(F.regexp_replace("o_orderpriority", "-", " ").alias("reason")).union(o.select(F.concat(F.lower("o_orderpriority"), F.lit("s")))).distinct()
    return U.nearest_reasons(asked, DC.reasons(s))


@query("doc_03_marker_faults", f"with m as ({DC.MARKERS_SQL} union select 'svc9', 'answers' union select 'svc1', 'shouts'), v as (select distinct 'svc' || (o_custkey % 5) as service from orders) select service, marker, 'no such service' as fault from m where service not in (select service from v) union all select service, marker, 'unknown marker' from m where marker not in ('answers', 'calls')")
def marker_faults(s, d):
    m = DC.markers(s, d).union(s.createDataFrame([("svc9", "answers"), ("svc1", "shouts")], "service string, marker string")).distinct()
    return U.marker_faults(m, DC.unresolved(s, d), ["answers", "calls"])


@query("set_07_baseline", UN + ", b as (select service, reason, count(*) as was from dec where id % 10 <> 3 group by 1, 2), n as (select service, reason, count(*) as now from dec where id % 10 <> 7 group by 1, 2) select service, reason, coalesce(was, 0) as was, coalesce(now, 0) as now, case when coalesce(now, 0) > coalesce(was, 0) then 'worse' when coalesce(now, 0) < coalesce(was, 0) then 'better' else 'same' end as state from b full join n using (service, reason)")
def baseline(s, d):
    """A snapshot of all rows but those that came since against all rows but those that have gone: every row is on a side."""
    u = unresolved(s, d)
    b = u.filter("id % 10 <> 3").groupBy("service", "reason").agg(F.count("*").alias("was"))
    n = u.filter("id % 10 <> 7").groupBy("service", "reason").agg(F.count("*").alias("now"))
    both = b.join(n, ["service", "reason"], "full").fillna(0, ["was", "now"])
    return both.withColumn("state", F.when(F.col("now") > F.col("was"), "worse").when(F.col("now") < F.col("was"), "better").otherwise("same"))
