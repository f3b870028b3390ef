"""Types, contracts and specs: hashes, drift, wire rules, envelopes, checks, impact of dropped fields, documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts as K
from ..operators import diff as D
from ..sources import declared as DC
from ..sources import views as V
from .registry import query

FLAT = f"with flat as ({DC.FLAT_SQL}), "
HASHES = FLAT + "hashes as (select id, name, repo, left(sha256(string_agg(distinct line, ';' order by line)), 16) as structural_hash from (select id, name, repo, path || case when optional then '?' else '' end || ':' || case when type = 'string | undefined' then 'string|undefined' when starts_with(type, 'type:') then '{}' else type end as line from flat) group by 1, 2, 3)"


def hashes(s, d):
    t = DC.types(s, d)
    return K.structural_hashes(t).join(t.select("id", "name", "repo"), "id")


@query("fn_11_structural_hash", HASHES + " select id, structural_hash from hashes")
def structural_hash(s, d):
    return hashes(s, d).select("id", "structural_hash")


@query("agg_13_drift_by_structure", HASHES + " select name, count(distinct repo) as repos, count(distinct structural_hash) as forms from hashes group by 1 having count(distinct repo) > 1 and count(distinct structural_hash) > 1")
def drift(s, d):
    return K.drift(hashes(s, d))


WRITTEN = ("Date", "bigint | null", "Buffer", "string | undefined", "Set<string>", "Map<string, number>", "ObjectId", "Class<User>", "any", "null | number", "number")
ARRIVED = ("string", "null | string", "string", "string", "Array<string>", "object", "string", "User", "*", "null | number", "number")


@query(
    "con_03_wire_rules",
    f"""with w as (select p_partkey as id, cast(p_size % {len(WRITTEN)} as int) + 1 as k, p_partkey % 2 = 0 as o from part)
    select id, case when k = 2 and o then 'string' when k = 10 and o then 'number' else {list(ARRIVED)}[k] end as type, o or k = 4 as optional,
      list_filter([case when k = 4 then 'undefined-vanishes' end, case when k in (2, 10) and o then 'optional-accepts-null' end, case when k = 1 then 'date-string' end, case when k = 2 then 'bigint-string' end, case when k = 3 then 'buffer-string' end,
        case when k = 7 then 'objectid-string' end, case when k in (5, 6) then 'set-map-json' end, case when k = 8 then 'class-transformer' end, case when k = 9 then 'any-unknown-skip' end], lambda x: x is not null) as rules from w""",
)
def wire_rules(s, d):
    p = V.read(s, d, "part")
    t = F.element_at(F.array(*[F.lit(x) for x in WRITTEN]), (F.col("p_size") % len(WRITTEN) + 1).cast("int"))
    fields = p.select(F.col("p_partkey").alias("id"), t.alias("type"), (F.col("p_partkey") % 2 == 0).alias("optional"))
    return K.wire_types(fields).select("id", "type", "optional", "rules")


@query(
    "con_06_envelopes",
    FLAT + "f as (select id, 'data' as path, 'type:x' as type, false as optional from flat group by 1 union all select id, 'data.' || path, type, optional from flat where length(id) % 2 = 0 union all select id, 'ok', 'boolean', false from flat group by 1 union all select id, 'other.' || path, type, optional from flat where length(id) % 3 = 0 union all select id, 'other', 'type:y', false from flat where length(id) % 3 = 0 group by 1), "
    "e as (select id, 'data' as envelope from flat where length(id) % 2 = 0 and length(id) % 3 <> 0 group by 1) select f.id, envelope, case when envelope is null then path else substr(path, 6) end as path, type, optional from f left join e on f.id = e.id where envelope is null or starts_with(path, 'data.')",
)
def envelopes(s, d):
    flat = D.flatten_types(DC.types(s, d))
    ids, n = flat.select("id").distinct(), F.length("id")
    part = lambda path, kind: ids.select("id", F.lit(path).alias("path"), F.lit(kind).alias("type"), F.lit(False).alias("optional"))
    under = lambda p, cond: flat.filter(cond).withColumn("path", F.concat(F.lit(f"{p}."), "path"))
    f = part("data", "type:x").unionByName(under("data", n % 2 == 0)).unionByName(part("ok", "boolean")).unionByName(under("other", n % 3 == 0)).unionByName(part("other", "type:y").filter(n % 3 == 0))
    return K.unwrapped(f)


PAIRS_SQL = "select p_partkey as pair, 'type:' || p_brand || '.' || p_type as sent, case when p_size % 6 = 0 then 'type:' || p_brand || '.' || p_type when p_size % 6 = 1 then 'type:none' else 'type:Brand#' || (p_partkey % 25) || '.' || p_type end as wanted from part"


def pairs(s, d):
    """Each part sends its type; it is wanted as the same, as a lost one, or as another brand's type of that name."""
    own = F.concat(F.lit("type:"), "p_brand", F.lit("."), "p_type")
    other = F.concat(F.lit("type:Brand#"), (F.col("p_partkey") % 25).cast("string"), F.lit("."), "p_type")
    k = F.col("p_size") % 6
    return V.read(s, d, "part").select(F.col("p_partkey").alias("pair"), own.alias("sent"), F.when(k == 0, own).when(k == 1, "type:none").otherwise(other).alias("wanted"))


STATUS = HASHES + f", p as ({PAIRS_SQL}), st as (select pair, sent, wanted, case when a.structural_hash is null or b.structural_hash is null then 'unchecked' when sent = wanted then 'shared' when a.structural_hash = b.structural_hash then 'identical' else 'hash_differs' end as status from p left join hashes a on a.id = sent left join hashes b on b.id = wanted)"


@query("con_09_pair_status", STATUS + " select pair, sent, wanted, status from st")
def status(s, d):
    return K.pair_status(pairs(s, d), K.structural_hashes(DC.types(s, d)))


FOUND = STATUS + """, wired as (select id, path, case type when 'string | undefined' then 'string' when 'Date' then 'string' else case when starts_with(type, 'type:') then '{}' else type end end as type, optional or type = 'string | undefined' as optional from flat),
  a as (select pair, path, type, optional from st join wired on id = sent where status = 'hash_differs'), b as (select pair, path, type, optional from st join wired on id = wanted where status = 'hash_differs'),
  fk as (select pair, path, case when a.type is null and not b.optional then 'missing_required' when b.type is null then 'extra_field' when a.type <> b.type then 'type_mismatch' when a.optional and not b.optional then 'optionality_mismatch' end as kind from a full join b using (pair, path)),
  found as (select pair, path, kind, case kind when 'optionality_mismatch' then 'warning' when 'extra_field' then 'info' else 'error' end as severity from fk where kind is not null)"""


@query("con_04_contract_check", FOUND + ", fr as (select pair, path, kind, case when pair % 3 = 0 then severity when severity = 'error' then 'warning' else 'info' end as severity from found where path <> 's1' and not starts_with(path, 's1.')) select pair, status, path, kind, severity from st left join fr using (pair)")
def contract_check(s, d):
    reached = V.read(s, d, "part").select(F.col("p_partkey").alias("pair")).filter("pair % 3 = 0")
    return K.check(pairs(s, d), DC.types(s, d), ["s1"], reached)


@query("con_10_finding_keys", FOUND + " select pair, path, sent || '|' || wanted || '|' || path || '|' || kind as key from found join st using (pair)")
def finding_keys(s, d):
    p = pairs(s, d)
    found = K.check(p, DC.types(s, d)).filter("kind is not null").join(p, "pair")
    return found.select("pair", "path", K.finding_key(F.col("sent"), F.col("wanted"), F.col("path"), F.col("kind")).alias("key"))


IMPACT_SQL = FOUND + ", x as (select distinct sent as type, path from found join st using (pair) where kind = 'extra_field'), rd as (select sent as type, 's' || (pair % 4) as path from st where sent not like '%SMALL'), wr as (select sent as type, 's' || (pair % 7) as path from st where sent not like '%SMALL' and pair % 5 = 0), i as (select type, path, case when (type, path) in (select (type, path) from wr) then 'stored' when type not in (select type from rd union select type from wr) then 'unknown' when (type, path) in (select (type, path) from rd) then 'none' else 'unread' end as impact from x)"


def extra(s, d):
    p = pairs(s, d)
    return K.check(p, DC.types(s, d)).filter("kind = 'extra_field'").join(p, "pair").select(F.col("sent").alias("type"), "path", "kind", "pair")


def impact(s, d):
    p = pairs(s, d).filter("sent not like '%SMALL'")
    field = lambda m: F.concat(F.lit("s"), (F.col("pair") % m).cast("string")).alias("path")
    reads, writes = p.select(F.col("sent").alias("type"), field(4)), p.filter("pair % 5 = 0").select(F.col("sent").alias("type"), field(7))
    return K.strip_impact(extra(s, d).select("type", "path").distinct(), reads, writes)


@query("con_05_strip_impact", IMPACT_SQL + " select type, path, impact from i")
def strip_impact(s, d):
    return impact(s, d)


@query("con_02_moved_severity", IMPACT_SQL + " select type, path, case impact when 'stored' then 'warning' else 'info' end as severity from i")
def moved_severity(s, d):
    return K.severities(impact(s, d).withColumn("kind", F.lit("extra_field"))).select("type", "path", "severity")


@query("gra_11_dead_fields", IMPACT_SQL + " select i.type, i.path, count(*) as pairs, bool_or(impact = 'unread') as dropped from found join st using (pair) join i on i.type = sent and i.path = found.path where kind = 'extra_field' group by 1, 2")
def dead_fields(s, d):
    x = extra(s, d).join(impact(s, d), ["type", "path"])
    return K.dead_fields(x.withColumn("dropped", F.col("impact") == "unread"))


@query("con_08_shape_types", "with e as (select event_type as entry, case when user_id % 3 = 0 then 'string' else 'number' end as t from events), f as (select entry, list_sort(list(distinct t)) as types from e group by 1) select 'type:observed#' || entry as id, 2 as fields, 'k: ' || array_to_string(types, ' | ') as first from f union all select 'type:observed#' || entry || '.o', 1, 'a: ' || 'string' from f")
def shape_types(s, d):
    e = V.read(s, d, "events").select(F.col("event_type").alias("entry"), F.when(F.col("user_id") % 3 == 0, "string").otherwise("number").alias("t"))
    k = e.groupBy("entry").agg(F.sort_array(F.collect_set("t")).alias("types")).select("entry", F.lit("k").alias("path"), "types", F.lit(False).alias("optional"))
    o = k.select("entry", F.lit("o").alias("path"), F.array(F.lit("object")).alias("types"), F.lit(True).alias("optional"))
    a = k.select("entry", F.lit("o.a").alias("path"), F.array(F.lit("string")).alias("types"), F.lit(True).alias("optional"))
    t = K.shape_types(k.unionByName(o).unionByName(a))
    return t.select("id", F.size("fields").alias("fields"), F.concat(F.col("fields")[0]["name"], F.lit(": "), F.col("fields")[0]["type"]).alias("first"))


@query(
    "dif_03_type_field_changes",
    FLAT + "h as (select id, case when path = 's2' then 's9' else path end as path, case when path = 's4' then 'string' else type end as type, case when path = 's5' then not optional else optional end as optional from flat where id not like '%PROMO') select id, path, case when a.type is null then 'added' when b.type is null then 'removed' when a.type <> b.type then 'type' else 'optionality' end as change from (select * from flat where id not like '%PROMO') a full join h b using (id, path) where a.type is null or b.type is null or a.type <> b.type or a.optional <> b.optional",
)
def type_field_changes(s, d):
    flat = D.flatten_types(DC.types(s, d))
    head = flat.filter("id not like '%PROMO'")
    p = F.col("path")
    head = head.select("id", F.when(p == "s2", "s9").otherwise(p).alias("path"), F.when(p == "s4", "string").otherwise(F.col("type")).alias("type"), F.when(p == "s5", ~F.col("optional")).otherwise(F.col("optional")).alias("optional"))
    return K.declaration_changes(flat, head)


DOCS = FLAT + "b as (select name || ' ' || repo as op, path, type, not optional as required from flat where length(repo) < 9 and repo not like '%3'), h as (select name || ' ' || repo as op, path, case when path = 's4' and repo like '%1%' then 'string' else type end as type, case when path = 's5' then optional else not optional end as required from flat where repo not like '%4' and not (path = 's6' and repo like '%2')), "
DOCS += "ao as (select distinct op from b), ho as (select distinct op from h), ch as (select coalesce(ao.op, ho.op) as op, null as path, case when ao.op is null then 'operation added' else 'operation removed' end as change from ao full join ho on ao.op = ho.op where ao.op is null or ho.op is null union all select op, path, case when b.type is null then 'property added' when h.type is null then 'property removed' when b.type <> h.type then 'property type' when not b.required and h.required then 'now required' else 'now optional' end from b full join h using (op, path) where op in (select op from ao) and op in (select op from ho) and (b.type is null or h.type is null or b.type <> h.type or b.required <> h.required)), "
DOCS += "lv as (select *, case change when 'operation added' then 'info' when 'operation removed' then 'error' when 'property added' then 'info' when 'property removed' then 'warning' when 'property type' then 'error' when 'now required' then 'error' else 'info' end as level from ch) "


def documents(s, d):
    t = DC.types(s, d)
    flat = D.flatten_types(t).join(t.select("id", "name", "repo"), "id").withColumn("op", F.concat_ws(" ", "name", "repo")).withColumn("required", ~F.col("optional"))
    p, r = F.col("path"), F.col("repo")
    base = flat.filter("length(repo) < 9 and repo not like '%3'").select("op", "path", "type", "required")
    head = flat.filter("repo not like '%4' and not (path = 's6' and repo like '%2')")
    head = head.select("op", "path", F.when((p == "s4") & r.like("%1%"), "string").otherwise(F.col("type")).alias("type"), F.when(p == "s5", ~F.col("required")).otherwise(F.col("required")).alias("required"))
    return base, head


@query("spc_02_schema_compare", DOCS + "select op, path, change, level from lv")
def schema_compare(s, d):
    return K.schema_changes(*documents(s, d))


@query("spc_03_code_against_document", DOCS + "select op, path, change, level, case when change like '%added' then 'undocumented' when change like '%removed' then 'stale' else 'differs' end as side from lv")
def code_against_document(s, d):
    document, code = documents(s, d)
    return K.against_document(code, document)


@query("spc_04_spec_failures", DOCS + "select level, change, count(*) as n from lv where level in ('warning', 'error') group by 1, 2")
def spec_failures(s, d):
    return K.failures(K.schema_changes(*documents(s, d)), "warning").groupBy("level", "change").agg(F.count("*").alias("n"))


@query(
    "spc_05_json_schema",
    FLAT + """t as (select id, path, type, optional, case when type = 'Date' then '{"type":"string","format":"date-time"}' when starts_with(type, 'type:') then '{"$ref":"#/components/schemas/' || substr(type, 6) || '"}' else '{"type":"' || split_part(type, ' ', 1) || '"}' end as s from flat where not contains(path, '.'))
    select id, '{"type":"object","properties":{' || string_agg('"' || path || '":' || s, ',' order by path) || '}' || coalesce(',"required":[' || string_agg('"' || path || '"', ',' order by path) filter (not optional and not contains(type, 'undefined')) || ']', '') || '}' as schema from t group by 1""",
)
def json_schema(s, d):
    return K.json_schemas(DC.types(s, d))
