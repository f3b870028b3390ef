"""Scalar and expression functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import scalars as S
from ..sources import views as V
from .registry import query

PATH = "case when regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) = '' then '/' else regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) end"


@query("fn_01_normalise_path", f"select page_id, case when length(p) > 1 then regexp_replace(p, '/$', '') else p end as path from (select page_id, regexp_replace(regexp_replace('/' || page_id % 7 || '//{{x}}' || {PATH}, '/(:[A-Za-z_]\\w*|\\{{[^/}}]+\\}}|<[^/>]+>)(/|$)', '/:param\\2', 'g'), '/{{2,}}', '/', 'g') as p from pages)".replace("{{", "{").replace("}}", "}"))
def fn_normalise(s, d):
    p = F.concat(F.lit("/"), (F.col("page_id") % 7).cast("string"), F.lit("//{x}"), S.url_path(F.col("url")))
    return V.read(s, d, "pages").select("page_id", S.normalise_path(p).alias("path"))


@query("fn_02_mask_path", f"select page_id, '/' || array_to_string(list_transform(list_filter(string_split({PATH}, '/'), lambda x: x <> ''), lambda x: case when regexp_matches(x, '[0-9]') or length(x) > 32 or regexp_matches(x, '.@.') then ':value' else x end), '/') as path from pages")
def fn_mask(s, d):
    return V.read(s, d, "pages").select("page_id", S.mask_path(S.url_path(F.col("url"))).alias("path"))


@query("fn_06_join_ids", "select 'order:' || o_orderkey as from_id, 'placed_by' as type, 'customer:' || o_custkey as to_id, 'order:' || o_orderkey || ' -placed_by-> customer:' || o_custkey as id from orders")
def fn_join_ids(s, d):
    a, b = F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string"))
    out = V.read(s, d, "orders").select(S.join_id(a, F.lit("placed_by"), b).alias("id"))
    return out.withColumn("x", S.join_of_id(F.col("id"))).select("x.*", "id")


@query("fn_08_durations", "select t, case u when 'ms' then n when 's' then n * 1000 when 'm' then n * 60000 when 'h' then n * 3600000 when 'd' then n * 86400000 end as ms from (select p_size || ['ms', 's', 'm', 'h', 'd', 'x'][p_partkey % 6 + 1] as t, cast(p_size as bigint) as n, ['ms', 's', 'm', 'h', 'd', 'x'][p_partkey % 6 + 1] as u from part)")
def fn_durations(s, d):
    unit = F.element_at(F.array(*[F.lit(x) for x in ("ms", "s", "m", "h", "d", "x")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return V.read(s, d, "part").select(F.concat(F.col("p_size").cast("string"), unit).alias("t")).withColumn("ms", S.duration_ms(F.col("t")))


@query("fn_10_fingerprints", "select p_partkey as k, sha256('{\"p_name\":\"' || p_name || '\",\"p_brand\":\"' || p_brand || '\",\"p_size\":' || p_size || '}') as print from part")
def fn_fingerprints(s, d):
    return V.read(s, d, "part").select(F.col("p_partkey").alias("k"), S.fingerprint(F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("print"))


@query("fn_14_sql_text", "select k, 'SELECT' as verb, ['customer_' || k, 'orders'] as tables from (select c_custkey as k from customer)")
def fn_sql(s, d):
    text = F.concat(F.lit("select a from Orders o join customer_"), F.col("c_custkey").cast("string"), F.lit(" c on a = b where exists (select 1 from orders)"))
    return V.read(s, d, "customer").select(F.col("c_custkey").alias("k"), S.sql_verb(text).alias("verb"), S.sql_tables(text).alias("tables"))


@query("fn_15_channel_filters", "select p_brand, bool_or(p_brand = 'Brand#11') as eq, bool_or(starts_with(p_brand, 'Brand#1')) as pre, bool_or(suffix(p_brand, '3')) as suf, bool_or(lower(p_brand) = 'brand#12') as ci, bool_or(regexp_full_match(p_brand, 'Brand#.*2')) as wild, bool_or(p_brand not in ('Brand#11', 'Brand#12')) as other from part group by 1")
def fn_filters(s, d):
    b = F.col("p_brand")
    return V.read(s, d, "part").select("p_brand").distinct().select("p_brand", (b == "Brand#11").alias("eq"), b.startswith("Brand#1").alias("pre"), b.endswith("3").alias("suf"), (F.lower(b) == "brand#12").alias("ci"), b.rlike("^Brand#.*2$").alias("wild"), (~b.isin("Brand#11", "Brand#12")).alias("other"))


@query("fn_16_words", "select p_partkey as k, list_sort(list_distinct(string_split(lower(p_name || ' ' || replace(p_brand, '#', ' ') || ' ' || p_type), ' '))) as words from part where length(p_name) > 0")
def fn_words(s, d):
    name = F.concat_ws("_", "p_name", "p_brand", F.lower("p_type"))
    w = V.read(s, d, "part").filter(F.length("p_name") > 0).select(F.col("p_partkey").alias("k"), F.sort_array(S.words(name)).alias("words"))
    return w


@query("fn_20_time_units", "select event_id, epoch_us(ts) as us, epoch_us(ts) // 1000 as ms, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso from events")
def fn_time(s, d):
    at = F.col("ts").cast("timestamp")
    return V.read(s, d, "events").select("event_id", F.unix_micros(at).alias("us"), F.unix_millis(at).alias("ms"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("fn_22_stable_keys", "select c_custkey as k, left(sha256(c_name), 10) as key, count(*) over (partition by left(sha256(c_name), 10)) = 1 as own from customer")
def fn_keys(s, d):
    from pyspark.sql import Window

    key = F.left(F.sha2("c_name", 256), F.lit(10))
    return V.read(s, d, "customer").select(F.col("c_custkey").alias("k"), key.alias("key")).withColumn("own", F.count("*").over(Window.partitionBy("key")) == 1)


@query("fn_24_catalogue_names", "select p_partkey as k, left(regexp_replace(regexp_replace(lower(p_name || '  ' || p_brand || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 63) as name from part")
def fn_names(s, d):
    return V.read(s, d, "part").select(F.col("p_partkey").alias("k"), S.catalog_name(F.concat("p_name", F.lit("  "), "p_brand", F.lit("!"))).alias("name"))


@query("fn_19_resource_names", "select s_suppkey as k, s_name as name from supplier")
def fn_resources(s, d):
    arn = F.concat(F.lit("arn:x:lambda:eu:1:function/"), F.col("s_name"))
    return V.read(s, d, "supplier").select(F.col("s_suppkey").alias("k"), S.resource_name(arn).alias("name"))


@query(
    "tf_strings",
    """select p_partkey as k, p_name || '-' || lpad(cast(p_size as varchar), 4, '0') as format, array_to_string(string_split(p_name, ' '), '+') as joined, replace(p_name, 'e', 'E') as replaced,
      regexp_replace(p_name, '[aeiou]+', '_', 'g') as re_replaced, lower(p_type) as low, upper(p_name) as up, case when starts_with(p_brand, 'Brand') then substr(p_brand, 6) else p_brand end as no_prefix,
      case when suffix(p_type, 'L') then left(p_type, length(p_type) - 1) else p_type end as no_suffix, trim('  ' || p_name || ' ') as trimmed, substr(p_name, 2, 3) as part, substr(p_name, 3) as rest,
      starts_with(p_name, 's') as starts, suffix(p_name, 'g') as ends, contains(p_name, 'in') as has, length(p_name) as length, to_base64(encode(p_name)) as b64, replace(p_name, ' ', '+') as url from part""",
)
def tf_strings(s, d):
    n = F.col("p_name")
    return V.read(s, d, "part").select(
        F.col("p_partkey").alias("k"), F.format_string("%s-%04d", n, F.col("p_size")).alias("format"), F.array_join(F.split(n, " "), "+").alias("joined"), X.replace(n, "e", "E").alias("replaced"),
        X.replace(n, "/[aeiou]+/", "_").alias("re_replaced"), F.lower("p_type").alias("low"), F.upper(n).alias("up"), X.trimprefix(F.col("p_brand"), F.lit("Brand")).alias("no_prefix"),
        X.trimsuffix(F.col("p_type"), F.lit("L")).alias("no_suffix"), F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("trimmed"), X.substr(n, 1, 3).alias("part"), X.substr(n, 2, -1).alias("rest"),
        n.startswith("s").alias("starts"), n.endswith("g").alias("ends"), n.contains("in").alias("has"), F.length(n).alias("length"), F.base64(n.cast("binary")).alias("b64"), F.url_encode(n).alias("url"),
    )


@query(
    "tf_more_strings",
    """select p_partkey as k, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') as title, p_name as chomp, trim(p_name, 'x') as trim, p_name as round_trip,
      coalesce(nullif('', ''), p_name) as first_full, try_cast(p_brand as double) as bad_number, cast(p_size as double) as number, p_size = 1 as flag, p_name || '.txt' as base, '/a/' || p_partkey as dir from part""",
)
def tf_more(s, d):
    n = F.col("p_name")
    path = F.concat(F.lit("/a/"), F.col("p_partkey").cast("string"), F.lit("/"), n, F.lit(".txt"))
    return V.read(s, d, "part").select(
        F.col("p_partkey").alias("k"), X.title(n).alias("title"), X.chomp(F.concat(n, F.lit("\r\n\n"))).alias("chomp"), F.btrim(F.concat(F.lit("xx"), n, F.lit("x")), F.lit("x")).alias("trim"), F.unbase64(F.base64(n.cast("binary"))).cast("string").alias("round_trip"),
        X.coalesce(F.lit(""), n).alias("first_full"), F.col("p_brand").try_cast("double").alias("bad_number"), F.col("p_size").cast("string").try_cast("double").alias("number"), F.when(F.col("p_size") == 1, "true").otherwise("false").try_cast("boolean").alias("flag"), X.basename(path).alias("base"), X.dirname(path).alias("dir"),
    )


@query(
    "tf_collections",
    """with a as (select n_regionkey as k, list_sort(list(n_nationkey)) as a from nation group by 1)
    select k, len(a) as length, a[k % len(a) + 1] as element, list_contains(a, 7) as has, list_sort(list_distinct(list_concat(a, a))) as both, list_reverse(a) as reversed, a[2:3] as sliced, list_transform(range(0, k), lambda x: cast(x as int)) as numbers,
      case when len(a) = 1 then a[1] end as only_one, ['a', 'b'] as keys, [k, k + 1] as vals, coalesce(null, k + 1) as found, -1 as missing, flatten([a, a]) as flat, ['x'] as compacted, a as first_list from a""",
)
def tf_collections(s, d):
    a, k = F.col("a"), F.col("k")
    base = V.read(s, d, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.sort_array(F.collect_list("n_nationkey")).alias("a"))
    m = X.merge(F.create_map(F.lit("b"), k), X.zipmap(F.array(F.lit("a"), F.lit("b")), F.array(k, k + 1)))
    empty = F.array().cast("array<int>")
    return base.select(
        "k", F.size(a).alias("length"), X.element(a, k).alias("element"), F.array_contains(a, 7).alias("has"), X.toset(F.concat(a, a)).alias("both"), F.reverse(a).alias("reversed"), X.slice_(a, 1, 3).alias("sliced"), X.range_(F.lit(0), k).alias("numbers"),
        X.one(a).alias("only_one"), X.keys(m).alias("keys"), X.values(m).alias("vals"), X.lookup(m, F.lit("b"), F.lit(-1)).alias("found"), X.lookup(m, F.lit("z"), F.lit(-1)).alias("missing"), F.flatten(F.array(a, a)).alias("flat"), X.compact(F.array(F.lit("x"), F.lit(""), F.lit(None))).alias("compacted"), X.coalescelist(empty, a).alias("first_list"),
    )


@query("tf_json", "select event_id, cast(json_extract_string(props, '$.k') as int) as k, '{\"a\":' || event_id || ',\"b\":\"' || event_type || '\"}' as encoded, len(json_keys(props)) as keys from events")
def tf_json(s, d):
    m = F.from_json("props", "map<string,int>")
    return V.read(s, d, "events").select("event_id", F.try_element_at(m, F.lit("k")).alias("k"), F.to_json(F.struct(F.col("event_id").alias("a"), F.col("event_type").alias("b"))).alias("encoded"), F.size(F.map_keys(m)).alias("keys"))


@query("fn_03_span_templates", f"select page_id, '/' || array_to_string(list_transform(list_filter(string_split({PATH}, '/'), lambda x: x <> ''), lambda x: case when regexp_matches(x, '[0-9]') or length(x) > 32 or regexp_matches(x, '.@.') then ':param' else x end), '/') as template from pages")
def fn_templates(s, d):
    return V.read(s, d, "pages").select("page_id", S.span_template(S.url_path(F.col("url"))).alias("template"))


@query("fn_04_was_read", "select p_partkey as k, p_partkey % 4 <> 0 as read from part")
def fn_read(s, d):
    text = F.concat("p_name", F.when(F.col("p_partkey") % 4 == 0, "/${id}").otherwise("/id"))
    return V.read(s, d, "part").select(F.col("p_partkey").alias("k"), S.was_read(text).alias("read"))


@query("fn_05_entry_ids", "select o_orderkey as k, 'entry:' || o_orderpriority || ':' || o_orderstatus as id, o_orderpriority as verb, o_orderstatus as path from orders")
def fn_entry_ids(s, d):
    o = V.read(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.concat_ws(":", F.lit("entry"), "o_orderpriority", "o_orderstatus").alias("id"))
    p = F.split("id", ":")
    return o.select("k", "id", p[1].alias("verb"), p[2].alias("path"))


@query("fn_07_hours", "select date_trunc('hour', ts) as hour, count(*) as n from events group by 1")
def fn_hours(s, d):
    return V.read(s, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))


@query("fn_09_edit_distance", "select p_partkey as k, cast(levenshtein(p_name, p_type) as int) as distance from part")
def fn_distance(s, d):
    return V.read(s, d, "part").select(F.col("p_partkey").alias("k"), F.levenshtein("p_name", "p_type").alias("distance"))


@query("fn_12_referenced_types", "select p_partkey as k, list_sort(list_distinct(['type:' || p_type, 'type:b.B' || p_size])) as ids from part")
def fn_types(s, d):
    ref = F.concat(F.lit("Promise<type:"), "p_type", F.lit("[] | type:b.B"), F.col("p_size").cast("string"), F.lit(" | type:"), "p_type", F.lit(">"))
    return V.read(s, d, "part").select(F.col("p_partkey").alias("k"), S.referenced_types(ref).alias("ids"))


@query("fn_13_weakest_strongest", "select l_orderkey as k, case min(case l_returnflag when 'A' then 0 when 'N' then 1 else 3 end) when 0 then 'heuristic' when 1 then 'declared' else 'static' end as weakest, case max(case l_returnflag when 'A' then 0 when 'N' then 1 else 3 end) when 0 then 'heuristic' when 1 then 'declared' else 'static' end as strongest from lineitem group by 1")
def fn_strength(s, d):
    from ..schema import named, rank

    sure = F.when(F.col("l_returnflag") == "A", "heuristic").when(F.col("l_returnflag") == "N", "declared").otherwise("static")
    g = V.read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min(rank(sure)).alias("a"), F.max(rank(sure)).alias("b"))
    return g.select("k", named(F.col("a")).alias("weakest"), named(F.col("b")).alias("strongest"))


@query("fn_17_repository_keys", "select s_suppkey as k, 'supplier' || regexp_extract(s_name, '([0-9]+)$', 1) as key from supplier")
def fn_repositories(s, d):
    return V.read(s, d, "supplier").select(F.col("s_suppkey").alias("k"), S.repository_key(F.concat("s_name", F.lit("-Service"))).alias("key"))


@query("fn_18_name_heuristics", "select n_nationkey as k, n_nationkey % 2 = 0 as public from nation")
def fn_heuristics(s, d):
    name = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "isPublic").otherwise("guarded"), "n_name")
    return V.read(s, d, "nation").select(F.col("n_nationkey").alias("k"), S.sounds_public(name).alias("public"))


@query("fn_21_shape_navigation", "select event_id, json_extract_string(props, '$.k') as k from events")
def fn_shapes(s, d):
    return V.read(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("fn_25_label_collapse", "select p_brand, array_to_string(l[1:3], ', ') || case when len(l) > 3 then ' and ' || (len(l) - 3) || ' more' else '' end as labels from (select p_brand, list_sort(list(distinct p_name)) as l from part group by 1)")
def fn_labels(s, d):
    g = V.read(s, d, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_name")).alias("l"))
    return g.select("p_brand", S.collapse_labels(F.col("l"), 3).alias("labels"))


@query("fn_26_allow_list", "select event_id, event_type, '{\"k\":' || json_extract_string(props, '$.k') || '}' as props from events")
def fn_allow_list(s, d):
    """Only the keys allowed are kept of the free properties."""
    kept = F.map_filter(F.from_json("props", "map<string,int>"), lambda k, v: k.isin("k"))
    return V.read(s, d, "events").select("event_id", "event_type", F.to_json(kept).alias("props"))
