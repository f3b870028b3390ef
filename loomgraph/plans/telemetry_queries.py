"""Telemetry over the event spans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import telemetry as M
from ..operators import orders as O
from ..sources import views as V
from ..store import sized
from .registry import query

SP = f"with spans as ({V.SPANS_SQL}) "
BUCKET = "cast(floor(ln(greatest(duration_ms, 0.01)) / (ln(2.0::double) / 8) + 0.5) as int)"
EDGE = "floor(pow(2.0::double, ({} + 0.5) / 8) * 100 + 0.5) / 100"
BAD = "(coalesce(error, false) or coalesce(status, 0) >= 500)"
HOUR = "date_trunc('hour', \"at\")"


def summary_sql(keys: str, where: str = "true") -> str:
    return f"""h as (select {keys}, {BUCKET} as bucket, count(*) as n from spans where {where} and duration_ms >= 0 group by all),
      c as (select *, sum(n) over (partition by {keys} order by bucket) as cum, sum(n) over (partition by {keys}) as total from h),
      q as (select {keys}, {EDGE.format("min(bucket) filter (cum >= greatest(1, ceil(total * 0.5)))")} as p50, {EDGE.format("min(bucket) filter (cum >= greatest(1, ceil(total * 0.95)))")} as p95 from c group by all),
      b as (select {keys}, count(*) as "count", count(*) filter ({BAD}) as errors, max(duration_ms) as m from spans where {where} group by all),
      summary as (select {keys}, "count", errors, floor(errors / "count" * 10000 + 0.5) / 10000 as error_rate, least(p50, floor(m * 100 + 0.5) / 100) as p50, least(p95, floor(m * 100 + 0.5) / 100) as p95, floor(m * 100 + 0.5) / 100 as max_ms from b left join q using ({keys}))"""


@query("agg_03_row_tallies", SP + f"select count(*) filter ({BAD}) as missed, cast(sum(case when status = 404 then k end) as bigint) as sites, count(*) filter (status = 404) as notes, count(*) filter (status = 200 and not error) as nothing from spans")
def tallies(s, d):
    x = V.spans(s, d)
    return x.agg(F.count_if(M.failed()).alias("missed"), F.sum(F.when(F.col("status") == 404, F.col("k"))).cast("long").alias("sites"), F.count_if(F.col("status") == 404).alias("notes"), F.count_if((F.col("status") == 200) & ~F.col("error")).alias("nothing"))


@query("agg_05_hour_partials", SP + f'select {HOUR} as hour, entry, count(*) as "count", count(*) filter ({BAD}) as errors, max(duration_ms) as max_ms, min("at") as first_seen, max("at") as last_seen from spans group by 1, 2')
def hour_partials(s, d):
    return M.partials(M.hours(V.spans(s, d)), ["hour", "entry"])


@query("agg_06_merge_law", SP + f'select entry, count(*) as "count", count(*) filter ({BAD}) as errors, max(duration_ms) as max_ms, min("at") as first_seen, max("at") as last_seen from spans group by 1')
def merge_law(s, d):
    x = V.spans(s, d)
    parts = M.partials(x.filter("span_id % 2 = 0"), ["entry"]).unionByName(M.partials(x.filter("span_id % 2 = 1"), ["entry"]))
    return M.merge(parts, ["entry"])


@query("agg_07_log_histogram", SP + f"select entry, {BUCKET} as bucket, count(*) as n from spans where duration_ms >= 0 group by 1, 2")
def log_histogram(s, d):
    return M.histogram(V.spans(s, d), ["entry"])


@query("agg_08_sketch_quantiles", SP + ", " + summary_sql("service") + " select service, p50, p95 from q")
def sketch_quantiles(s, d):
    return M.quantiles(M.histogram(V.spans(s, d), ["service"]), ["service"], (0.5, 0.95))


@query("agg_09_summary", SP + ", " + summary_sql("service, entry") + " select * from summary")
def summaries(s, d):
    return M.summary(V.spans(s, d), ["service", "entry"])


@query("agg_10_roll_up", SP + f'select date_trunc(\'day\', "at") as day, service, count(*) as "count", count(*) filter ({BAD}) as errors from spans group by 1, 2')
def roll_up(s, d):
    hourly = M.partials(M.hours(V.spans(s, d)), ["hour", "service"])
    daily = M.merge(hourly.withColumn("day", F.date_trunc("day", "hour").cast("timestamp_ntz")), ["day", "service"])
    return daily.select("day", "service", "count", "errors")


@query("agg_11_unmatched_groups", SP + "select service, entry, count(*) as n, list_slice(list_sort(list(distinct k)), 1, 5) as firsts, greatest(count(distinct k) - 5, 0) as more from spans where status = 404 group by 1, 2")
def unmatched(s, d):
    g = V.spans(s, d).filter("status = 404").groupBy("service", "entry", "k").agg(F.count("*").alias("n"))
    sums = g.groupBy("service", "entry").agg(F.sum("n").alias("n"), F.count("k").alias("c"))
    # five rows of a group at most meet in one
    first = O.first_of_each(g.filter("k is not null"), ["service", "entry"], [F.col("k")], 5).groupBy("service", "entry").agg(F.sort_array(F.collect_list("k")).alias("firsts"))
    out = sums.join(first, ["service", "entry"], "left")
    return out.select("service", "entry", "n", F.coalesce("firsts", F.array().cast("array<int>")).alias("firsts"), F.greatest(F.col("c") - 5, F.lit(0)).alias("more"))


@query("agg_16_failure_comparison", SP + ", r as (select entry, status, count(*) as n, sum(count(*)) over (partition by entry) as total from spans group by 1, 2), e(entry, status) as (values ('error', 500), ('view', 404), ('click', 410)) select coalesce(r.entry, e.entry) as entry, coalesce(r.status, e.status) as status, n, case when e.status is null then 'undeclared' when r.status is null then 'never seen' else 'declared' end as state, floor(n / total * 10000 + 0.5) / 10000 as share from (select * from r where status >= 400) r full join e on e.entry = r.entry and e.status = r.status")
def failure_comparison(s, d):
    declared = s.createDataFrame([("error", 500), ("view", 404), ("click", 410)], "entry string, status int").withColumn("d", F.lit(True))
    r = V.spans(s, d).groupBy("entry", "status").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("entry"))).filter("status >= 400")
    state = F.when(F.col("d").isNull(), "undeclared").when(F.col("n").isNull(), "never seen").otherwise("declared")
    return r.join(declared, ["entry", "status"], "full").select("entry", "status", "n", state.alias("state"), M.round_half_up(F.col("n") / F.col("total"), 4).alias("share"))


@query("agg_17_failure_groups", SP + f'select entry, status, count(*) as n, count(distinct service) as services, min("at") as first_seen from spans where {BAD} group by 1, 2')
def failure_groups(s, d):
    return V.spans(s, d).filter(M.failed()).groupBy("entry", "status").agg(F.count("*").alias("n"), F.count_distinct("service").alias("services"), F.min("at").alias("first_seen"))


@query("agg_18_shape_inference", "select event_type as entry, key as path, list_sort(list(distinct json_type(props, '$.' || key))) as types, count(*) as n from (select *, unnest(json_keys(props)) as key from events) group by 1, 2")
def shapes(s, d):
    m = V.read(s, d, "events").select(F.col("event_type").alias("entry"), F.explode(F.from_json("props", "map<string,string>")).alias("path", "v"))
    kind = F.when(F.col("v").rlike(r"^-?\d+$"), F.when(F.col("v").startswith("-"), "BIGINT").otherwise("UBIGINT")).when(F.col("v").isin("true", "false"), "BOOLEAN").otherwise("VARCHAR")
    return m.groupBy("entry", "path").agg(F.sort_array(F.collect_set(kind)).alias("types"), F.count("*").alias("n"))


@query("agg_19_status_pivot", SP + 'select entry, count(*) filter (status = 200) as "200", count(*) filter (status = 404) as "404", count(*) filter (status = 500) as "500" from spans group by 1')
def status_pivot(s, d):
    return V.spans(s, d).groupBy("entry").pivot("status", [200, 404, 500]).count().fillna(0)


@query("agg_22_sibling_statistics", SP + f", c as (select service, entry, count(*) filter ({BAD}) as hits from spans group by 1, 2) select a.service, a.entry, count(b.entry) as of_all, count(b.entry) filter (b.hits > 0) as seen, max(b.hits) as most from c a left join c b on a.service = b.service and a.entry <> b.entry group by 1, 2")
def siblings(s, d):
    c = V.spans(s, d).groupBy("service", "entry").agg(F.count_if(M.failed()).alias("hits"))
    w = Window.partitionBy("service")
    top = w.orderBy(F.desc("hits"), "entry").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, second = F.nth_value("hits", 1).over(top), F.nth_value("hits", 2).over(top)
    place = F.row_number().over(w.orderBy(F.desc("hits"), "entry"))
    out = c.select("service", "entry", (F.count("*").over(w) - 1).alias("of_all"), (F.count_if(F.col("hits") > 0).over(w) - (F.col("hits") > 0).cast("int")).alias("seen"), first.alias("a"), second.alias("b"), place.alias("p"))
    return out.select("service", "entry", "of_all", "seen", F.when(F.col("p") == 1, F.col("b")).otherwise(F.col("a")).alias("most"))


@query("join_25_span_parent", SP + "select c.entry, p.entry as parent_entry, count(*) as n from spans c left join spans p on p.trace_id = c.trace_id and p.span_id = c.parent_id group by 1, 2")
def span_parent(s, d):
    c = V.spans(s, d)
    p = c.select("trace_id", F.col("span_id").alias("parent_id"), F.col("entry").alias("parent_entry"))
    return c.join(p, ["trace_id", "parent_id"], "left").groupBy("entry", "parent_entry").agg(F.count("*").alias("n"))


@query(
    "join_26_adoption",
    SP + """, a as (select *, row_number() over (partition by trace_id, k % 3 order by "at", span_id) as r from spans where entry = 'view'), b as (select *, row_number() over (partition by trace_id, k % 3 order by "at", span_id) as r from spans where entry = 'click')
    select a.span_id, b.span_id as adopted_by from a join b on a.trace_id = b.trace_id and a.k % 3 = b.k % 3 and a.r = b.r""",
)
def adoption(s, d):
    w = Window.partitionBy("trace_id", F.col("k") % 3).orderBy("at", "span_id")
    x = V.spans(s, d).filter("entry in ('view', 'click')").withColumn("m", F.col("k") % 3)
    a = x.filter("entry = 'view'").withColumn("r", F.row_number().over(w)).select("trace_id", "m", "r", "span_id")
    b = x.filter("entry = 'click'").withColumn("r", F.row_number().over(w)).select("trace_id", "m", "r", F.col("span_id").alias("adopted_by"))
    return a.join(b, ["trace_id", "m", "r"]).select("span_id", "adopted_by")


@query("win_07_trace_minimum", SP + f", u as (select trace_id, span_id, case when span_id % 10 <> 0 then \"at\" end as a from spans), m as (select *, min(a) over (partition by trace_id) as f, max(a) over () as l from u) select date_trunc('hour', coalesce(a, f, l)) as hour, count(*) as n from m group by 1")
def trace_minimum(s, d):
    x = V.spans(s, d).withColumn("at", F.when(F.col("span_id") % 10 != 0, F.col("at")))
    return M.hours(x).groupBy("hour").agg(F.count("*").alias("n"))


@query("win_06_cumulative", SP + f", h as (select {BUCKET} as bucket, count(*) as n from spans group by 1) select bucket, n, cast(sum(n) over (order by bucket) as bigint) as upto from h")
def cumulative(s, d):
    h = M.histogram(V.spans(s, d).withColumn("a", F.lit(1)), ["a"])
    return h.withColumn("upto", F.sum("n").over(Window.partitionBy("a").orderBy("bucket"))).select("bucket", "n", "upto")


SAMPLES = SP + f""", one as (select 'slow' as why, entry, span_id, row_number() over (partition by entry, trace_id order by duration_ms desc, span_id) as o, duration_ms as m, null::timestamp as a from spans
    union all select 'failing', entry, span_id, row_number() over (partition by entry, trace_id order by "at" desc, span_id), null, "at" from spans where {BAD}),
  r as (select *, row_number() over (partition by why, entry order by m desc, a desc, span_id) as rank from one where o = 1) """


@query("top_01_samples", SAMPLES + "select entry, why, rank, span_id from r where rank <= 3")
def sample_spans(s, d):
    return M.samples(V.spans(s, d), "entry")


@query("top_02_slow_steps", SP + ", " + summary_sql("service, entry") + ' select service, entry, "count", p95 from summary where "count" >= 5 order by p95 desc, service, entry limit 10')
def slow_steps(s, d):
    return M.summary(V.spans(s, d), ["service", "entry"]).filter("count >= 5").orderBy(F.desc("p95"), "service", "entry").limit(10).select("service", "entry", "count", "p95")


@query("top_03_hot_paths", SP + ", c as (select entry, service, count(*) as hits, row_number() over (partition by entry order by count(*) desc, service) as k from spans group by 1, 2) select entry, service, hits, k from c where k <= 3")
def hot_paths(s, d):
    c = V.spans(s, d).groupBy("entry", "service").agg(F.count("*").alias("hits"))
    return c.withColumn("k", F.row_number().over(Window.partitionBy("entry").orderBy(F.desc("hits"), "service"))).filter("k <= 3")


@query("top_04_undeclared_ranking", SP + ", r as (select entry, status, count(*) as n, sum(count(*)) over (partition by entry) as total from spans group by 1, 2) select entry, cast(sum(case when status >= 500 then n else 0 end) as bigint) as open5, cast(sum(n) as bigint) as open_all, floor(max(n / total) * 10000 + 0.5) / 10000 as share from r where status >= 400 group by 1")
def undeclared(s, d):
    r = V.spans(s, d).groupBy("entry", "status").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("entry"))).filter("status >= 400")
    out = r.groupBy("entry").agg(F.sum(F.when(F.col("status") >= 500, F.col("n")).otherwise(0)).alias("open5"), F.sum("n").alias("open_all"), M.round_half_up(F.max(F.col("n") / F.col("total")), 4).alias("share"))
    return out.orderBy(F.desc("open5"), F.desc("open_all"), F.desc("share"))


@query("str_07_tumbling_hours", SP + f"select {HOUR} as start, service, count(*) as n, round(sum(duration_ms), 4) as total from spans group by 1, 2")
def tumbling(s, d):
    x = V.spans(s, d).groupBy(F.window("at", "1 hour"), "service").agg(F.count("*").alias("n"), F.round(F.sum("duration_ms"), 4).alias("total"))
    return x.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "service", "n", "total")


@query("str_08_retention", SP + f", l as (select max(\"at\") as now from spans) select {HOUR} as hour, count(*) as n from spans, l where {HOUR} + interval 1 hour >= now - interval 24 hour group by 1")
def retention(s, d):
    x = M.hours(V.spans(s, d))
    last = x.agg(F.max("at").alias("now"))
    return x.join(F.broadcast(last)).filter(F.expr("hour + interval 1 hour >= now - interval 24 hours")).groupBy("hour").agg(F.count("*").alias("n"))


@query("str_09_read_window", SP + f", l as (select max(\"at\") as now, min(\"at\") as begun from spans) select {HOUR} as hour, count(*) as n, bool_or(begun > now - interval 24 hour) as short from spans, l where {HOUR} >= now - interval 24 hour group by 1")
def read_window(s, d):
    x = M.hours(V.spans(s, d))
    ends = x.agg(F.max("at").alias("now"), F.min("at").alias("begun"))
    return x.join(F.broadcast(ends)).filter(F.expr("hour >= now - interval 24 hours")).groupBy("hour").agg(F.count("*").alias("n"), F.bool_or(F.expr("begun > now - interval 24 hours")).alias("short"))


@query("str_11_never_seen", SP + f", pairs as (select s.service, e.entry, k from (select distinct service from spans) s, (select distinct entry from spans) e, (select distinct k % 40 as k from spans) k) select * from pairs p where not exists (select 1 from spans x where x.service = p.service and x.entry = p.entry and x.k % 40 = p.k and {BAD} = false)")
def never_seen(s, d):
    x = V.spans(s, d).withColumn("k", F.col("k") % 40)
    services, entries, ks = (x.select(c).distinct() for c in ("service", "entry", "k"))
    declared = services.join(sized(entries, entries.count(), 256)).join(sized(ks, ks.count(), 16))
    return declared.join(x.filter(~M.failed()).select("service", "entry", "k"), ["service", "entry", "k"], "left_anti")


@query("str_12_traffic_overlay", SP + ", v as (select distinct service, entry from spans), t as (select service, entry, count(*) as hits from spans where k > 96 and status = 200 group by 1, 2) select v.service, v.entry, case when hits > 0 then 'alive' when v.entry = 'view' then 'likely-dead' else 'unknown' end as verdict from v left join t using (service, entry)")
def overlay(s, d):
    x = V.spans(s, d)
    t = x.filter("k > 96 and status = 200").groupBy("service", "entry").agg(F.count("*").alias("hits"))
    verdict = F.when(F.col("hits") > 0, "alive").when(F.col("entry") == "view", "likely-dead").otherwise("unknown")
    return x.select("service", "entry").distinct().join(t, ["service", "entry"], "left").select("service", "entry", verdict.alias("verdict"))


HALF = "\"at\" {} timestamp '2024-01-16'"


@query(
    "str_13_two_windows",
    SP + ", " + summary_sql("service, entry", HALF.format("<")) + ", first as (select * from summary), "
    + summary_sql("service, entry", HALF.format(">=")).replace("h as", "h2 as").replace("from h)", "from h2)").replace("c as", "c2 as").replace("from c group", "from c2 group").replace("q as", "q2 as").replace("join q ", "join q2 ").replace("b as", "b2 as").replace("from b left", "from b2 left").replace("summary as", "last as")
    + """ select service, entry, a."count" as a_count, b."count" as b_count, a.p95 as a_p95, b.p95 as b_p95,
      case when a."count" is null then 'appeared' when b."count" is null then 'gone' when a."count" < 20 or b."count" < 20 then 'few' when b.error_rate - a.error_rate >= 0.01 then 'failing' when b.p95 - a.p95 >= greatest(1.0, a.p95 * 0.1) then 'slower' else 'same' end as state
      from first a full join last b using (service, entry)""",
)
def two_windows(s, d):
    x = V.spans(s, d)
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    keys = ["service", "entry"]
    return M.compare(M.summary(x.filter(F.col("at") < cut), keys), M.summary(x.filter(F.col("at") >= cut), keys), keys)


@query("str_15_sliding", SP + "select w as start, count(*) as n from (select unnest([time_bucket(interval 30 minute, \"at\"), time_bucket(interval 30 minute, \"at\") - interval 30 minute]) as w from spans) group by 1")
def sliding(s, d):
    x = V.spans(s, d).groupBy(F.window("at", "1 hour", "30 minutes")).agg(F.count("*").alias("n"))
    return x.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")
