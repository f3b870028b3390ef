"""Flow trees, sequences and what reaches what, over the pages as a graph: a page leads to three others by its number.

Pages asked with a query are entries, German ones tables, those with a fragment channels, the rest methods; their host is the service.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bitmaps as B
from ..operators import flows as W
from ..sources import views as V
from .registry import query

DEPTH = 4


def pages(s, d):
    url = F.col("url")
    p = F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    lang = F.split_part(p, F.lit("/"), F.lit(2))
    kind = F.when(url.contains("#"), "channel").when(lang == "de", "table").when(url.contains("?"), "entry").otherwise("method")
    return V.read(s, d, "pages").select("page_id", F.concat(F.lit("page:"), "page_id").alias("id"), kind.alias("type"), F.concat_ws("/", lang, "page_id").alias("label"), F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1).alias("service"))


def links(s, d, nodes=None):
    n = pages(s, d) if nodes is None else nodes
    k = F.col("page_id")
    to = F.array(F.struct(F.lit(0).alias("order"), (2 * k + 1).alias("k")), F.struct(F.lit(1).alias("order"), (2 * k + 2).alias("k")), F.struct(F.lit(2).alias("order"), F.expr("page_id div 3").alias("k")))
    a = n.select(F.col("id").alias("from_id"), F.col("service").alias("sa"), F.explode(to).alias("t")).select("from_id", "sa", "t.order", F.col("t.k").alias("page_id"))
    b = n.select("page_id", F.col("id").alias("to_id"), F.col("service").alias("sb"), F.col("type").alias("tb"))
    kind = F.when(F.col("tb") == "table", "queries").when(F.col("tb") == "channel", "emits").when(F.col("sa") == F.col("sb"), "calls").otherwise("http_calls")
    return a.join(b, "page_id").select("from_id", "to_id", kind.alias("type"), "order", F.lit("static").alias("confidence"))


GRAPH_SQL = r"""n as (
  select page_id, 'page:' || page_id as id, case when contains(url, '#') then 'channel' when lang = 'de' then 'table' when contains(url, '?') then 'entry' else 'method' end as type, lang || '/' || page_id as label, service
  from (select page_id, url, split_part(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/', 2) as lang, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as service from pages)
), e0 as (
  select a.id as a, b.id as b, o as ord, case when b.type = 'table' then 'queries' when b.type = 'channel' then 'emits' when a.service = b.service then 'calls' else 'http_calls' end as type, b.label, b.service, b.page_id as k
  from n a, unnest([0, 1, 2]) u(o) join n b on b.page_id = case o when 0 then 2 * a.page_id + 1 when 1 then 2 * a.page_id + 2 else a.page_id // 3 end
), e as (
  select a, b, type, label, service, k, {'inner': type = 'calls', 'ord': ord, 'type': type, 'to': b} as key, case type when 'queries' then 'table:' || service || '/' || label when 'emits' then 'channel:' || label else service end as p from (
    select *, row_number() over (partition by a, b, type order by ord) as copy from e0) where copy = 1
)"""


def walk_sql(edges: str, p: str, depth: int = DEPTH) -> str:
    """Trees of all entries: levels first, then the first way to each node of a level, then the rows."""
    return f"""{p}lvl as (
  select id as entry, id, 0 as level from n where type = 'entry' union select l.entry, x.b, l.level + 1 from {p}lvl l join {edges} x on x.a = l.id where l.level < {depth}
), {p}least as (select entry, id, min(level) as level from {p}lvl group by 1, 2), {p}walk as (
  select id as entry, id, 0 as level, {{'path': [{{'inner': false, 'ord': -1, 'type': '', 'to': ''}}], 'at': service, 'way': [id]}} as x from n where type = 'entry'
  union all
  select w.entry, y.b, w.level + 1, min({{'path': w.x.path || [y.key], 'at': case when y.type = 'calls' and y.p = w.x.at then w.x.at else y.p end, 'way': w.x.way || [y.b]}})
  from {p}walk w join {edges} y on y.a = w.id join {p}least z on z.entry = w.entry and z.id = y.b and z.level = w.level + 1 where w.level < {depth} group by w.entry, y.b, w.level
), {p}rows as (
  select entry, path, level, parent, id, type, case when level = {depth} and note = '' and id in (select a from {edges}) then 'cut' else note end as note, kind, source, target, label from (
    select w.entry, w.x.path || [y.key] as path, w.level + 1 as level, w.id as parent, y.b as id, y.type,
      case when list_contains(w.x.way, y.b) then 'cycle' when z.x.path = w.x.path || [y.key] then '' else 'again' end as note,
      case when not (y.type = 'calls' and y.p = w.x.at) then y.type end as kind, w.x.at as source, y.p as target, y.label
    from {p}walk w join {edges} y on y.a = w.id left join {p}walk z on z.entry = w.entry and z.id = y.b where w.level < {depth})
  union all select id, [{{'inner': false, 'ord': -1, 'type': '', 'to': ''}}], 0, null, id, null, '', 'enters', 'caller', service, label from n where type = 'entry'
)"""


@query("trv_03_flow_rows", f"with recursive {GRAPH_SQL}, {walk_sql('e', '')} select entry, row_number() over (partition by entry order by path) - 1 as place, level, parent, id, type, note from rows")
def flow_rows(s, d):
    """The flow trees of all entries, in reading order."""
    n = pages(s, d)
    rows = W.placed(W.flow_rows(links(s, d, n), n, n.filter("type = 'entry'"), DEPTH))
    return rows.select("entry", "place", F.col("level").cast("long").alias("level"), "parent", "id", "type", "note")


@query("trv_22_sequences", f"with recursive {GRAPH_SQL}, {walk_sql('e', '')} select entry, row_number() over (partition by entry order by path) - 1 as place, kind, source, target, label from rows where kind is not null")
def sequences(s, d):
    """The steps of all entries' flows between hosts, tables and channels."""
    n = pages(s, d)
    return W.sequences(W.flow_rows(links(s, d, n), n, n.filter("type = 'entry'"), DEPTH))


LATER = "later as (select * from e where k % 7 <> 3), marks as (select distinct a as id from e where k % 7 = 3)"


def versions(s, d):
    n = pages(s, d)
    e = links(s, d, n)
    return n, e, e.filter(F.substring_index("to_id", ":", -1).cast("long") % 7 != 3)


@query(
    "dif_05_changed_flows",
    f"""with recursive {GRAPH_SQL}, {LATER}, {walk_sql('e', 'a_')}, {walk_sql('later', 'b_')},
    hops as (select id as entry, id, 0 as k from n where type = 'entry' union select h.entry, x.b, h.k + 1 from hops h join e x on x.a = h.id where h.k < 16),
    reached as (select entry, count(distinct id) as reaches from hops where id in (select id from marks) group by 1),
    sa as (select entry, count(*) as n from a_rows where kind is not null group by 1), sb as (select entry, count(*) as n from b_rows where kind is not null group by 1)
    select entry, reaches, sa.n as base, sb.n as head from reached join sa using (entry) join sb using (entry)""",
)
def changed_flows(s, d):
    """All flows that the loss of every link to each seventh page touches, by the steps that they had and have."""
    n, e, later = versions(s, d)
    found = W.changed_flows((n, e), (n, later), DEPTH)
    return found.select("entry", "reaches", (F.col("same") + F.col("removed")).alias("base"), (F.col("same") + F.col("added")).alias("head"))


@query(
    "dif_06_comparison",
    f"""with recursive {GRAPH_SQL}, later as (select * from e where k % 7 <> 3), cross_a as (select distinct a from e where type <> 'calls'), cross_b as (select distinct a from later where type <> 'calls')
    select 'edge' as what, a || ' -' || type || '-> ' || b as id, 'removed' as change from e where k % 7 = 3
    union all select 'node', id, 'changed' from n where page_id % 11 = 5 and type <> 'entry'
    union all select 'join', a, 'lost' from cross_a where a not in (select a from cross_b)""",
)
def comparison(s, d):
    """Two versions as a whole, without the flows, which dif_05 has: links to each seventh page are gone, some pages renamed."""
    n, e, later = versions(s, d)
    renamed = n.withColumn("label", F.when((F.col("page_id") % 11 == 5) & (F.col("type") != "entry"), F.concat("label", F.lit("!"))).otherwise(F.col("label")))
    return W.compared((n, e, None, None), (renamed, later, None, None), 1).filter("what <> 'flow'")


@query(
    "trv_15_writes_reached",
    f"""with recursive {GRAPH_SQL}, walk as (select id as entry, id, 0 as k from n where type = 'entry' union select w.entry, x.b, w.k + 1 from walk w join e x on x.a = w.id where w.k < 6 and x.type in ('calls', 'http_calls'))
    select distinct w.entry, x.b as "table" from walk w join e x on x.a = w.id where x.type = 'queries'""",
)
def writes_reached(s, d):
    """The tables that each entry comes to write within six calls."""
    n = pages(s, d)
    e = links(s, d, n)
    writes = e.filter("type = 'queries'").select(F.col("from_id").alias("id"), F.col("to_id").alias("table"))
    return B.writes_reached(e.filter("type in ('calls', 'http_calls')"), n.filter("type = 'entry'"), writes, 6)


@query(
    "trv_11_entries_in",
    f"""with recursive {GRAPH_SQL}, walk as (select id as entry, id, 0 as k from n where type = 'entry' union select w.entry, x.b, w.k + 1 from walk w join e x on x.a = w.id where w.k < 16)
    select id, count(distinct entry) as ways from walk group by 1""",
)
def entries_in(s, d):
    """By how many entries each page is reached within sixteen steps."""
    n = pages(s, d)
    return B.ways_in(links(s, d, n), n.filter("type = 'entry'"), 16)
