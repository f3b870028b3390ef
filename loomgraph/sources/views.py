"""The star-schema tables seen as a graph, as channels, as spans and as routes; in DataFrames and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..store import spread


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """id, type, kind, label, service: regions, nations, customers, suppliers, parts and orders."""
    region, nation = read(spark, d, "region"), read(spark, d, "nation")
    at = F.broadcast(nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name"))
    customer = read(spark, d, "customer").join(at, F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = read(spark, d, "supplier").join(at, F.col("s_nationkey") == F.col("n_nationkey"))
    orders = read(spark, d, "orders").join(customer.select("c_custkey", "r_name"), F.col("o_custkey") == F.col("c_custkey"))

    def of(df: DataFrame, kind: str, key: str, sub, label, service) -> DataFrame:
        return df.select(_id(kind, key).alias("id"), F.lit(kind).alias("type"), sub.cast("string").alias("kind"), label.cast("string").alias("label"), service.cast("string").alias("service"))

    none = F.lit(None)
    parts = [
        of(region, "region", "r_regionkey", none, F.col("r_name"), F.col("r_name")),
        of(nation.join(at, "n_nationkey"), "nation", "n_nationkey", none, F.col("n_name"), F.col("r_name")),
        of(customer, "customer", "c_custkey", F.col("c_mktsegment"), F.col("c_name"), F.col("r_name")),
        of(supplier, "supplier", "s_suppkey", none, F.col("s_name"), F.col("r_name")),
        of(read(spark, d, "part"), "part", "p_partkey", F.col("p_brand"), F.col("p_name"), none),
        of(orders, "order", "o_orderkey", F.col("o_orderpriority"), F.col("o_orderkey"), F.col("r_name")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


NODES_SQL = """
  select 'region:' || r_regionkey as id, 'region' as type, null as kind, r_name as label, r_name as service from region
  union all select 'nation:' || n_nationkey, 'nation', null, n_name, r_name from nation join region on r_regionkey = n_regionkey
  union all select 'customer:' || c_custkey, 'customer', c_mktsegment, c_name, r_name from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey
  union all select 'supplier:' || s_suppkey, 'supplier', null, s_name, r_name from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey
  union all select 'part:' || p_partkey, 'part', p_brand, p_name, null from part
  union all select 'order:' || o_orderkey, 'order', o_orderpriority, cast(o_orderkey as varchar), r_name from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey
"""


def line_pairs(line: DataFrame, lines: int, a: str, b: str) -> DataFrame:
    """a, b, flag: each pair of two numbers that so many counted lines have, with its greatest flag."""
    return spread(line.select(a, b, "l_returnflag"), lines, a, b).groupBy(a, b).agg(F.max("l_returnflag").alias("flag"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """from_id, to_id, type, confidence; one row for each (from_id, to_id, type)."""
    line = read(spark, d, "lineitem")
    lines = line.count()

    def of(df: DataFrame, kind: str, a, b) -> DataFrame:
        return df.select(a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("type"), F.lit("static").alias("confidence"))

    def folded(kind: str, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
        rows = line_pairs(line, lines, a[1], b[1])  # by numbers: ids are made once they are few
        sure = F.when(F.col("flag") == "R", "static").when(F.col("flag") == "N", "declared").otherwise("heuristic")
        return rows.select(_id(*a).alias("from_id"), _id(*b).alias("to_id"), F.lit(kind).alias("type"), sure.alias("confidence"))

    return (
        of(read(spark, d, "nation"), "in_region", _id("nation", "n_nationkey"), _id("region", "n_regionkey"))
        .unionByName(of(read(spark, d, "customer"), "lives_in", _id("customer", "c_custkey"), _id("nation", "c_nationkey")))
        .unionByName(of(read(spark, d, "supplier"), "based_in", _id("supplier", "s_suppkey"), _id("nation", "s_nationkey")))
        .unionByName(of(read(spark, d, "orders"), "placed_by", _id("order", "o_orderkey"), _id("customer", "o_custkey")))
        .unionByName(folded("contains", ("order", "l_orderkey"), ("part", "l_partkey")))
        .unionByName(folded("supplied_by", ("part", "l_partkey"), ("supplier", "l_suppkey")))
    )


EDGES_SQL = """
  select 'nation:' || n_nationkey as from_id, 'region:' || n_regionkey as to_id, 'in_region' as type, 'static' as confidence from nation
  union all select 'customer:' || c_custkey, 'nation:' || c_nationkey, 'lives_in', 'static' from customer
  union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'based_in', 'static' from supplier
  union all select 'order:' || o_orderkey, 'customer:' || o_custkey, 'placed_by', 'static' from orders
  union all select 'order:' || l_orderkey, 'part:' || l_partkey, 'contains', case max(l_returnflag) when 'R' then 'static' when 'N' then 'declared' else 'heuristic' end from lineitem group by l_orderkey, l_partkey
  union all select 'part:' || l_partkey, 'supplier:' || l_suppkey, 'supplied_by', case max(l_returnflag) when 'R' then 'static' when 'N' then 'declared' else 'heuristic' end from lineitem group by l_partkey, l_suppkey
"""


def trade_edges(spark: SparkSession, d: str, most: int = 2) -> DataFrame:
    """Nation to nation: the `most` nations that buy most from a nation's suppliers; from_id, to_id, type, confidence, weight (cents)."""
    line = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("a"))
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("b"))
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    sums = line.join(s, "l_suppkey").join(o, "l_orderkey").join(c, "o_custkey").filter("a <> b").groupBy("a", "b").agg(F.sum("cents").alias("weight"))
    ranked = sums.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("weight"), "b"))).filter(F.col("k") <= most)
    sure = F.when(F.col("k") == 1, "static").otherwise("heuristic")
    return ranked.select(_id("nation", "a").alias("from_id"), _id("nation", "b").alias("to_id"), F.lit("sells_to").alias("type"), sure.alias("confidence"), "weight")


TRADE_SQL = """
  select 'nation:' || a as from_id, 'nation:' || b as to_id, 'sells_to' as type, case when k = 1 then 'static' else 'heuristic' end as confidence, weight from (
    select a, b, weight, row_number() over (partition by a order by weight desc, b) as k from (
      select s_nationkey as a, c_nationkey as b, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as weight
      from lineitem join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
      where s_nationkey <> c_nationkey group by 1, 2)) where k <= 2
"""


def channel_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What channels is made of, a row a line, by numbers: emits (l_suppkey) and takes (o_custkey), each with p_brand, l_partkey, number."""
    brand = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    line = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").join(brand, "l_partkey")
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    other = F.when(F.col("o_custkey") % 3 == 0, F.col("l_linenumber") + 7).otherwise(F.col("l_linenumber"))
    own = ["p_brand", "l_partkey"]
    return line.select("l_suppkey", *own, F.col("l_linenumber").alias("number")), line.join(orders, "l_orderkey").select("o_custkey", *own, other.alias("number"))


def channel_name():
    return F.concat(F.lit("channel:"), "p_brand", F.lit("."), F.col("l_partkey").cast("string"), F.lit("."), F.col("number").cast("string"))


def channels(spark: SparkSession, d: str) -> DataFrame:
    """Of every line: its supplier emits to the channel of its part and line number, its order's customer consumes that channel, or
    (every third customer) one of another number that nobody emits to."""
    emitted, taken = channel_sides(spark, d)
    sure = lambda party: F.when(F.col(party) % 3 == 1, "heuristic").otherwise("static").alias("confidence")

    def folded(df: DataFrame, party: str) -> DataFrame:  # by numbers: names are made once they are few; with a null in it a name is null
        named = F.col("p_brand").isNotNull() & F.col("number").isNotNull()
        return df.select(party, *[F.when(named, F.col(x)).alias(x) for x in ("p_brand", "l_partkey", "number")]).distinct()

    emits = folded(emitted, "l_suppkey").select(_id("supplier", "l_suppkey").alias("from_id"), channel_name().alias("to_id"), F.lit("emits").alias("type"), sure("l_suppkey"))
    takes = folded(taken, "o_custkey").select(channel_name().alias("from_id"), _id("customer", "o_custkey").alias("to_id"), F.lit("consumes").alias("type"), sure("o_custkey"))
    return emits.unionByName(takes)


CHANNELS_SQL = """
  select distinct 'supplier:' || l_suppkey as from_id, 'channel:' || p_brand || '.' || l_partkey || '.' || l_linenumber as to_id, 'emits' as type, case when l_suppkey % 3 = 1 then 'heuristic' else 'static' end as confidence
  from lineitem join part on p_partkey = l_partkey
  union all
  select distinct 'channel:' || p_brand || '.' || l_partkey || '.' || case when o_custkey % 3 = 0 then l_linenumber + 7 else l_linenumber end, 'customer:' || o_custkey, 'consumes', case when o_custkey % 3 = 1 then 'heuristic' else 'static' end
  from lineitem join part on p_partkey = l_partkey join orders on o_orderkey = l_orderkey
"""


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Events as spans: a trace is a user's day, an entry an event type; parent: the user's event before, in the same trace."""
    e = read(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp_ntz"))
    trace = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("at", "yyyy-MM-dd"))
    w = Window.partitionBy("trace_id").orderBy("at", "span_id")
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_id") % 17 == 0, 404).otherwise(200)
    out = e.select(
        trace.alias("trace_id"),
        F.col("event_id").alias("span_id"),
        F.concat(F.lit("svc"), (F.col("user_id") % 7).cast("string")).alias("service"),
        F.col("event_type").alias("entry"),
        "at",
        status.alias("status"),
        F.col("value").alias("duration_ms"),
        (F.col("event_id") % 101 == 0).alias("error"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    return out.withColumn("parent_id", F.lag("span_id").over(w))


SPANS_SQL = """
  select *, lag(span_id) over (partition by trace_id order by "at", span_id) as parent_id from (
    select user_id || '/' || strftime(ts, '%Y-%m-%d') as trace_id, event_id as span_id, 'svc' || (user_id % 7) as service, event_type as entry, ts as "at",
      case when event_type = 'error' then 500 when event_id % 17 = 0 then 404 else 200 end as status, value as duration_ms,
      event_id % 101 = 0 as error, cast(json_extract_string(props, '$.k') as int) as k from events)
"""
