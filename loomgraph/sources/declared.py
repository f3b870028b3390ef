"""Further views of the star-schema tables: types with fields, rows that could not be followed, and call sites; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import read

FIELD = "struct<name:string,type:string,optional:boolean>"


def types(spark: SparkSession, d: str) -> DataFrame:
    """A type for each brand and kind of part: a field for each remainder of its sizes, and one of the brand's inner type."""
    p = read(spark, d, "part")
    sizes = p.groupBy("p_brand", "p_type").agg(F.sort_array(F.collect_set(F.col("p_size") % 7)).alias("k"))  # seven values at most
    field = lambda n, t, o: F.struct(n.alias("name"), t.alias("type"), o.alias("optional")).cast(FIELD)
    own = F.transform("k", lambda k: field(F.concat(F.lit("s"), k.cast("string")), F.when(k % 2 == 0, "number").otherwise("string | undefined"), k % 3 == 0))
    inner = F.concat(F.lit("type:"), "p_brand", F.lit(".in"))
    outer = sizes.select(
        F.concat(F.lit("type:"), "p_brand", F.lit("."), "p_type").alias("id"), F.col("p_type").alias("name"), F.col("p_brand").alias("repo"),
        F.array_append(own, field(F.lit("in"), inner, F.lit(False))).alias("fields"),
    )
    within = p.select("p_brand").distinct().select(inner.alias("id"), F.lit("in").alias("name"), F.col("p_brand").alias("repo"), F.array(field(F.lit("n"), F.lit("number"), F.lit(False)), field(F.lit("at"), F.lit("Date"), F.lit(True))).alias("fields"))
    return outer.unionByName(within).withColumn("kind", F.lit("object"))


TYPES_SQL = """
  select 'type:' || p_brand || '.' || p_type as id, p_type as name, p_brand as repo, list_sort(list(distinct p_size % 7)) as k from part group by p_brand, p_type
  union all select distinct 'type:' || p_brand || '.in', 'in', p_brand, null from part
"""

#: Flattened fields of the types: (id, name, repo, path, type, optional).
FLAT_SQL = f"""
  select id, name, repo, 's' || x as path, case when x % 2 = 0 then 'number' else 'string | undefined' end as type, x % 3 = 0 as optional from (select *, unnest(k) as x from ({TYPES_SQL}) where k is not null)
  union all select id, name, repo, 'in', 'type:' || repo || '.in', false from ({TYPES_SQL}) where k is not null
  union all select id, name, repo, 'in.n', 'number', false from ({TYPES_SQL}) where k is not null
  union all select id, name, repo, 'in.at', 'Date', true from ({TYPES_SQL}) where k is not null
  union all select id, name, repo, 'n', 'number', false from ({TYPES_SQL}) where k is null
  union all select id, name, repo, 'at', 'Date', true from ({TYPES_SQL}) where k is null
"""


def unresolved(spark: SparkSession, d: str) -> DataFrame:
    """Orders as rows that could not be followed: the reason is the priority, the level the status; some have a stored kind."""
    o = read(spark, d, "orders")
    level = F.when(F.col("o_orderstatus") == "F", "action").when(F.col("o_orderstatus") == "O", "info").otherwise("nothing")
    text = lambda p, c, m: F.concat(F.lit(p), (F.col(c) % m).cast("string"))
    return o.select(
        F.col("o_orderkey").alias("id"), text("svc", "o_custkey", 5).alias("service"), F.concat(text("f", "o_custkey", 97), F.lit(".ts")).alias("file"), (F.col("o_orderkey") % 500).cast("int").alias("line"),
        F.col("o_orderpriority").alias("reason"), level.alias("level"), (1 + F.col("o_orderkey") % 3).cast("int").alias("sites"), F.when(F.col("o_orderkey") % 4 == 0, "note").alias("kind"),
        F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("symbol"),
    )


UNRESOLVED_SQL = """
  select o_orderkey as id, 'svc' || (o_custkey % 5) as service, 'f' || (o_custkey % 97) || '.ts' as file, cast(o_orderkey % 500 as int) as line, o_orderpriority as reason,
    case o_orderstatus when 'F' then 'action' when 'O' then 'info' else 'nothing' end as level, cast(1 + o_orderkey % 3 as int) as sites,
    case when o_orderkey % 4 = 0 then 'note' end as kind, 'customer:' || o_custkey as symbol from orders
"""

# What each reason is, where a row doesn't say so itself; its risk; its hint; the marker that answers it.
REASONS = (
    ("1-URGENT", "gap", "auth", "name the caller", "answers"),
    ("2-HIGH", "gap", "wiring", "bind the service", None),
    ("3-MEDIUM", "finding", "performance", "look at the loop", None),
    ("4-NOT SPECIFIED", "note", None, None, None),
    ("5-LOW", "gap", None, "say what is called", "calls"),
)
REASONS_SQL = "select * from (values ('1-URGENT', 'gap', 'auth', 'name the caller', 'answers'), ('2-HIGH', 'gap', 'wiring', 'bind the service', null), ('3-MEDIUM', 'finding', 'performance', 'look at the loop', null), ('4-NOT SPECIFIED', 'note', null, null, null), ('5-LOW', 'gap', null, 'say what is called', 'calls')) r(reason, reason_kind, risk, hint, marker)"


def reasons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REASONS, "reason string, reason_kind string, risk string, hint string, marker string")


def markers(spark: SparkSession, d: str) -> DataFrame:
    """Marks that services carry: services whose customers have a low balance answer, those of machinery call."""
    c = read(spark, d, "customer")
    at = F.concat(F.lit("svc"), (F.col("c_custkey") % 5).cast("string"))
    a = c.filter("c_acctbal < -990").select(at.alias("service"), F.lit("answers").alias("marker"))
    return a.union(c.filter("c_mktsegment = 'MACHINERY' and c_acctbal > 9900").select(at, F.lit("calls"))).distinct()


MARKERS_SQL = "select distinct 'svc' || (c_custkey % 5) as service, 'answers' as marker from customer where c_acctbal < -990 union select 'svc' || (c_custkey % 5), 'calls' from customer where c_mktsegment = 'MACHINERY' and c_acctbal > 9900"
