"""Graph documents in JSON as the four tables, and stored traffic files of earlier formats as today's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FIELDS = "array<struct<name:string,type:string,optional:boolean>>"
GRAPH = (
    "nodes array<struct<id:string,type:string,kind:string,label:string,service:string,repo:string,file:string,line:int>>,"
    "edges array<struct<from:string,to:string,type:string,confidence:string,params:array<string>,returns:string,file:string,line:int>>,"
    f"types map<string,struct<name:string,kind:string,repo:string,declaredIn:string,structuralHash:string,fields:{_FIELDS},members:array<string>>>,"
    "unresolved array<struct<service:string,file:string,line:int,reason:string,level:string,sites:int,message:string,hint:string,kind:string,risk:string>>"
)


def read_graph(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """nodes, edges, types and unresolved of one or more documents (a document a file, or a line); a document that doesn't parse fails the job.

    Nodes and edges without an id, an end or a type are refused. Of edges with the same ends and type one stays. Rows of
    `unresolved` get level "action", one site and kind "gap" where these are left out.
    """
    doc = spark.read.schema(GRAPH).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    refuse = lambda ok, what: F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(what)))
    nodes = doc.select(F.explode("nodes").alias("n")).select("n.*")
    nodes = nodes.filter(refuse(F.col("id").isNotNull() & F.col("type").isNotNull(), "a node without id or type"))
    e = doc.select(F.explode("edges").alias("e")).select(F.col("e.from").alias("from_id"), F.col("e.to").alias("to_id"), "e.type", F.coalesce("e.confidence", F.lit("static")).alias("confidence"), "e.params", "e.returns", "e.file", "e.line")
    e = e.filter(refuse(F.col("from_id").isNotNull() & F.col("to_id").isNotNull() & F.col("type").isNotNull(), "an edge without ends or type")).dropDuplicates(["from_id", "to_id", "type"])
    t = doc.select(F.explode("types").alias("id", "t")).select("id", "t.name", "t.kind", "t.repo", F.col("t.declaredIn").alias("declared_in"), F.col("t.structuralHash").alias("structural_hash"), "t.fields", "t.members")
    u = doc.select(F.explode("unresolved").alias("u")).select("u.*").fillna({"level": "action", "sites": 1, "kind": "gap"})
    return {"nodes": nodes, "edges": e, "types": t, "unresolved": u}


def write_graph(tables: dict[str, DataFrame], path: str) -> None:
    """One JSON line for each node and edge, by table: what read_graph's tables need to be written again elsewhere."""
    for name in ("nodes", "edges", "types", "unresolved"):
        if name in tables:
            tables[name].write.mode("overwrite").json(f"{path}/{name}")


def upgrade_observed(rows: DataFrame) -> DataFrame:
    """Stored hourly traffic of formats 1 to 3 in the form of 3.

    Format 1 had neither hours nor histograms: its rows belong to the hour they were last seen in; format 2 had no errors.
    """
    have = set(rows.columns)
    col = lambda n, kind, other: F.coalesce(F.col(n), other).cast(kind) if n in have else other.cast(kind)
    return rows.select(
        "family", "id", "count",
        col("hour", "timestamp", F.date_trunc("hour", F.col("last_seen"))).alias("hour"),
        col("errors", "long", F.lit(0)).alias("errors"),
        col("hist", "map<int,long>", F.create_map().cast("map<int,long>")).alias("hist"),
        "last_seen", F.lit(3).alias("format"),
    )


def catalogue(nodes: DataFrame, joins: DataFrame) -> DataFrame:
    """(name, document): for each service a JSON component with what it depends on, by catalogue name, strongest first."""
    from ..functions.scalars import catalog_name

    own = nodes.filter("service is not null").select("service").distinct()
    deps = joins.groupBy(F.col("from_service").alias("service")).agg(F.sort_array(F.collect_set(catalog_name(F.col("to_service")))).alias("dependsOn"))
    doc = F.to_json(F.struct(F.lit("Component").alias("kind"), F.struct(catalog_name(F.col("service")).alias("name")).alias("metadata"), F.struct(F.coalesce("dependsOn", F.array().cast("array<string>")).alias("dependsOn")).alias("spec")))
    return own.join(deps, "service", "left").select(catalog_name(F.col("service")).alias("name"), doc.alias("document"))
