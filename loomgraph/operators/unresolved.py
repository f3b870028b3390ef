"""Rows that could not be followed: what they are, what sets them aside or answers them, and names resolved in stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import glob


def decoded(rows: DataFrame, reasons: DataFrame) -> DataFrame:
    """rows with kind (the stored one, else the reason's) and the reason's risk. reasons is a dimension: as many rows as reasons."""
    dim = reasons.select("reason", "reason_kind", "risk")
    return rows.join(F.broadcast(dim), "reason", "left").withColumn("kind", F.coalesce("kind", "reason_kind")).drop("reason_kind")


def missed() -> Column:
    """Whether a decoded row counts as missed: a gap that someone could do something about."""
    return (F.col("level") != "nothing") & (F.col("kind") == "gap")


def accepted(rows: DataFrame, accept: list[dict]) -> Column:
    """Whether any entry (column -> glob) accepts a row: one predicate, so a scan tells what is set aside from what stays."""
    out = F.lit(False)
    for entry in accept:
        if not entry:
            raise ValueError("an entry that accepts everything")
        one = F.lit(True)
        for c, pattern in entry.items():
            one = one & glob(F.coalesce(F.col(c).cast("string"), F.lit("")), pattern)
        out = out | one
    return out


def split_accepted(rows: DataFrame, accept: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows set aside)."""
    hit = accepted(rows, accept)
    return rows.filter(~hit), rows.filter(hit)


def route_pattern(pattern: str, method: Column, path: Column) -> Column:
    """Whether "GET /a/*/b" or "/a/**" takes a method and path: one star is a segment, two are any number, no verb is any."""
    import re

    verb, _, own = pattern.strip().rpartition(" ")
    parts = []
    for x in own.strip("/").split("/"):
        parts.append("(?:/[^/]+)*" if x == "**" else "/" + "[^/]*".join(re.escape(y) for y in x.split("*")) if x else "")
    fits = path.rlike("^" + "".join(parts) + "/?$")
    return fits & (F.upper(method) == verb.strip().upper()) if verb.strip() else fits


def demoted(rows: DataFrame, markers: DataFrame, reasons: DataFrame) -> DataFrame:
    """rows whose reason is answered by a marker that their service carries become level "info", with the marker in answered_by."""
    asked = rows.join(F.broadcast(reasons.filter("marker is not null").select("reason", "marker")), "reason", "left")
    own = markers.select("service", "marker").distinct().withColumn("answered_by", F.col("marker"))
    met = asked.join(own, ["service", "marker"], "left")
    return met.withColumn("level", F.when(F.col("answered_by").isNotNull() & (F.col("level") == "action"), "info").otherwise(F.col("level"))).drop("marker")


def resolve(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """refs (ref), targets (id, label) -> (ref, outcome found|ambiguous|missing, stage, id, n).

    The first stage with a hit counts: the id itself, the label, the label without case, its last part. Each is an equi-join
    on a key that a target has for each stage, so all stages are one join; names of many targets are counted, not listed.
    """
    key = lambda stage, c: F.struct(F.lit(stage).alias("stage"), c.alias("key"))
    last = F.lower(F.substring_index(F.substring_index("label", ".", -1), " ", -1))
    stages = targets.select("id", F.explode(F.array(key(1, F.col("id")), key(2, F.col("label")), key(3, F.lower("label")), key(4, last))).alias("s"))
    keys = stages.select("s.stage", F.col("s.key").alias("key"), "id").groupBy("stage", "key").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    own = refs.select("ref").distinct()
    asked = own.select("ref", F.explode(F.array(*[F.struct(F.lit(k).alias("stage"), (F.col("ref") if k < 3 else F.lower("ref")).alias("key")) for k in (1, 2, 3, 4)])).alias("s")).select("ref", "s.stage", "s.key")
    hit = asked.join(keys, ["stage", "key"]).groupBy("ref").agg(F.min(F.struct("stage", "n", "id")).alias("x"))
    out = own.join(hit, "ref", "left")
    outcome = F.when(F.col("x").isNull(), "missing").when(F.col("x.n") > 1, "ambiguous").otherwise("found")
    return out.select("ref", outcome.alias("outcome"), F.col("x.stage").alias("stage"), F.when(F.col("x.n") == 1, F.col("x.id")).alias("id"), F.coalesce("x.n", F.lit(0)).cast("long").alias("n"))


def channel_id(name: Column) -> Column:
    return F.when(name.startswith("channel:"), name).otherwise(F.concat(F.lit("channel:"), name))


def never_dead(kind: Column) -> Column:
    """Entries that something outside starts: nobody in the graph has to call them."""
    return kind.isin("cron", "invoke", "workflow", "bot_command", "bot_callback", "bot_event", "scene_step")


def doctor(rows: DataFrame, reasons: DataFrame, most: int = 20) -> DataFrame:
    """decoded rows by reason with their hint: missed rows, sites, notes and findings; the `most` worst reasons."""
    n = lambda c: F.count_if(c).alias
    out = rows.groupBy("reason").agg(
        n(missed())("missed"), F.sum(F.when(missed(), F.col("sites")).otherwise(0)).alias("sites"), n(F.col("kind") == "note")("notes"), n(F.col("kind") == "finding")("findings"), F.count_distinct("service").alias("services"),
    )
    return out.join(F.broadcast(reasons.select("reason", "hint")), "reason", "left").orderBy(F.desc("missed"), F.desc("sites"), "reason").limit(most)


def nearest_reasons(asked: DataFrame, reasons: DataFrame, most: int = 3) -> DataFrame:
    """For reasons that the dimension lacks, the nearest that it has: by edit distance, at most a third of the length."""
    lacking = asked.select("reason").distinct().join(F.broadcast(reasons.select("reason")), "reason", "left_anti").withColumnRenamed("reason", "asked")
    dim = reasons.agg(F.collect_list("reason").alias("all"))  # one row: the dimension
    near = lacking.join(F.broadcast(dim)).select("asked", F.explode("all").alias("reason")).withColumn("distance", F.levenshtein(F.lower("asked"), F.lower("reason")))
    fit = near.filter(F.col("distance") <= F.greatest(F.lit(2), F.floor(F.length("asked") / 3)))
    return fit.groupBy("asked").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "reason"))), 1, most).alias("near")).select("asked", F.transform("near", lambda x: x["reason"]).alias("near"))


def marker_faults(markers: DataFrame, nodes: DataFrame, known: list[str]) -> DataFrame:
    """(service, marker, fault): marks of services that the graph lacks, and marks that nobody knows."""
    services = nodes.filter("service is not null").select("service").distinct()
    lost = markers.join(services, "service", "left_anti").select("service", "marker", F.lit("no such service").alias("fault"))
    return lost.unionByName(markers.filter(~F.col("marker").isin(known)).select("service", "marker", F.lit("unknown marker").alias("fault")))
