"""Joins that link graphs: routes, patterns, unique references, merges. Ambiguity is told, never resolved by picking one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import PARAM, segments
from ..store import materialise

_MIXED = r"^(.*)(:param)(.*)$"


def segment_answers(route: Column, asked: Column) -> Column:
    """Whether one route segment takes one asked for: "*" and :param any, a part around :param its text, else equal but for case."""
    lower = F.lower(asked)
    around = F.regexp_extract(F.lower(route), _MIXED, 1), F.regexp_extract(F.lower(route), _MIXED, 3)
    mixed = lower.startswith(around[0]) & lower.endswith(around[1]) & (F.length(lower) > F.length(around[0]) + F.length(around[1]))
    return (route == "*") | (route == PARAM) | F.when(route.contains(PARAM), mixed).otherwise(F.lower(route) == lower)


def routes_of(routes: DataFrame) -> DataFrame:
    """route_id, method, path, app -> plus r (segments), tail (ends in "*"), wild, params, literals, n and head for the join."""
    r = F.col("r")
    out = routes.withColumn("r", segments(F.col("path"))).filter(F.size("r") > 0)
    out = out.withColumn("tail", F.element_at(r, -1) == "*")
    count = lambda f: F.size(F.filter(r, f))
    first = F.element_at(r, 1)
    return out.select(
        "*",
        F.size("r").alias("n"),
        F.when(first.contains(PARAM) | (first == "*"), "*").otherwise(F.lower(first)).alias("head"),
        count(lambda x: x == "*").alias("wild"),
        count(lambda x: x.contains(PARAM)).alias("params"),
        count(lambda x: (x != "*") & ~x.contains(PARAM)).alias("literals"),
    )


def match_routes(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """calls (call_id, method, path, app) -> (call_id, outcome match|ambiguous|not-found, route_id, candidates).

    Candidates share the number of segments (a trailing "*" takes more) and the first segment, or have a hole there; so the
    join has keys. The caller's own application is preferred; then the fewest wildcards, fewest parameters, most literals.
    """
    r = routes_of(routes).select("route_id", F.upper("method").alias("rm"), F.col("app").alias("ra"), "r", "tail", "n", "head", "wild", "params", "literals")
    c = calls.select("call_id", F.upper(F.coalesce("method", F.lit("GET"))).alias("cm"), F.col("app").alias("ca"), segments(F.col("path")).alias("c")).filter("size(c) > 0")
    heads = c.withColumn("head", F.explode(F.array(F.lower(F.element_at("c", 1)), F.lit("*"))))
    exact = heads.withColumn("n", F.size("c")).join(r.filter("not tail"), ["n", "head"])
    tails = heads.withColumn("n", F.explode(F.sequence(F.lit(1), F.size("c")))).join(r.filter("tail"), ["n", "head"])
    both = exact.select("call_id", "cm", "ca", "c", "route_id", "rm", "ra", "r", "wild", "params", "literals").unionByName(tails.select("call_id", "cm", "ca", "c", "route_id", "rm", "ra", "r", "wild", "params", "literals"))
    fits = F.forall(F.zip_with("r", F.slice("c", 1, F.size("r")), lambda x, y: segment_answers(x, y)), lambda ok: ok)
    hits = both.filter((F.col("rm") == F.col("cm")) | (F.col("rm") == "ALL")).filter(fits)
    w = Window.partitionBy("call_id").orderBy(F.desc(F.coalesce(F.col("ra") == F.col("ca"), F.lit(False))), "wild", "params", F.desc("literals"))
    best = hits.withColumn("k", F.rank().over(w)).filter("k = 1").groupBy("call_id").agg(F.sort_array(F.collect_set("route_id")).alias("candidates"))
    out = calls.select("call_id").join(best, "call_id", "left")
    outcome = F.when(F.col("candidates").isNull(), "not-found").when(F.size("candidates") > 1, "ambiguous").otherwise("match")
    return out.select("call_id", outcome.alias("outcome"), F.when(F.size("candidates") == 1, F.element_at("candidates", 1)).alias("route_id"), "candidates")


def one_off(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """(call_id, route_id, place): routes of as many segments that differ in just one; joined by what is left without it."""
    def holes(df: DataFrame, key: str) -> DataFrame:
        s = df.withColumn("s", F.transform(segments(F.lower("path")), lambda x: F.when(x.contains(PARAM), PARAM).otherwise(x)))
        return s.select(key, F.posexplode("s").alias("place", "x"), "s").select(key, "place", "x", F.array_join(F.transform("s", lambda y, i: F.when(i == F.col("place"), "").otherwise(y)), "/").alias("rest"))

    a, b = holes(calls, "call_id"), holes(routes, "route_id").withColumnRenamed("x", "y")
    return a.join(b, ["place", "rest"]).filter("x <> y").select("call_id", "route_id", "place").distinct()


def unique_references(refs: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """refs (ref_id, *on) against targets (target_id, *on): outcome linked, not-found or ambiguous; the target only if it is the one."""
    t = targets.groupBy(*on).agg(F.count_distinct("target_id").alias("found"), F.min("target_id").alias("one"))
    out = refs.join(t, on, "left")
    state = F.when(F.col("found").isNull(), "not-found").when(F.col("found") > 1, "ambiguous").otherwise("linked")
    return out.select("ref_id", state.alias("outcome"), F.when(F.col("found") == 1, F.col("one")).alias("target_id"))


def pattern_takes(name: Column, pattern: Column) -> Column:
    """Names of dots and patterns where "*" is one part and a last ">" one or more."""
    n, p = F.split(name, r"\."), F.split(pattern, r"\.")
    tail = F.element_at(p, -1) == ">"
    own = F.when(tail, F.slice(p, 1, F.size(p) - 1)).otherwise(p)
    fits = F.forall(F.zip_with(own, F.slice(n, 1, F.size(own)), lambda a, b: F.coalesce((a == "*") | (a == b), F.lit(False))), lambda x: x)
    return fits & F.when(tail, F.size(n) >= F.size(p)).otherwise(F.size(n) == F.size(p))


def join_patterns(names: DataFrame, filters: DataFrame) -> DataFrame:
    """names (name), filters (consumer, pattern, forward): (name, consumer) to a fixpoint; a forward is a name that is matched again.

    Patterns are joined by their first part, or under "*" if that is a hole: keys, not a product.
    """
    f = filters.withColumn("head", F.when(F.substring_index("pattern", ".", 1).isin("*", ">"), "*").otherwise(F.substring_index("pattern", ".", 1)))
    fresh, seen, out = names.select("name").distinct(), names.select("name").distinct(), None
    while True:  # forwards are names of filters, so there are only so many to come
        heads = fresh.withColumn("head", F.explode(F.array(F.substring_index("name", ".", 1), F.lit("*"))))
        hits = materialise(heads.join(f, "head").filter(pattern_takes(F.col("name"), F.col("pattern"))).select("name", "consumer", "forward").distinct(), "patterns")
        out = hits if out is None else out.unionByName(hits)
        fresh = materialise(hits.filter("forward is not null").select(F.col("forward").alias("name")).distinct().join(seen, "name", "left_anti"), "names")
        if not fresh.limit(1).count():
            break
        seen = seen.unionByName(fresh)
    return out.select("name", "consumer").distinct()


def merge_first_wins(parts: DataFrame, key: str, order: str, origin: str) -> tuple[DataFrame, DataFrame]:
    """(kept, collisions): the first row of each key by `order`; keys that rows of another origin have too."""
    w = Window.partitionBy(key)
    ranked = parts.withColumn("_k", F.row_number().over(w.orderBy(order))).withColumn("_o", F.first(origin).over(w.orderBy(order)))
    clash = ranked.filter((F.col("_k") > 1) & (F.col(origin) != F.col("_o"))).select(key, F.col("_o").alias("kept"), F.col(origin).alias("dropped")).distinct()
    return ranked.filter("_k = 1").drop("_k", "_o"), clash
