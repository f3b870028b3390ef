"""Spans credited to the graph: routes by score, joins between services, cloud calls, and browser calls in stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import PARAM, join_id, normalise_path, segments
from ..store import materialise, sized
from .linking import match_routes, segment_answers


def _head(segments_: Column, pattern: bool = False) -> Column:
    """The first segment in small letters, "" where there is none; of a route "*" where a hole or any text stands there."""
    first = F.coalesce(F.lower(F.get(segments_, F.lit(0))), F.lit(""))
    return F.when(first.contains(PARAM) | (first == "*"), "*").otherwise(first) if pattern else first


def _heads(segments_: Column) -> Column:
    """The keys under which a request may meet a route: its own first segment, and a hole."""
    return F.explode(F.array(_head(segments_), F.lit("*")))


def score_routes(spans: DataFrame, routes: DataFrame) -> DataFrame:
    """(span_id, outcome match|ambiguous|not-found, route_id, score): server spans against routes of their service.

    A span that tells its route meets the route of that template; others are matched by path, segment by segment, and the score
    is the number of literal segments. All best ones count, so more than one is ambiguous. Candidates share the number of segments
    and the first one, or have a hole there. Spans are folded to their different requests first: what is joined is as many rows as there are requests, however often each was made.
    """
    asked = spans.select("span_id", "service", F.upper(F.coalesce("method", F.lit("GET"))).alias("m"), F.coalesce(normalise_path(F.col("route")), F.col("path")).alias("p"), F.col("route").isNotNull().alias("told"))
    kinds = asked.select("service", "m", "p", "told").distinct()
    r = routes.select("route_id", F.col("service"), F.upper("method").alias("rm"), normalise_path(F.col("path")).alias("rp")).withColumn("r", segments(F.col("rp"))).withColumn("n", F.size("r")).withColumn("head", _head(F.col("r"), True))
    verb = (F.col("rm") == F.col("m")) | (F.col("rm") == "ALL")
    told = kinds.filter("told").join(r, (kinds["service"] == r["service"]) & (F.col("p") == F.col("rp"))).filter(verb)
    told = told.select(kinds["service"], "m", "p", "told", "route_id", F.size(F.filter("r", lambda x: ~x.contains(PARAM))).alias("score"))
    by_path = kinds.filter("not told").withColumn("c", segments(F.col("p"))).withColumn("n", F.size("c")).withColumn("head", _heads(F.col("c")))
    met = by_path.join(r, ["service", "n", "head"]).filter(verb).filter(F.forall(F.zip_with("r", "c", lambda x, y: segment_answers(x, y)), lambda ok: ok))
    met = met.select("service", "m", "p", "told", "route_id", F.size(F.filter("r", lambda x: ~x.contains(PARAM) & (x != "*"))).alias("score"))
    both = told.unionByName(met)
    best = both.withColumn("k", F.rank().over(Window.partitionBy("service", "m", "p", "told").orderBy(F.desc("score")))).filter("k = 1")
    one = best.groupBy("service", "m", "p", "told").agg(F.count("*").alias("n"), F.min("route_id").alias("route"), F.max("score").alias("score"))
    out = asked.join(one, ["service", "m", "p", "told"], "left")
    outcome = F.when(F.col("n").isNull(), "not-found").when(F.col("n") > 1, "ambiguous").otherwise("match")
    return out.select("span_id", outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("route")).alias("route_id"), "score")


def credit_joins(spans: DataFrame, failed: Column) -> DataFrame:
    """(join, count, errors): what spans say about joins between services, by join id.

    A server span whose parent is a span of another service is a call of its entry. A client span without a child in another
    service, but with a destination, is a call of that host. Producers emit to the channel of their destination, and what they
    start consumes it. Parents are found by one equi-join on trace and span.
    """
    s = spans.withColumn("bad", failed)
    parent = s.select("trace_id", F.col("span_id").alias("parent_id"), F.col("service").alias("from_service"), F.col("kind").alias("from_kind"))
    met = s.join(parent, ["trace_id", "parent_id"], "left")
    called = met.filter((F.col("kind") == "server") & (F.col("from_service") != F.col("service")))
    calls = called.select(join_id(F.col("from_service"), F.lit("http_calls"), F.concat_ws(":", F.lit("entry"), "service", "entry")).alias("join"), "bad")
    answered = called.select("trace_id", F.col("parent_id").alias("span_id")).distinct()
    alone = s.filter("kind = 'client' and destination is not null").join(answered, ["trace_id", "span_id"], "left_anti")
    out = alone.select(join_id(F.col("service"), F.lit("http_calls"), F.concat(F.lit("external_api:"), "destination")).alias("join"), "bad")
    emits = s.filter("kind = 'producer' and destination is not null").select(join_id(F.col("service"), F.lit("emits"), F.concat(F.lit("channel:"), "destination")).alias("join"), "bad")
    takes = s.filter("kind = 'consumer' and destination is not null").select(join_id(F.concat(F.lit("channel:"), "destination"), F.lit("consumes"), F.col("service")).alias("join"), "bad")
    rows = calls.unionByName(out).unionByName(emits).unionByName(takes)
    return rows.groupBy("join").agg(F.count("*").alias("count"), F.count_if("bad").alias("errors"))


# What a call of a cloud service does, and which kind of node it touches.
CLOUD_CALLS = (
    ("DynamoDB", "GetItem", "queries", "table", "read"), ("DynamoDB", "Query", "queries", "table", "read"), ("DynamoDB", "PutItem", "queries", "table", "write"), ("DynamoDB", "DeleteItem", "queries", "table", "delete"),
    ("S3", "GetObject", "queries", "table", "read"), ("S3", "PutObject", "queries", "table", "write"), ("SQS", "SendMessage", "emits", "channel", "write"), ("SNS", "Publish", "emits", "channel", "write"),
    ("Lambda", "Invoke", "triggers", "entry", "start"), ("StepFunctions", "StartExecution", "triggers", "entry", "start"),
)


def match_cloud(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """spans (span_id, api, operation, resource) against nodes (id, type, label): (span_id, outcome, join, node, op).

    What a call does is looked up in the table above; the resource's last part has to name exactly one node of that type.
    """
    table = spans.sparkSession.createDataFrame(CLOUD_CALLS, "api string, operation string, join string, type string, op string")
    known = spans.join(F.broadcast(table), ["api", "operation"], "left")
    name = F.lower(F.regexp_extract("resource", r"([^:/]+)$", 1))
    targets = nodes.groupBy("type", F.lower("label").alias("name")).agg(F.count_distinct("id").alias("n"), F.min("id").alias("node"))
    met = known.withColumn("name", name).join(targets, ["type", "name"], "left")
    outcome = F.when(F.col("join").isNull(), "unknown call").when(F.col("n").isNull(), "not-found").when(F.col("n") > 1, "ambiguous").otherwise("match")
    return met.select("span_id", outcome.alias("outcome"), "join", F.when(F.col("n") == 1, F.col("node")).alias("node"), "op")


def match_mounted(calls: DataFrame, routes: DataFrame, mounts: Sequence[str]) -> DataFrame:
    """As match_routes, and calls that find nothing are asked again as they would be under an assumed mount: footing read or mount.

    A mount is a prefix that a call has and the route as written hasn't, or the other way round. Both tries are one join of calls
    with as many paths as there are mounts; the read footing wins over any assumed one.
    """
    first = match_routes(calls, routes).withColumn("footing", F.lit("read"))
    left = calls.join(first.filter("outcome = 'not-found'").select("call_id"), "call_id", "left_semi")
    again = None
    for m in mounts:
        inside = F.when(F.col("path").startswith(m + "/"), F.substring("path", len(m) + 1, 1 << 20)).otherwise(F.concat(F.lit(m), "path"))
        part = left.withColumn("path", inside)
        again = part if again is None else again.unionByName(part)
    if again is None:
        return first.select("call_id", "outcome", "route_id", "footing")
    numbered = again.withColumn("try", F.to_json(F.struct("call_id", "path")))
    hits = match_routes(numbered.select(F.col("try").alias("call_id"), "method", "path", "app"), routes).filter("outcome <> 'not-found'")
    own = hits.join(numbered.select(F.col("try").alias("t"), F.col("call_id").alias("own")), F.col("call_id") == F.col("t")).select("own", F.explode("candidates").alias("route_id")).distinct()
    mounted = own.groupBy(F.col("own").alias("call_id")).agg(F.count("*").alias("n"), F.min("route_id").alias("m_route"))
    out = first.join(mounted, "call_id", "left")
    taken = (F.col("outcome") == "not-found") & F.col("n").isNotNull()
    return out.select(
        "call_id",
        F.when(taken, F.when(F.col("n") > 1, "ambiguous").otherwise("match")).otherwise(F.col("outcome")).alias("outcome"),
        F.when(taken, F.when(F.col("n") == 1, F.col("m_route"))).otherwise(F.col("route_id")).alias("route_id"),
        F.when(taken, "mount").when(F.col("outcome") != "not-found", "read").alias("footing"),
    )


#: The stages of a browser call, in the order in which they are asked.
STAGES = ("annotation", "target", "base", "same service", "unique route")


def browser_calls(calls: DataFrame, routes: DataFrame, bases: DataFrame) -> DataFrame:
    """calls (call_id, service, verb, path, annotation, target, base) -> (call_id, outcome, stage, route_id).

    routes (route_id, service, method, path); bases (base, service): which services claim a base variable. A call without a path
    or verb, or with an unread hole, is dynamic. Then the first stage that answers counts: the route that an annotation names,
    the routes of the target service, of the one service that claims the base, of the own service, of any service. More than one
    route of a stage is ambiguous; no stage is no route. Each call is folded to its request, and a request meets the routes
    with as many segments and the same first one, or a hole there, once; the stages are conditions on these pairs.
    """
    claimed = bases.groupBy("base").agg(F.count_distinct("service").alias("claims"), F.min("service").alias("claimed"))
    known = calls.join(claimed, "base", "left").withColumn("claimed", F.when(F.col("claims") == 1, F.col("claimed")))
    dynamic = F.col("path").isNull() | F.col("verb").isNull() | F.col("path").contains("${")
    asked = known.filter(~dynamic).withColumn("c", segments(F.col("path"))).withColumn("n", F.size("c"))
    request = asked.select("verb", "path", "c", "n").distinct().withColumn("head", _heads(F.col("c")))
    r = routes.select("route_id", F.col("service").alias("rs"), F.upper("method").alias("rm"), segments(normalise_path(F.col("path"))).alias("r")).withColumn("n", F.size("r")).withColumn("head", _head(F.col("r"), True))
    fits = F.forall(F.zip_with("r", "c", lambda x, y: segment_answers(x, y)), lambda ok: ok)
    met = request.join(r, ["n", "head"]).filter(((F.col("rm") == F.upper("verb")) | (F.col("rm") == "ALL")) & fits).select("verb", "path", "route_id", "rs")
    pairs = asked.select("call_id", "service", "verb", "path", "annotation", "target", "claimed").join(met, ["verb", "path"])
    stage = F.when(F.col("annotation") == F.col("route_id"), 0).when(F.col("target") == F.col("rs"), 1).when(F.col("claimed") == F.col("rs"), 2).when(F.col("service") == F.col("rs"), 3).otherwise(4)
    by = pairs.groupBy("call_id", stage.alias("stage")).agg(F.count_distinct("route_id").alias("n"), F.min("route_id").alias("route_id"))
    best = by.groupBy("call_id").agg(F.min(F.struct("stage", "n", "route_id")).alias("x"))
    out = calls.select("call_id", dynamic.alias("dynamic")).join(best, "call_id", "left")
    outcome = F.when(F.col("dynamic"), "dynamic").when(F.col("x").isNull(), "noRoute").when(F.col("x.n") > 1, "ambiguous").otherwise("linked")
    names = F.array(*[F.lit(x) for x in STAGES])
    return out.select("call_id", outcome.alias("outcome"), F.get(names, F.col("x.stage")).alias("stage"), F.when(F.col("x.n") == 1, F.col("x.route_id")).alias("route_id"))


def deployed(routes: DataFrame, roots: DataFrame) -> DataFrame:
    """routes (route_id, root, below) whose root is published with exactly one path get it before their own; others say why not."""
    paths = roots.groupBy("root").agg(F.count_distinct("path").alias("n"), F.min("path").alias("owner"))
    met = routes.join(paths, "root", "left")
    outcome = F.when(F.col("root").isNull(), "not rooted").when(F.col("n").isNull(), "not-found").when(F.col("n") > 1, "ambiguous").otherwise("linked")
    return met.select("route_id", outcome.alias("outcome"), F.when(F.col("n") == 1, normalise_path(F.concat_ws("/", "owner", "below"))).alias("path"))


def completed_from_environment(reads: DataFrame, reach: DataFrame, variables: DataFrame) -> DataFrame:
    """reads (node, service, variable), reach (entry, node), variables (entry, variable, value): values that a node's reads have.

    A node is run by the entries that reach it; where these agree on a variable's value it is that value, else unsettled.
    """
    ran = reads.join(reach, "node").join(variables, ["entry", "variable"])
    got = ran.groupBy("node", "variable").agg(F.count_distinct("value").alias("values"), F.min("value").alias("value"))
    out = reads.select("node", "variable").distinct().join(got, ["node", "variable"], "left")
    state = F.when(F.col("values").isNull(), "not set").when(F.col("values") > 1, "unsettled").otherwise("set")
    return out.select("node", "variable", state.alias("state"), F.when(F.col("values") == 1, F.col("value")).alias("value"))


def function_urls(reads: DataFrame, urls: DataFrame, entries: DataFrame) -> DataFrame:
    """reads (node, variable), urls (variable, function), entries (function, entry): (node, entry) by the function that a variable's
    URL belongs to; several functions are several edges.

    Nodes that read the same variables have the same entries, so these are settled once for each different set of variables, and a
    node meets no entry twice: what is joined with the nodes has no more rows than the result. Nulls meet nothing.
    """
    ways = urls.join(entries.dropDuplicates(["function", "entry"]), "function").select("variable", "entry").distinct()
    ways = materialise(ways, "url-ways")
    known = reads.join(sized(ways.select("variable").distinct(), ways.count(), 64), "variable", "left_semi")
    sets = materialise(known.groupBy("node").agg(F.sort_array(F.collect_set("variable")).alias("variables")), "url-reads")
    different = sets.select("variables").distinct()
    settled = materialise(different.select("variables", F.explode("variables").alias("variable")).join(ways, "variable").select("variables", "entry").distinct(), "url-sets")
    return sets.join(sized(settled, settled.count(), 256), "variables").select("node", "entry")
