"""Where outgoing calls go: annotations, bindings, base variables, function addresses and found values, asked in that order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normalise_path, segments
from ..store import materialise
from .audit import choose_api
from .linking import routes_of, segment_answers

ASK = ["target", "method", "path"]


def route_answers(asks: DataFrame, routes: DataFrame) -> DataFrame:
    """asks (target, method, path) against routes (route_id, service, method, path, prefix, api): (target, method, path, route_id, api), a
    row for each route of that service that answers best: fewest wildcards, fewest parameters, most literals.

    What finds nothing is asked again under the prefix that the service puts before all its routes (the least, if there are several).
    Candidates share the service, the number of segments (a trailing "*" takes more) and the first one, or have a hole there.
    """
    r = routes_of(routes.select("route_id", "method", "path", F.col("service").alias("target"), "prefix", "api")).select("route_id", "target", F.upper("method").alias("rm"), "r", "tail", "n", "head", "wild", "params", "literals", "api")
    front = routes.filter("prefix is not null").groupBy(F.col("service").alias("target")).agg(F.min("prefix").alias("front"))
    one = asks.select(*ASK).dropDuplicates(ASK).filter("target is not null and path is not null").join(front, "target", "left")
    both = F.array(F.struct(F.lit(0).alias("turn"), F.col("path").alias("asked")), F.struct(F.lit(1).alias("turn"), normalise_path(F.concat(F.lit("/"), "front", F.lit("/"), "path")).alias("asked")))
    tried = one.select(*ASK, F.inline(both)).filter("asked is not null").withColumn("c", segments(F.col("asked"))).filter("size(c) > 0")
    tried = tried.withColumn("head", F.explode(F.array_distinct(F.array(F.lower(F.element_at("c", 1)), F.lit("*")))))
    keep = [*ASK, "turn", "c", "route_id", "rm", "r", "wild", "params", "literals", "api"]
    exact = tried.withColumn("n", F.size("c")).join(r.filter("not tail"), ["target", "n", "head"]).select(*keep)
    tails = tried.withColumn("n", F.explode(F.sequence(F.lit(1), F.size("c")))).join(r.filter("tail"), ["target", "n", "head"]).select(*keep)
    fits = F.forall(F.zip_with("r", F.slice("c", 1, F.size("r")), lambda x, y: segment_answers(x, y)), lambda ok: ok)
    hits = exact.unionByName(tails).filter(((F.col("rm") == F.upper("method")) | (F.col("rm") == "ALL")) & fits)
    w = Window.partitionBy(*ASK).orderBy("turn", "wild", "params", F.desc("literals"))
    return hits.withColumn("k", F.rank().over(w)).filter("k = 1").select(*ASK, "route_id", "api").distinct()


def outgoing_calls(calls: DataFrame, routes: DataFrame, markers: DataFrame, bindings: DataFrame, claims: DataFrame, values: DataFrame, urls: DataFrame) -> DataFrame:
    """(call_id, outcome, way, target, route_id, also): where each call goes, by the first rule that applies.

    calls: call_id, service, method (null: GET), unread (its verb can't be read), path, env, variable (from which env is made), host,
    binding, typed (false: only its shape says that it is one). routes: route_id, service, method, path, prefix, api. markers: call_id,
    ord, service, method, path. bindings: service, binding, target. claims: env, service. values: service, env, kind (external or
    service), target, start (path of the value). urls: call_id, entry.

    1. annotations: the first by ord that finds one route; `also` counts the further routes that others find;
    2. a binding: the one service that it is bound to, else unknownBinding (dynamic where it may be none at all);
    3. no base variable: external with a host, else dynamic;
    4. a function's own address, where nobody claims the variable;
    5. the variable's value, where nobody claims it: external, a service (its path before the call's, then the call's alone), or
       unknownEnv for values that differ;
    6. the one service that claims the variable, or what it is made from if nobody claims that; else unknownEnv.
    In a service: dynamic without a path or verb that was read in full, linked with one route, else ambiguous or noRoute. Of routes of
    several APIs, one whose name shares the most words with the setting is taken (way `apiName`), never any other.

    All rules' requests are folded and meet the routes in one join; a rule never looks at calls that an earlier one took. Rows without
    a call_id are left out, repeated calls answer once, and a table of rules may be empty.
    """
    c = calls.filter("call_id is not null").dropDuplicates(["call_id"])
    bound = bindings.groupBy("service", "binding").agg(F.count_distinct("target").alias("bound"), F.min("target").alias("bound_to"))
    claimed = claims.groupBy("env").agg(F.count_distinct("service").alias("n"), F.min("service").alias("by"))
    value = values.groupBy("service", "env").agg(F.count_distinct("kind", F.coalesce("target", F.lit("")), F.coalesce("start", F.lit(""))).alias("found"), F.min(F.struct("kind", "target", "start")).alias("v"))
    url = urls.filter("entry is not null").groupBy("call_id").agg(F.min("entry").alias("url"), (F.count_distinct("entry") - 1).alias("more_urls"))
    x = c.join(bound, ["service", "binding"], "left").join(claimed.select("env", F.col("n").alias("n_env"), F.col("by").alias("by_env")), "env", "left")
    x = x.join(claimed.select(F.col("env").alias("variable"), F.col("n").alias("n_var"), F.col("by").alias("by_var")), "variable", "left").join(value, ["service", "env"], "left").join(url, "call_id", "left")
    x = x.withColumn("claimants", F.coalesce("n_env", "n_var", F.lit(0))).withColumn("claimant", F.when(F.col("n_env").isNotNull(), F.col("by_env")).otherwise(F.col("by_var")))
    has_binding, has_env, free = F.col("binding").isNotNull(), F.col("env").isNotNull(), F.col("claimants") == 0
    valued = free & F.col("v").isNotNull() & (F.col("found") == 1)
    said = F.when(
        has_binding, F.when(F.col("bound") == 1, "ask").when(F.col("bound").isNull() & ~F.coalesce("typed", F.lit(True)), "dynamic").otherwise("unknownBinding")
    ).when(~has_env, F.when(F.col("host").isNotNull(), "external").otherwise("dynamic")).when(free & F.col("url").isNotNull(), "linked").when(valued & (F.col("v.kind") == "external"), "external").when(valued | (F.col("claimants") == 1), "ask").otherwise("unknownEnv")
    way = F.when(has_binding, "binding").when(free & F.col("url").isNotNull(), "functionUrl").when(valued, "value").otherwise("env")
    target = F.when(has_binding, F.col("bound_to")).when(valued, F.col("v.target")).otherwise(F.col("claimant"))
    read = F.col("path").isNotNull() & (F.col("path") != "") & ~F.contains("path", F.lit("${")) & ~F.coalesce("unread", F.lit(False))
    x = x.withColumn("said", said).withColumn("way", way).withColumn("goes", F.when(F.col("said") == "ask", target)).withColumn("read", read)
    start = F.when((F.col("way") == "value") & ~F.coalesce("v.start", F.lit("")).isin("", "/"), F.col("v.start"))
    x = materialise(x.select("call_id", "env", F.coalesce("method", F.lit("GET")).alias("method"), "path", "said", "way", "goes", "read", "url", "more_urls", start.alias("start")), "outgoing")

    own = x.filter("goes is not null and read")
    whole = own.filter("start is not null").select("call_id", F.lit(1).alias("stage"), F.lit(0).cast("long").alias("ord"), F.col("goes").alias("target"), "method", normalise_path(F.concat("start", F.lit("/"), "path")).alias("path"), F.coalesce("env", "goes").alias("setting"))
    plain = own.select("call_id", F.lit(2).alias("stage"), F.lit(0).cast("long").alias("ord"), F.col("goes").alias("target"), "method", "path", F.coalesce("env", "goes").alias("setting"))
    marked = markers.join(x.select("call_id", "env"), "call_id").select("call_id", F.lit(0).alias("stage"), F.col("ord").cast("long").alias("ord"), F.col("service").alias("target"), F.coalesce("method", F.lit("GET")).alias("method"), "path", F.coalesce("env", "service").alias("setting"))
    asks = materialise(marked.unionByName(whole).unionByName(plain).distinct(), "outgoing-asks")
    best = materialise(route_answers(asks, routes), "outgoing-answers")
    answers = best.groupBy(*ASK).agg(F.count_distinct("route_id").alias("n"), F.min("route_id").alias("route_id"))
    several = asks.select(*ASK, "setting").distinct().join(answers.filter("n > 1").select(*ASK), ASK)
    key = F.to_json(F.struct(*ASK, "setting"))
    chosen = choose_api(several.join(best, ASK).select(key.alias("call"), "setting", "api", F.col("route_id").alias("entry"))).filter("outcome = 'one'").select(F.col("call").alias("key"), F.col("entry").alias("chosen"))
    r = asks.join(answers, ASK, "left").withColumn("key", key).join(chosen, "key", "left")
    state = F.when((F.col("n") == 1) | F.col("chosen").isNotNull(), "linked").when(F.col("n") > 1, "ambiguous").otherwise("noRoute")
    got = F.struct(F.col("stage"), F.col("ord"), state.alias("state"), F.when(F.col("n") == 1, F.col("route_id")).otherwise(F.col("chosen")).alias("route_id"), "target", F.col("chosen").isNotNull().alias("guessed"))
    r = r.select("call_id", got.alias("g"))
    linked = F.col("g.state") == "linked"
    by = r.groupBy("call_id").agg(
        F.min(F.when((F.col("g.stage") == 0) & linked, F.col("g"))).alias("mark"), F.count_if((F.col("g.stage") == 0) & linked).alias("marks"),
        F.min(F.when((F.col("g.stage") > 0) & linked, F.col("g"))).alias("hit"), F.min(F.when(F.col("g.stage") > 0, F.col("g"))).alias("asked"),
    )
    out = x.join(by, "call_id", "left")
    by_mark = F.col("mark").isNotNull()
    took = F.when(by_mark, F.col("mark")).otherwise(F.coalesce("hit", "asked"))
    out = out.withColumn("took", took)
    way = F.when(F.col("took.guessed"), "apiName").when(by_mark, "marker").otherwise(F.col("way"))
    outcome = F.when(by_mark, "linked").when(F.col("said") != "ask", F.col("said")).when(~F.col("read"), "dynamic").otherwise(F.coalesce("took.state", F.lit("noRoute")))
    done = out.withColumn("outcome", outcome)
    is_url = ~by_mark & (F.col("said") == "linked")
    return done.select(
        "call_id", "outcome", F.when(F.col("outcome") == "linked", way).alias("way"), F.when(by_mark, F.col("mark.target")).otherwise(F.col("goes")).alias("target"),
        F.when(is_url, F.col("url")).when((F.col("outcome") == "linked"), F.col("took.route_id")).alias("route_id"),
        F.when(by_mark, F.col("marks") - 1).when(is_url, F.col("more_urls")).otherwise(0).alias("also"),
    )
