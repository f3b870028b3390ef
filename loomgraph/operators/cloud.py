"""Calls of cloud services in the tree of their trace: where each one ran, what it names, and which join of the graph it was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import join_id
from ..store import materialise, sized
from .traverse import reach_all

# The service in the ARN of each kind of deployed thing, and what stands there before its name.
ARNS = {
    "function": ("lambda", "function:"), "workflow": ("states", "stateMachine:"), "queue": ("sqs", ""), "topic": ("sns", ""),
    "bus": ("events", "event-bus/"), "table": ("dynamodb", "table/"), "stream": ("kinesis", "stream/"), "bucket": ("s3", ""),
}
# Each service whose calls are followed, what its calls look up, how its channels start, the kind of name that it
# takes, and the operations that send, write or start something.
CALLS = (
    ("DynamoDB", "table", "dynamodb", "table", ("PutItem", "UpdateItem", "DeleteItem", "BatchWriteItem", "TransactWriteItems")),
    ("SQS", "channel", "sqs", "queue", ("SendMessage", "SendMessageBatch")),
    ("SNS", "channel", "sns", "topic", ("Publish", "PublishBatch")),
    ("EventBridge", "channel", "eventbridge", "bus", ("PutEvents",)),
    ("Kinesis", "channel", "kinesis", "stream", ("PutRecord", "PutRecords")),
    ("S3", "channel", "s3", "bucket", ("PutObject", "CopyObject", "CompleteMultipartUpload", "DeleteObject", "DeleteObjects")),
    ("Lambda", "invoke", None, "function", ("Invoke", "InvokeAsync")),
    ("SFN", "workflow", None, "workflow", ("StartExecution", "StartSyncExecution")),
)
JOIN_TYPES = ("http_calls", "hits", "emits", "consumes", "triggers")
ENTRY_KINDS = ("invoke", "workflow")
BUS, DEFAULT_BUS = "eventbridge", "default"


def deployed_name(kind: str, text: Column) -> Column:
    """The name of a deployed thing of that kind in an ARN, a queue's address or a bare name; null for any other text.

    A version or alias of a function or workflow is no part of its name, an execution names its workflow, and a table's stream its table.
    """
    service, lead = ARNS[kind]
    p = F.split(text, ":", 6)
    part = lambda a, i: F.get(a, F.lit(i))
    arn = (F.size(p) == 6) & (part(p, 0) == "arn") & (part(p, 1) != "") & (part(p, 2) == service)
    if kind == "bucket":
        arn = arn & (part(p, 3) == "") & (part(p, 4) == "")
    rest = F.when(arn, part(p, 5))
    own = F.when(rest.startswith(lead) & (F.length(rest) > len(lead)), F.substring(rest, len(lead) + 1, 1 << 30))
    if kind in ("function", "workflow"):
        q = F.split(own, ":")
        name = F.when((F.size(q) <= 2) & F.forall(q, lambda x: x != ""), part(q, 0))
        if kind == "workflow":
            run = F.split(rest, ":")
            ran = part(run, 0).isin("execution", "express") & F.size(run).between(3, 4) & F.forall(run, lambda x: x != "")
            name = F.coalesce(name, F.when(ran, part(run, 1)))
    elif kind == "bus":
        name = own
    elif kind == "table":
        q = F.split(own, "/", 3)
        name = F.when(((F.size(q) == 1) | ((F.size(q) == 3) & (part(q, 1) == "stream") & (part(q, 2) != ""))) & (part(q, 0) != ""), part(q, 0))
    elif kind == "stream":
        name = F.when(~F.contains(own, F.lit("/")), own)
    else:
        name = F.when(~own.rlike("[:/]"), own)
    if kind == "queue":
        u = F.split(F.regexp_replace(text, "/$", ""), "/")
        address = part(u, 0).isin("http:", "https:") & (F.size(u) == 5) & (part(u, 1) == "") & (part(u, 2) != "") & (part(u, 3) != "") & ~text.rlike("[?#]")
        name = F.coalesce(name, F.when(address & (part(u, 4) != ""), part(u, 4)))
    bare = F.when((text != "") & ~text.rlike("[:/]"), text)
    if kind == "function":  # what a call takes as a function's name may be shorter still
        s = F.split(text, ":")
        full = F.forall(s, lambda x: x != "")
        short = F.when(F.size(s).between(2, 3) & full & (part(s, 0) == "function"), part(s, 1)).when(F.size(s).between(3, 4) & full & (part(s, 1) == "function"), part(s, 2)).when((F.size(s) == 2) & full, part(s, 0))
        bare = F.coalesce(bare, short)
    return F.coalesce(name, bare)


def nearest(spans: DataFrame, **marks: Column) -> DataFrame:
    """(trace_id, span_id, a column for each mark): the nearest span above each one for which the mark holds, null if there is none.

    A span points to the first one above it and takes over, round by round, where that one points to, until it has met a marked
    span or a root: a chain of n spans takes about log2(n) rounds, all marks share them, and a round is one join by span. Rows
    of one span count as one, with its least parent and marked if any of them is; spans without an id are left out. One that is its
    own parent is a root; in a ring of parents a span finds the next marked one of the ring, or none.
    """
    held = [F.max(F.coalesce(c, F.lit(False))).alias(f"_m{i}") for i, c in enumerate(marks.values())]
    one = spans.filter("trace_id is not null and span_id is not null").groupBy("trace_id", "span_id").agg(F.min(F.when(F.col("parent_id") != F.col("span_id"), F.col("parent_id"))).alias("parent_id"), *held)
    rows = one.select("trace_id", "span_id", "parent_id", F.inline(F.array(*[F.struct(F.lit(i).alias("what"), F.col(f"_m{i}").alias("held")) for i in range(len(marks))])))
    above = rows.select("what", "trace_id", F.col("span_id").alias("parent_id"), F.col("held").alias("up"))
    start = rows.join(above.hint("merge"), ["what", "trace_id", "parent_id"], "left")
    now = materialise(start.select("what", "trace_id", "span_id", F.when(F.col("up").isNotNull(), F.col("parent_id")).alias("at"), F.coalesce("up", F.lit(True)).alias("done")), "nearest")
    left, before = now.filter("not done").count(), -1
    while left and left != before:  # a round that settles no span leaves rings alone
        top = now.select("what", "trace_id", F.col("span_id").alias("at"), F.col("at").alias("next"), F.col("done").alias("end"))
        moved = now.filter("not done").join(top.hint("merge"), ["what", "trace_id", "at"]).select("what", "trace_id", "span_id", F.col("next").alias("at"), F.col("end").alias("done"))
        now = materialise(now.filter("done").unionByName(moved), "nearest")
        left, before = now.filter("not done").count(), left
    met = now.filter("done")
    return met.groupBy("trace_id", "span_id").agg(*[F.max(F.when(F.col("what") == i, F.col("at"))).alias(name) for i, name in enumerate(marks)])


def _services(nodes: DataFrame) -> DataFrame:
    return nodes.filter("service is not null").select("service").distinct()


def _states(nodes: DataFrame) -> DataFrame:
    return nodes.filter("type = 'function' and kind = 'state'").select(F.col("id").alias("state"), F.col("label").alias("step_name"), F.col("service").alias("state_service"))


def _steps_on_map(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """(trace_id, span_id, step): spans that are a step of the graph; of several of one name, the one of the span's service."""
    asked = spans.filter("workflow is not null and state is not null").select("trace_id", "span_id", "own", F.concat_ws("/", "workflow", "state").alias("step_name"))
    kinds = asked.select("own", "step_name").distinct().join(_states(nodes), "step_name").filter("own is null or own = state_service")
    one = kinds.groupBy("step_name", F.coalesce("own", F.lit("")).alias("_own")).agg(F.count_distinct("state").alias("n"), F.min("state").alias("step")).filter("n = 1")
    return asked.withColumn("_own", F.coalesce("own", F.lit(""))).join(one, ["step_name", "_own"]).groupBy("trace_id", "span_id").agg(F.min("step").alias("step"))


def function_scopes(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """(scope, node): what the code of functions (name) reaches from its handlers by calls, not into another way in or a step."""
    entries = nodes.filter("type = 'entry' and kind = 'invoke'").select(F.col("id").alias("from_id"), F.col("label").alias("name")).join(names, "name", "left_semi")
    seeds = entries.join(edges.filter("type = 'handles'"), "from_id").select(F.concat(F.lit("function:"), "name").alias("scope"), F.col("to_id").alias("id"))
    outside = nodes.filter("type = 'entry' or (type = 'function' and kind = 'state')").select(F.col("id").alias("to_id"))
    calls = edges.filter("type = 'calls'").join(outside, "to_id", "left_anti")
    return reach_all(calls, seeds, by="scope").select("scope", F.col("id").alias("node"))


def step_scopes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope, node): a step of a workflow and what its task calls; the next step is no part of it."""
    states = _states(nodes).select(F.col("state").alias("from_id"))
    called = edges.filter("type = 'calls'").join(states, "from_id", "left_semi").join(states.withColumnRenamed("from_id", "to_id"), "to_id", "left_anti")
    both = states.select(F.col("from_id").alias("a"), F.col("from_id").alias("node")).unionByName(called.select(F.col("from_id").alias("a"), F.col("to_id").alias("node")))
    return both.select(F.concat(F.lit("step:"), "a").alias("scope"), "node").distinct()


def call_sites(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """(trace_id, span_id, own, api, operation, targets, scope, step, within): calls of cloud services, and where they ran.

    scope is the step or the function nearest above (a span of a function counts if it took a request or a message), else the
    function that the call itself names; within is the call of the same service and operation that this one is a part of: the
    nearest of all calls and of all spans that took something, if it is such a call.
    """
    known = _services(nodes).select("service", F.col("service").alias("own"))
    own = spans.join(sized(known, known.count(), 256), "service", "left")
    own = materialise(own.select("trace_id", "span_id", "parent_id", "kind", "own", "faas", "workflow", "state", "api", "operation", "targets"), "cloud-spans")
    steps = _steps_on_map(own, nodes)
    marked = materialise(own.join(steps.hint("merge"), ["trace_id", "span_id"], "left"), "cloud-marked")
    call = F.col("api").isNotNull() & F.col("operation").isNotNull()
    takes = F.coalesce(F.col("kind").isin("server", "consumer"), F.lit(False))
    runs = F.col("step").isNotNull() | (takes & F.col("faas").isNotNull())
    up = nearest(marked, at=runs, above=F.col("step").isNotNull(), outer=call | takes)
    of = lambda key, *c: marked.groupBy("trace_id", F.col("span_id").alias(key)).agg(*c)
    where = of("at", F.min(F.coalesce(F.concat(F.lit("step:"), "step"), F.concat(F.lit("function:"), "faas"))).alias("ran"))
    steps_above = steps.select("trace_id", F.col("span_id").alias("above"), F.col("step").alias("by_step"))
    outer = of("outer", F.min(F.when(call, F.struct("api", "operation"))).alias("outer_call"))
    # merged, as these tables are as long as the spans, however small their files are
    found = own.filter(call).join(up.hint("merge"), ["trace_id", "span_id"], "left").join(where.hint("merge"), ["trace_id", "at"], "left")
    found = found.join(steps_above.hint("merge"), ["trace_id", "above"], "left").join(outer.hint("merge"), ["trace_id", "outer"], "left")
    part = (F.col("outer_call.api") == F.col("api")) & (F.col("outer_call.operation") == F.col("operation"))
    return found.select(
        "trace_id", "span_id", "own", "api", "operation", "targets", F.coalesce("ran", F.concat(F.lit("function:"), "faas")).alias("scope"),
        F.col("by_step").alias("step"), F.when(part, F.col("outer")).alias("within"),
    )


def _reached_by_step(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(step, lookup, label): the one target of a kind that a step's own task reaches."""
    scope = step_scopes(nodes, edges).select(F.substring("scope", 6, 1 << 30).alias("step"), F.col("node").alias("from_id"))
    to = nodes.select(F.col("id").alias("to_id"), F.col("type").alias("to_type"), F.col("kind").alias("to_kind"), "label")
    out = scope.join(edges, "from_id").join(to, "to_id")
    lookup = F.when((F.col("type") == "queries") & (F.col("to_type") == "table"), "table").when((F.col("type") == "emits") & (F.col("to_type") == "channel"), "channel")
    lookup = F.coalesce(lookup, F.when((F.col("type") == "calls") & (F.col("step") == F.col("from_id")) & (F.col("to_type") == "entry") & F.col("to_kind").isin(*ENTRY_KINDS), F.col("to_kind")))
    found = out.select("step", lookup.alias("lookup"), "to_id", "label").filter("lookup is not null")
    return found.groupBy("step", "lookup").agg(F.count_distinct("to_id").alias("n"), F.min("label").alias("step_label")).filter("n = 1").drop("n")


def _requests(calls: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each different request once, by its key q: what it looks up, whether it sends, the name or label that it has or its step gives it."""
    table = calls.sparkSession.createDataFrame(CALLS, "api string, lookup string, transport string, named string, sending array<string>")
    asked = calls.select("q", "own", "scope", "step", "api", "operation", "target").dropDuplicates(["q"]).join(F.broadcast(table), "api", "left")  # a row a service
    name = F.coalesce(*[F.when(F.col("named") == kind, deployed_name(kind, F.col("target"))) for kind in ARNS])
    name = F.when(F.col("named") == "bus", F.coalesce(name, F.lit(DEFAULT_BUS))).otherwise(name)
    asked = asked.withColumn("name", name).withColumn("sends", F.coalesce(F.array_contains("sending", F.col("operation")), F.lit(False)))
    may = F.col("sends") | (F.col("lookup") == "table")
    asked = asked.join(_reached_by_step(nodes, edges), ["step", "lookup"], "left").withColumn("step_label", F.when(F.col("name").isNull() & may, F.col("step_label")))
    channel = F.when(F.col("name").isNull(), F.col("step_label")).when((F.col("transport") != BUS), F.concat_ws("/", "transport", "name"))
    return asked.select(
        "q", "own", "scope", "api", "lookup", "transport", "sends", F.coalesce("name", "step_label").alias("name"),
        F.when(F.col("lookup") == "channel", channel).when(F.col("lookup") == "table", F.concat(F.lit("dynamodb/"), F.coalesce("name", "step_label"))).alias("channel"),
        F.when((F.col("lookup") == "channel") & (F.col("transport") == BUS) & F.col("name").isNotNull(), F.concat(F.lit(BUS + "/"), "name", F.lit("/"))).alias("bus"),
    )


def _from_caller(found: DataFrame, scopes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of found (q, own, scope, from_id, ...) the edges that leave the caller's scope, if the graph says what that holds, else its service."""
    filled = scopes.select("scope").distinct().withColumn("filled", F.lit(True))
    inside = scopes.select("scope", F.col("node").alias("from_id"), F.lit(True).alias("inside"))
    source = nodes.select(F.col("id").alias("from_id"), F.lit(True).alias("there"), F.col("service").alias("from_service"))
    x = found.join(filled, "scope", "left").join(inside.hint("merge"), ["scope", "from_id"], "left").join(source.hint("merge"), "from_id", "left")
    own = F.col("there").isNotNull() & (F.col("own").isNull() | F.coalesce(F.col("own") == F.col("from_service"), F.lit(False)))
    return x.filter(F.when(F.col("filled"), F.col("inside").isNotNull()).otherwise(own)).drop("filled", "inside", "there", "from_service")


def match_calls(spans: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(trace_id, span_id, target, outcome, node, site, join_outcome, join, within): each call of a cloud service by what it names.

    spans: trace_id, span_id, parent_id, kind, service, faas, workflow, state, api, operation, targets (array of names as written);
    nodes: id, type, kind, label, service; edges: from_id, to_id, type. A step's node has the label workflow/step.

    outcome: match, ambiguous, not-found, unknown call, unnamed (nor does the step above reach just one such target) or not counted
    (nothing is sent and no table read; a bucket that nobody is told of; a read of a table known as a stream only). node is the table,
    channel or way in; site the one place in the caller's scope that queries the table or starts the way in. join_outcome is
    match, ambiguous or no join (the target is on the map and no way there from the caller), for calls that send or start. A call
    is made from its scope if the graph says what this holds, else from any node of its service; nothing is ever picked among several.

    Calls are folded to different requests before they meet the graph, so hot calls cost no more than rare ones. Rows with a null in
    trace_id or span_id are left out, nulls elsewhere are values not told; repeated rows answer alike; a node's or edge's repeated
    rows are one (of rows that differ, each column's least value).
    """
    nodes = nodes.filter("id is not null").groupBy("id").agg(*[F.min(c).alias(c) for c in ("type", "kind", "label", "service")])
    nodes = materialise(nodes, "cloud-nodes")  # the graph is asked a dozen times
    edges = materialise(edges.filter("from_id is not null and to_id is not null").select("from_id", "to_id", "type").distinct(), "cloud-edges")
    sited = call_sites(spans, nodes).filter("trace_id is not null and span_id is not null")
    calls = sited.withColumn("target", F.explode_outer(F.array_distinct("targets"))).drop("targets")
    calls = materialise(calls.withColumn("q", F.to_json(F.struct("own", "scope", "step", "api", "operation", "target"))), "cloud-calls")
    req = materialise(_requests(calls, nodes, edges), "cloud-requests")
    named = req.filter("scope like 'function:%'").select(F.substring("scope", 10, 1 << 30).alias("name")).distinct()
    scopes = materialise(function_scopes(nodes, edges, named).unionByName(step_scopes(nodes, edges)), "cloud-scopes")

    fits = F.col("own").isNull() | F.coalesce(F.col("own") == F.col("service"), F.lit(False))
    tables = nodes.filter("type = 'table'").select(F.col("id").alias("node"), F.lower("label").alias("low"), "service")
    of_table = req.filter("lookup = 'table' and name is not null").withColumn("low", F.lower("name")).join(tables, "low").filter(fits)
    table = of_table.groupBy("q").agg(F.count_distinct("node").alias("tables"), F.min("node").alias("table"))
    one = table.filter("tables = 1").join(req.select("q", "own", "scope"), "q").withColumnRenamed("table", "to_id")
    queries = _from_caller(one.join(edges.filter("type = 'queries'").select("from_id", "to_id"), "to_id"), scopes, nodes)
    site = queries.groupBy("q").agg(F.count_distinct("from_id").alias("k"), F.min("from_id").alias("query_site")).filter("k = 1").drop("k")

    channels = nodes.filter("type = 'channel'").groupBy("label").agg(F.min("id").alias("channel_id"))
    emits = edges.filter("type = 'emits'").select("from_id", F.col("to_id").alias("channel_id"))
    by_label = req.filter("channel is not null").select("q", F.col("channel").alias("label")).join(channels, "label").select("q", "channel_id", F.lit(1).alias("channels"))
    parts = F.split("label", "/")
    fronts = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    on_bus = channels.filter(F.col("label").startswith(BUS + "/") & (F.size(parts) > 2)).select("channel_id", F.explode(fronts).alias("bus"))
    met = req.filter("bus is not null and sends").select("q", "scope", "bus").join(on_bus, "bus")
    heard = emits.join(scopes.select("scope", F.col("node").alias("from_id")), "from_id").select("scope", "channel_id", F.lit(True).alias("heard")).distinct()
    told = met.join(heard, ["scope", "channel_id"], "left").groupBy("q").agg(
        F.count("*").alias("channels"), F.count("heard").alias("own_channels"), F.min("channel_id").alias("any"), F.min(F.when(F.col("heard"), F.col("channel_id"))).alias("mine")
    )
    of_bus = told.select("q", F.when(F.col("own_channels") == 1, F.col("mine")).when(F.col("channels") == 1, F.col("any")).alias("channel_id"), F.when(F.col("own_channels") == 1, 1).otherwise(F.col("channels")).cast("int").alias("channels"))
    channel = materialise(by_label.unionByName(of_bus), "cloud-channels")

    ways = nodes.filter("type = 'entry'").filter(F.col("kind").isin(*ENTRY_KINDS)).select(F.col("id").alias("to_id"), F.col("kind").alias("lookup"), F.col("label").alias("name"))
    starts = req.filter("sends and lookup in ('invoke', 'workflow')").join(ways, ["lookup", "name"])
    entries = starts.groupBy("q").agg(F.count("*").alias("entries"))
    into = edges.filter(F.col("type").isin(*JOIN_TYPES, "calls"))
    sent = req.filter("sends").select("q", "own", "scope").join(channel, "q").filter("channel_id is not null")
    ends = sent.select("q", "own", "scope", F.col("channel_id").alias("to_id"), F.lit("emits").alias("wanted")).unionByName(starts.select("q", "own", "scope", "to_id", F.lit(None).cast("string").alias("wanted")))
    joins = _from_caller(ends.join(into, "to_id").filter("wanted is null or wanted = type"), scopes, nodes)
    join = joins.groupBy("q").agg(F.count_distinct("from_id", "type", "to_id").alias("joins"), F.min(F.struct("from_id", "type", "to_id")).alias("j"))

    states = _states(nodes).select(F.col("state").alias("from_state"))
    r = req.join(table, "q", "left").join(site, "q", "left").join(channel, "q", "left").join(entries, "q", "left").join(join, "q", "left")
    r = r.join(states, F.col("j.from_id") == F.col("from_state"), "left")
    lookup, sends = F.col("lookup"), F.col("sends")
    of_table = F.when(F.col("tables") > 1, "ambiguous").when(F.col("tables") == 1, "match").when(F.col("channel_id").isNull(), "not-found").when(sends, "match").otherwise("not counted")
    of_channel = F.when(~sends, "not counted").when(F.col("channel_id").isNotNull(), "match").when(F.col("channels") > 1, "ambiguous").when(F.col("transport") == "s3", "not counted").otherwise("not-found")
    of_start = F.when(~sends, "not counted").when(F.col("entries").isNull(), "not-found").otherwise("match")
    outcome = F.when(lookup.isNull(), "unknown call").when(F.col("name").isNull(), F.when(sends | (lookup == "table"), "unnamed").otherwise("not counted")).when(lookup == "table", of_table).when(lookup == "channel", of_channel).otherwise(of_start)
    lands = sends & (F.col("channel_id").isNotNull() | F.col("entries").isNotNull())
    join_outcome = F.when(lands, F.when(F.col("joins").isNull(), "no join").when(F.col("joins") > 1, "ambiguous").otherwise("match"))
    ran = F.col("joins") == 1
    start = lookup.isin(*ENTRY_KINDS)
    node = F.when(lookup == "table", F.when(F.col("tables") == 1, F.col("table")).when(F.col("tables").isNull() & sends, F.col("channel_id"))).when(lookup == "channel", F.when(sends, F.col("channel_id"))).when(ran, F.col("j.to_id"))
    answered = r.select(
        "q", outcome.alias("outcome"), node.alias("node"),
        F.when(lookup == "table", F.col("query_site")).when(start & ran & F.col("from_state").isNull(), F.col("j.from_id")).alias("site"),
        join_outcome.alias("join_outcome"), F.when(lands & ran, join_id(F.col("j.from_id"), F.col("j.type"), F.col("j.to_id"))).alias("join"),
    )
    return calls.join(answered, "q").select("trace_id", "span_id", "target", "outcome", "node", "site", "join_outcome", "join", "within")


def call_counts(matched: DataFrame) -> DataFrame:
    """(what node|site|join, id, count): what calls are credited to; the parts of one call count once, as the outermost."""
    own = matched.filter("within is null")
    rows = own.select(F.inline(F.array(*[F.struct(F.lit(w).alias("what"), F.col(w).alias("id")) for w in ("node", "site", "join")]))).filter("id is not null")
    return rows.groupBy("what", "id").agg(F.count("*").alias("count"))
