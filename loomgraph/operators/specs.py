"""Two revisions of API documents compared operation by operation: changes by kind, at the level that their callers give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# The kinds of change by level.
ERRORS = (
    "endpoint-removed", "method-removed", "path-param-added", "request-property-became-required", "request-property-added-required", "request-property-type-changed",
    "response-property-removed", "response-property-type-changed", "response-property-became-optional", "response-status-removed", "channel-removed",
    "message-property-removed", "message-property-type-changed", "message-property-became-optional",
)
WARNINGS = ("request-property-removed", "response-status-added", "security-added", "channel-consumer-removed")
INFOS = ("endpoint-added", "optional-property-added", "description-changed")

OP = ["document", "kind", "op"]


def _gaps(path: Column) -> Column:
    """How many parameters stand before, between and after the literal segments, as strings of that length."""
    return F.split(F.array_join(F.transform(S.segments(path), lambda x: F.when(x == S.PARAM, "p").otherwise("/")), ""), "/")


def _literals(path: Column) -> Column:
    return F.array_join(F.filter(S.segments(path), lambda x: x != S.PARAM), "/")


def pair_operations(base: DataFrame, head: DataFrame) -> DataFrame:
    """(document, kind, op, other, how): operations of both sides; how is same, moved (the head's path has more parameters, or
    a channel's end another key), removed or added.

    base, head: document, kind http|send|receive, op, method, path, channel. Routes meet by verb and path, channel ends by key;
    what is left meets by literal segments or by channel, where just one head operation fits and no earlier one takes it.
    """
    http = F.col("kind") == "http"
    identity = F.when(http, F.concat_ws(":", "method", "path")).otherwise(F.col("op"))
    b, h = (x.withColumn("identity", identity).withColumn("near", F.when(http, F.concat_ws(":", "method", _literals(F.col("path")))).otherwise(F.col("channel"))) for x in (base, head))
    on = ["document", "kind", "identity"]
    same = b.select(*OP, "identity").join(h.select(*on, F.col("op").alias("other")), on).select(*OP, "other", F.lit("same").alias("how"))
    left_b, left_h = b.join(h, on, "left_anti"), h.join(b, on, "left_anti")
    x = left_b.select(*OP, "near", _gaps(F.col("path")).alias("gb")).join(left_h.select("document", "kind", "near", F.col("op").alias("other"), _gaps(F.col("path")).alias("gh")), ["document", "kind", "near"])
    more = F.forall(F.zip_with("gb", "gh", lambda p, q: F.length(p) <= F.length(q)), lambda t: t) & (F.col("gb") != F.col("gh"))
    x = x.filter(~http | more).groupBy(*OP).agg(F.count("*").alias("n"), F.min("other").alias("other")).filter("n = 1")
    moved = x.groupBy("document", "kind", "other").agg(F.min("op").alias("op")).select(*OP, "other", F.lit("moved").alias("how"))
    removed = left_b.join(moved, OP, "left_anti").select(*OP, F.lit(None).cast("string").alias("other"), F.lit("removed").alias("how"))
    taken = moved.select("document", "kind", F.col("other").alias("op"))
    added = left_h.join(taken, OP, "left_anti").select(*OP, F.lit(None).cast("string").alias("other"), F.lit("added").alias("how"))
    return same.unionByName(moved).unionByName(removed).unionByName(added)


def spec_changes(base: DataFrame, head: DataFrame, base_parts: DataFrame, head_parts: DataFrame) -> DataFrame:
    """(document, kind, op, field, change, level, uncalled).

    base, head as in pair_operations, base with callers (long) and public (boolean). Parts: document, kind, op, part, status,
    field, type, optional: part is request, response (with its status), message, success or failure (field is the status; type
    what it is answered for) or guard. A breaking change of an operation that nobody calls and nothing marks public is a
    warning. Every step is a join or a grouping by operation.
    """
    pairs = pair_operations(base, head)
    http = F.col("kind") == "http"
    routes = head.filter(http).select("document", "path").distinct().withColumn("stays", F.lit(True))
    gone = pairs.filter("how = 'removed'").join(base.select(*OP, "path"), OP).join(routes, ["document", "path"], "left")
    said = F.when(F.col("kind") == "send", "channel-removed").when(F.col("kind") == "receive", "channel-consumer-removed").when(F.col("stays"), "method-removed").otherwise("endpoint-removed")
    none = F.lit(None).cast("string").alias("field")
    whole = gone.select(*OP, none, said.alias("change"))
    whole = whole.unionByName(pairs.filter("how = 'added'").select(*OP, none, F.lit("endpoint-added").alias("change")))
    whole = whole.unionByName(pairs.filter((F.col("how") == "moved") & http).select(*OP, none, F.lit("path-param-added").alias("change")))

    met = pairs.filter((F.col("how") == "same") | ((F.col("how") == "moved") & ~http)).filter("kind <> 'receive'").select(*OP, "other")
    key = [*OP, "part", "status", "field"]
    full = F.coalesce("status", F.lit("")).alias("status")
    b = base_parts.join(met.select(*OP), OP).select(*OP, "part", full, "field", F.col("type").alias("bt"), F.col("optional").alias("bo"), F.lit(True).alias("b"))
    h = head_parts.join(met.select("document", "kind", F.col("other").alias("op"), F.col("op").alias("own")), OP)
    h = h.select("document", "kind", F.col("own").alias("op"), "part", full, "field", F.col("type").alias("ht"), F.col("optional").alias("ho"), F.lit(True).alias("h"))
    x = b.join(h, key, "full")
    # a payload, an answer of one status: compared where both sides have it
    has = x.filter("part in ('success', 'message')").groupBy(*OP, "part", F.when(F.col("part") == "success", F.col("field")).otherwise("").alias("status"))
    has = has.agg(F.max("b").alias("hb"), F.max("h").alias("hh")).filter("hb and hh").select(*OP, F.when(F.col("part") == "success", "response").otherwise("message").alias("part"), "status").withColumn("both", F.lit(True))
    x = x.join(has, [*OP, "part", "status"], "left").filter("part not in ('response', 'message') or both")
    new, old = F.col("b").isNull(), F.col("h").isNull()
    part, stays = F.col("part"), F.col("b").isNotNull() & F.col("h").isNotNull()
    request, answer = part == "request", part.isin("response", "message")
    typed = stays & ~F.col("bt").eqNullSafe(F.col("ht"))
    kinds = F.array(
        F.when((request | answer) & new & F.col("ho"), "optional-property-added"),
        F.when(request & new & ~F.col("ho"), "request-property-added-required"),
        F.when(request & old, "request-property-removed"),
        F.when(request & stays & F.col("bo") & ~F.col("ho"), "request-property-became-required"),
        F.when(answer & old, F.concat(part, F.lit("-property-removed"))),
        F.when(answer & stays & ~F.col("bo") & F.col("ho"), F.concat(part, F.lit("-property-became-optional"))),
        F.when((request | answer) & typed, F.concat(part, F.lit("-property-type-changed"))),
        F.when((part == "success") & old, "response-status-removed"),
        F.when((part == "failure") & new, "response-status-added"),
        F.when((part == "failure") & typed, "description-changed"),
        F.when((part == "guard") & new, "security-added"),
    )
    named = F.when(part == "guard", "guards").when(part.isin("success", "failure"), F.concat(F.lit("status "), "field")).otherwise(F.col("field"))
    fields = x.select(*OP, named.alias("field"), F.explode(F.array_compact(kinds)).alias("change")).distinct()
    every = whole.unionByName(fields).join(base.select(*OP, "callers", "public"), OP, "left")
    error = F.col("change").isin(*ERRORS)
    uncalled = error & (F.coalesce("callers", F.lit(0)) == 0) & ~F.coalesce("public", F.lit(False))
    level = F.when(error & ~uncalled, "error").when(error | F.col("change").isin(*WARNINGS), "warning").otherwise("info")
    return every.select(*OP, "field", "change", level.alias("level"), uncalled.alias("uncalled"))
