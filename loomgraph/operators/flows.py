"""Flow trees of many entries at once, the sequences of steps that they are, and which flows changed between two versions.

A tree grows level by level, all entries in one table. A node has its own row where an entry first reaches it (the least level, then
the first in reading order) and is expanded there; elsewhere its row is a mark: "cycle" on its own way, else "again". So a tree has a
row for each edge out of what it reaches, and none is lost: what a bound leaves out is told by "cut" at the row it hangs under. A
row's place in its tree is the array of keys of the steps to it, which sort in reading order; sorting by ranges puts all trees in
order without a walk.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import importable, materialise
from . import diff as D
from . import orders as O
from .traverse import blast_radius

# Edges that leave a body, what a call is written at, who calls each kind of entry.
CROSSING = ("http_calls", "hits", "emits", "consumes", "queries", "caches", "triggers")
CALL_SITES = ("http_out", "producer", "db_query", "cache_op", "ui_api_call")
CALLERS = {"http": "client", "rpc": "client", "bot_command": "user", "bot_callback": "user", "bot_event": "user", "scene_step": "user", "event": "broker", "cron": "scheduler"}

KEY = "struct<inner:boolean,ordered:boolean,order:long,line:long,type:string,to:string>"


def _col(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _node(nodes: DataFrame, p: str) -> DataFrame:
    return nodes.select(F.col("id").alias(p), F.col("service").alias(f"{p}_service"), _col(nodes, "type", "string").alias(f"{p}_type"), _col(nodes, "label", "string").alias(f"{p}_label"))


def participant(kind: Column, type_: Column, label: Column, service: Column) -> Column:
    """Where a step of that kind lands: a channel, a table or store of a service, something outside, or a service."""
    body = F.coalesce(service, label)
    channel = F.concat(F.lit("channel:"), label)
    store = F.concat(F.when(type_ == "table", "table:").otherwise("store:"), F.coalesce(service, F.lit("")), F.lit("/"), label)
    target = F.when(type_ == "channel", channel).when(type_ == "table", store).when(type_ == "external_api", F.concat(F.lit("external:"), label)).otherwise(body)
    return F.when(kind == "emits", channel).when(kind.isin("queries", "caches"), store).when(kind.isin("http_calls", "hits", "triggers"), target).otherwise(body)


def steps_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, type, key, p, label, site, missing): each edge with the place among its siblings, where it lands, and what a step says.

    edges: from_id, to_id, type, and order and line if they have them; nodes: id, service, and type and label. An edge to an id
    without a node stays, as missing. Steps into another service, and edges that leave a body, come first.
    """
    e = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), "type", _col(edges, "order", "long").alias("order"), _col(edges, "line", "long").alias("line"))
    e = e.join(_node(nodes, "a"), "a", "left").join(_node(nodes, "b").withColumn("known", F.lit(True)), "b", "left")
    crossing = F.col("type").isin(*CROSSING) | F.coalesce(F.col("a_service") != F.col("b_service"), F.lit(False))
    key = F.struct((~crossing).alias("inner"), F.col("order").isNotNull().alias("ordered"), F.coalesce("order", F.lit(0)).alias("order"), F.coalesce("line", F.lit((1 << 31) - 1)).alias("line"), "type", F.col("b").alias("to")).cast(KEY)
    kind = F.col("type")
    label_b = F.coalesce("b_label", "b")
    written = F.when(kind.isin("http_calls", "hits", "queries", "caches") & F.col("a_type").isin(*CALL_SITES), F.col("a_label")).when((kind == "consumes") & (F.col("a_type") == "channel"), F.col("a_label"))
    return e.select(
        "a", "b", "type", key.alias("key"), participant(kind, F.col("b_type"), label_b, F.col("b_service")).alias("p"), F.coalesce(written, label_b).alias("label"),
        F.coalesce(F.col("b_type").isin(*CALL_SITES), F.lit(False)).alias("site"), F.col("known").isNull().alias("missing"),
    )


def flow_rows(edges: DataFrame, nodes: DataFrame, entries: DataFrame, depth: int = 8, most: int | None = None) -> DataFrame:
    """(entry, path, level, parent, id, type, note, kind, source, target, label): the flow trees of entries (id).

    note is "", cycle, again or cut; kind, source, target and label say what step of the sequence the row is, if it is one. Levels
    end at `depth`; with `most`, a tree stops growing at the level where it has that many rows, and its first `most` rows, level
    by level, stay. A row under which something is left out is noted cut. Repeated edges are one; null ends lead nowhere; entries
    without a node have no tree.
    """
    step = materialise(steps_of(edges, nodes).filter("a is not null and b is not null").dropDuplicates(["a", "b", "type"]), "flow-steps")
    has_steps = step.select("a").distinct()
    none = F.lit(None).cast("string")
    start = entries.select("id").distinct().join(nodes.dropDuplicates(["id"]).select("id", "service", _col(nodes, "label", "string").alias("label"), _col(nodes, "kind", "string").alias("sub"), _col(nodes, "type", "string").alias("t")), "id")
    caller = F.coalesce(F.create_map(*[F.lit(x) for p in CALLERS.items() for x in p])[F.col("sub")], F.when(F.col("t") == "ui_action", "user"), F.lit("caller"))
    body = F.coalesce("service", "label", "id")
    root = start.select(
        F.col("id").alias("entry"), F.array().cast(f"array<{KEY}>").alias("path"), F.lit(0).alias("level"), none.alias("parent"), "id", none.alias("type"), F.lit("").alias("note"),
        F.lit("enters").alias("kind"), caller.alias("source"), body.alias("target"), F.coalesce("label", "id").alias("label"), body.alias("at"), F.array("id").alias("way"),
    )
    front = materialise(root, "flow")
    kept = [front.drop("at", "way")]
    seen = front.select("entry", "id")
    size = front.groupBy("entry").agg(F.count("*").alias("n")) if most else None
    short = []
    for k in range(1, depth + 1):
        if most:
            full = size.filter(F.col("n") >= most).select("entry")
            short.append(front.join(full, "entry", "left_semi").select("entry", "id"))
            front = front.join(full, "entry", "left_anti")
        grown = front.select("entry", "path", "at", "way", F.col("id").alias("a")).join(step.withColumnRenamed("label", "said"), "a")
        path, way = F.array_append("path", F.col("key")), F.array_append("way", F.col("b"))
        known = seen.select("entry", F.col("id").alias("b"), F.lit(True).alias("was"))
        grown = grown.select("entry", path.alias("path"), F.col("a").alias("parent"), "b", "type", "at", "way", way.alias("on"), "p", "said", "site", "missing").join(known, ["entry", "b"], "left")
        first = F.row_number().over(Window.partitionBy("entry", "b").orderBy("path"))
        note = F.when(F.array_contains("way", F.col("b")), "cycle").when(F.col("was") | (first > 1), "again").otherwise("")
        quiet = F.col("type").isin("handles", "calls") & (F.col("site") | (F.col("p") == F.col("at")))
        plain = ~F.col("type").isin("handles", "calls", *CROSSING)
        kind = F.when(F.col("missing"), "stop").when(quiet | plain, none).when(F.col("type").isin("handles", "calls"), "calls").otherwise(F.col("type"))
        to = F.when(kind.isNull() | (kind == "stop"), F.col("at")).otherwise(F.col("p"))
        made = grown.withColumns({"note": note, "kind": kind}).select(
            "entry", "path", F.lit(k).alias("level"), "parent", F.col("b").alias("id"), "type", "note", "kind", F.when(F.col("kind").isNotNull(), F.col("at")).alias("source"),
            F.when(F.col("kind").isNotNull(), to).alias("target"), F.when(F.col("kind") == "stop", "not in the graph").when(F.col("kind").isNotNull(), F.col("said")).alias("label"), to.alias("at"), F.col("on").alias("way"),
        )
        made = materialise(made, "flow")
        kept.append(made.drop("at", "way"))
        front = made.filter("note = ''")
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("entry", "id"))
        if most:
            size = materialise(size.unionByName(made.groupBy("entry").agg(F.count("*").alias("n"))).groupBy("entry").agg(F.sum("n").alias("n")), "flow-sizes")
    short.append(front.select("entry", "id"))
    rows = reduce(DataFrame.unionByName, kept)
    left = reduce(DataFrame.unionByName, short).join(has_steps.withColumnRenamed("a", "id"), "id", "left_semi").select("entry", "id")
    if most:
        order = Window.partitionBy("entry").orderBy("level", F.transform("path", lambda x: x["inner"]), "path")
        rows = materialise(rows.withColumn("_n", F.row_number().over(order)), "flow")
        left = left.unionByName(rows.filter(F.col("_n") > most).select("entry", F.col("parent").alias("id")))
        rows = rows.filter(F.col("_n") <= most).drop("_n")
    cut = left.distinct().withColumn("short", F.lit(True))
    return rows.join(cut, ["entry", "id"], "left").withColumn("note", F.when(F.col("short") & (F.col("note") == ""), "cut").otherwise(F.col("note"))).select("entry", "path", "level", "parent", "id", "type", "note", "kind", "source", "target", "label")


def placed(rows: DataFrame) -> DataFrame:
    """rows with `place`, from 0, in reading order within their entry: one sort of all rows by ranges, and a count for each entry."""
    n = materialise(O.numbered_over_all(rows, [F.col("entry"), F.col("path")], "_at"), "placed")
    first = n.groupBy("entry").agg(F.min("_at").alias("_first"))
    return n.join(first, "entry").withColumn("place", F.col("_at") - F.col("_first")).drop("_at", "_first")


def sequences(rows: DataFrame) -> DataFrame:
    """(entry, place, kind, source, target, label): the steps of each flow in order, from 0."""
    return placed(rows.filter("kind is not null").select("entry", "path", "kind", "source", "target", "label")).select("entry", "place", "kind", "source", "target", "label")


def steps_compared(base: DataFrame, head: DataFrame) -> DataFrame:
    """(entry, side both|base|head, same, added, removed): sequences of two versions (entry, place, kind, source, target, label).

    A flow whose steps are all equal isn't compared step by step. Of the others the common beginning and end are cut off first;
    what is left meets in one row a flow, as long as the flow, for the longest common subsequence.
    """
    said = F.to_json(F.array("kind", "source", "target", "label"))
    a, b = (x.select("entry", "place", said.alias("step")) for x in (base, head))
    sums = lambda x, p: x.groupBy("entry").agg(F.count("*").alias(f"n{p}"), F.bit_xor(F.xxhash64("place", "step")).alias(f"h{p}"), F.sum(F.xxhash64("step", "place") % 1000003).alias(f"s{p}"))
    met = materialise(sums(a, "a").join(sums(b, "b"), "entry", "full"), "sums")
    zero = F.lit(0).cast("long")
    only = met.filter("na is null or nb is null").select("entry", F.when(F.col("nb").isNull(), "base").otherwise("head").alias("side"), zero.alias("same"), F.coalesce("nb", zero).alias("added"), F.coalesce("na", zero).alias("removed"))
    equal = (F.col("na") == F.col("nb")) & (F.col("ha") == F.col("hb")) & (F.col("sa") == F.col("sb"))
    even = met.filter(equal).select("entry", F.lit("both").alias("side"), F.col("na").alias("same"), zero.alias("added"), zero.alias("removed"))
    odd = met.filter("na is not null and nb is not null").filter(~equal).select("entry")
    listed = lambda x, name: x.join(odd, "entry", "left_semi").groupBy("entry").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "step"))), lambda s: s["step"]).alias(name))
    pairs = listed(a, "base").join(listed(b, "head"), "entry")
    importable(base.sparkSession)

    def counts(base: pd.Series, head: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(base, head, strict=True):
            changes = [c for c, _ in D.sequence_steps(list(x), list(y))]
            out.append([changes.count(c) for c in ("same", "added", "removed")])
        return pd.DataFrame(out, columns=["same", "added", "removed"], dtype="int64")

    count = F.pandas_udf(counts, "same long, added long, removed long")
    differ = pairs.select("entry", count("base", "head").alias("c")).select("entry", F.lit("both").alias("side"), "c.same", "c.added", "c.removed")
    return only.unionByName(even).unionByName(differ)


def changed_flows(base: tuple[DataFrame, DataFrame], head: tuple[DataFrame, DataFrame], depth: int = 8, walk: int = 16) -> DataFrame:
    """(entry, reaches, side, same, added, removed): flows of (nodes, edges) that a change touches, and how their steps changed.

    Candidates are entries of either version that reach a node or the start of an edge that was added, removed or changed; reaches
    is how many of those. Only their sequences are made and compared; a flow whose steps stay the same is told with nothing added.
    """
    (nodes_a, edges_a), (nodes_b, edges_b) = base, head
    own = [c for c in ("type", "kind", "label", "service") if c in nodes_a.columns]
    ends = lambda e: e.select("from_id", "to_id", "type").distinct()
    nodes = D.diff_rows(nodes_a.select("id", *own), nodes_b.select("id", *own), ["id"], own).select("id")
    a, b = ends(edges_a), ends(edges_b)
    sides = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(2)))
    moved = sides.groupBy("from_id", "to_id", "type").agg(F.sum("side").alias("sides")).filter("sides < 3").select(F.col("from_id").alias("id"))
    changed = materialise(nodes.union(moved).distinct(), "changed")
    entries = nodes_a.filter("type = 'entry'").select("id").union(nodes_b.filter("type = 'entry'").select("id")).distinct()
    both = materialise(a.unionByName(b).distinct(), "edges")
    near = reached_from(both, entries, changed, walk)
    seeds = near.select("id")
    side = lambda n, e: sequences(flow_rows(e, n, n.select("id").join(seeds, "id", "left_semi"), depth))
    return steps_compared(side(nodes_a, edges_a), side(nodes_b, edges_b)).join(near.withColumnRenamed("id", "entry"), "entry").select("entry", "reaches", "side", "same", "added", "removed")


def reached_from(edges: DataFrame, entries: DataFrame, marked: DataFrame, depth: int = 16) -> DataFrame:
    """(id, reaches): of entries (id), those that come to marked nodes (id) within `depth` steps, and to how many of them.

    Entries that can come to none are left out first, by a walk back from the marked nodes; only the others are walked from, and
    only over nodes that still lead to a marked one.
    """
    from .bitmaps import counts_reached

    back = blast_radius(edges.withColumn("confidence", F.lit("static")), marked, None, depth).select("id")
    live = materialise(back, "live")
    own = edges.join(live.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(live.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    return counts_reached(own, entries.join(live, "id", "left_semi"), marked, depth)


def compared(base: tuple, head: tuple, depth: int = 8) -> DataFrame:
    """(what, id, change): the whole comparison of two versions (nodes, edges, types or None, unresolved or None).

    node and edge: added, removed, changed. type: added or removed as a whole, or one of its fields (id with its path) added,
    removed, of another type or optionality. unresolved: rows of a service and reason that are gone or came, one row for each
    pair. join: a node that had edges into another service or store, is still there and has none, is lost. flow: an entry
    whose steps changed.
    """
    (nodes_a, edges_a, types_a, gaps_a), (nodes_b, edges_b, types_b, gaps_b) = base, head
    row = lambda df, what, change, i=F.col("id"): df.select(F.lit(what).alias("what"), i.alias("id"), change.alias("change"))
    own = [c for c in ("type", "kind", "label", "service") if c in nodes_a.columns]
    key = F.concat(F.col("from_id"), F.lit(" -"), "type", F.lit("-> "), "to_id").alias("id")
    same = [c for c in ("confidence", "params", "returns") if c in edges_a.columns and c in edges_b.columns]
    found = [
        row(D.diff_rows(nodes_a.select("id", *own), nodes_b.select("id", *own), ["id"], own), "node", F.col("change")),
        row(D.diff_rows(edges_a.select(key, *same).dropDuplicates(["id"]), edges_b.select(key, *same).dropDuplicates(["id"]), ["id"], same or ["id"]), "edge", F.col("change")),
    ]
    if types_a is not None and types_b is not None:
        from .contracts import declaration_changes

        found.append(row(D.diff_rows(types_a.select("id").distinct(), types_b.select("id").distinct(), ["id"], ["id"]), "type", F.col("change")))
        flat = lambda t: D.flatten_types(t.select("id", "fields"), 1)
        found.append(row(declaration_changes(flat(types_a), flat(types_b)), "type", F.col("change"), F.concat_ws(".", "id", "path")))
    if gaps_a is not None and gaps_b is not None:
        bag = D.bag_difference(gaps_a, gaps_b, ["service", "reason"])
        where = F.concat_ws("/", "service", "reason")
        found += [row(bag.filter("gone > 0"), "unresolved", F.concat(F.lit("gone "), "gone"), where), row(bag.filter("came > 0"), "unresolved", F.concat(F.lit("came "), "came"), where)]
    crossing = lambda e: e.filter(F.col("type").isin(*CROSSING)).select("from_id").distinct()
    lost = D.lost_joins(crossing(edges_a), crossing(edges_b)).select(F.col("from_id").alias("id")).join(nodes_b.select("id").distinct(), "id", "left_semi")
    found.append(row(lost, "join", F.lit("lost")))
    flows = changed_flows((nodes_a, edges_a), (nodes_b, edges_b), depth).filter("added + removed > 0 or side <> 'both'")
    found.append(row(flows, "flow", F.when(F.col("side") == "both", F.concat(F.lit("+"), "added", F.lit(" -"), "removed")).otherwise(F.col("side")), F.col("entry")))
    return reduce(DataFrame.unionByName, found)
