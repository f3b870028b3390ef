"""Named queries with parameters over a user's own graph: the tables of a store, or any four DataFrames of those schemas.

    g = Graph.open(spark, "s3a://bucket/graph")
    g.impact("table:orders").show()

Every tool is a DataFrame, so nothing is walked or collected before it is asked for; what a tool cuts it says in its docstring.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import bitmaps as B
from .operators import contracts as K
from .operators import diff as D
from .operators import flows as W
from .operators import orders as O
from .operators import rules as R
from .operators import telemetry as M
from .operators import traverse as T
from .operators import unresolved as U
from .schema import rank
from .store import open_store

#: Edges that lead from what calls to what is called, and those that cross services.
FORWARD = ("handles", "calls", "queries", "caches", "emits", "consumes", "http_calls", "hits", "triggers")
CROSSING = ("emits", "consumes", "http_calls", "hits", "triggers")


@dataclass(frozen=True)
class Graph:
    """nodes (id, type, kind, label, service), edges (from_id, to_id, type, confidence), types (id, name, repo, fields), unresolved
    (id, service, file, line, reason, level, sites, kind), reasons (reason, reason_kind, risk, hint, marker) and spans credited to
    entries (trace_id, span_id, parent_id, service, entry, at, status, duration_ms, error)."""

    nodes: DataFrame
    edges: DataFrame
    types: DataFrame | None = None
    unresolved: DataFrame | None = None
    reasons: DataFrame | None = None
    spans: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, names: Sequence[str] = ("nodes", "edges", "types", "unresolved")) -> Graph:
        return cls(**open_store(spark, path, tuple(names)))

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def _seeds(self, ids: str | Sequence[str]) -> DataFrame:
        own = [ids] if isinstance(ids, str) else list(ids)
        return self.spark.createDataFrame([(i,) for i in own], "id string")

    def start_here(self, entries: int = 3) -> DataFrame:
        """(service, entries, nodes, first): counts of each service and its first entries."""
        n = self.nodes.filter("service is not null")
        first = O.first_of_each(n.filter("type = 'entry'"), ["service"], [F.col("id")], entries).groupBy("service").agg(F.sort_array(F.collect_list("id")).alias("first"))
        return n.groupBy("service").agg(F.count_if(F.col("type") == "entry").alias("entries"), F.count("*").alias("nodes")).join(first, "service", "left")

    def list_entries(self, service: str | None = None, kind: str | None = None) -> DataFrame:
        out = self.nodes.filter("type = 'entry'")
        for c, v in (("service", service), ("kind", kind)):
            out = out if v is None else out.filter(F.col(c) == v)
        return out.orderBy("id")

    def find_symbol(self, refs: Sequence[str]) -> DataFrame:
        """(ref, outcome, stage, id, n): by id, label, label without case, last part; the first stage that hits."""
        return U.resolve(self.spark.createDataFrame([(r,) for r in refs], "ref string"), self.nodes.select("id", "label"))

    def search(self, text: str, types: Sequence[str] = (), most: int = 50) -> DataFrame:
        """(what, id, label): nodes, types and rows not followed that hold the text, shortest first; the first `most`."""
        like = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).contains(text.lower())
        n = self.nodes.filter(like("id") | like("label"))
        out = (n.filter(F.col("type").isin(*types)) if types else n).select(F.lit("node").alias("what"), "id", "label")
        if self.types is not None and not types:
            out = out.unionByName(self.types.filter(like("name")).select(F.lit("type").alias("what"), "id", F.col("name").alias("label")))
        if self.unresolved is not None and not types:
            out = out.unionByName(self.unresolved.filter(like("reason")).select(F.lit("unresolved").alias("what"), F.col("id").cast("string").alias("id"), F.col("reason").alias("label")))
        return O.top(out, [F.length("label"), F.col("id")], most)

    def get_flow(self, entry: str, depth: int = 8, most: int = 150) -> DataFrame:
        """(level, id, type, note): what an entry leads to, in reading order, at most `most` rows."""
        rows = T.flow_tree(self.edges.filter(F.col("type").isin(*FORWARD)), self.nodes, entry, depth, most)
        return self.spark.createDataFrame(rows, "level int, id string, type string, note string") if rows else self.spark.createDataFrame([], "level int, id string, type string, note string")

    def who_calls(self, ids: str | Sequence[str], depth: int = 3, types: Sequence[str] = FORWARD) -> DataFrame:
        return T.reach(self.edges, self._seeds(ids), "in", types, depth).filter("depth > 0").join(self.nodes, "id")

    def impact(self, ids: str | Sequence[str], depth: int = 16, entries_only: bool = True) -> DataFrame:
        """(id, depth, confidence, type, service): what reaches the ids, with the best way's weakest step."""
        found = T.blast_radius(self.edges, self._seeds(ids), FORWARD, depth).join(self.nodes.select("id", "type", "service", "label"), "id")
        return found.filter("type in ('entry', 'ui_action')") if entries_only else found

    def reached(self, entry: str, depth: int = 8, crossing: bool = False) -> DataFrame:
        """Forward edges' reach of an entry, or that of the edges that cross services alone."""
        return T.reach(self.edges, self._seeds(entry), "out", CROSSING if crossing else FORWARD, depth).join(self.nodes, "id")

    def writes_reached(self, entries: DataFrame, depth: int = 8) -> DataFrame:
        """(entry, table): tables that are written within `depth` steps of each of entries (id); all are walked at once, as bitmaps."""
        op = F.col("op") if "op" in self.edges.columns else F.lit("write")
        writes = self.edges.filter((F.col("type") == "queries") & op.isin("write", "delete")).select(F.col("from_id").alias("id"), F.col("to_id").alias("table"))
        return B.writes_reached(self.edges.filter(F.col("type").isin("handles", "calls")), entries, writes, depth)

    def sequences(self, entries: DataFrame | None = None, depth: int = 8) -> DataFrame:
        """(entry, place, kind, source, target, label): the steps of each entry's flow, in order; of all entries, or those given (id)."""
        own = self.nodes.filter("type = 'entry'") if entries is None else entries
        return W.sequences(W.flow_rows(self.edges.filter(F.col("type").isin(*FORWARD)), self.nodes, own, depth))

    def flow_changes(self, base: Graph, depth: int = 8) -> DataFrame:
        """(entry, reaches, side, same, added, removed): flows that a change since base touches, and how their steps changed."""
        own = lambda g: (g.nodes, g.edges.filter(F.col("type").isin(*FORWARD)))
        return W.changed_flows(own(base), own(self), depth)

    def comparison(self, base: Graph, depth: int = 8) -> DataFrame:
        """(what, id, change): all that changed since base: nodes, edges, types, rows not followed, lost joins, entries and flows."""
        keyed = lambda g: (g.nodes, g.edges.filter(F.col("type").isin(*FORWARD)), g.types, g.unresolved)
        return W.compared(keyed(base), keyed(self), depth)

    def _traffic(self) -> DataFrame:
        if self.spans is None:
            raise ValueError("the graph has no spans")
        return self.spans

    def slow_steps(self, least: int = 5, most: int = 10) -> DataFrame:
        """(service, entry, count, error_rate, p50, p95, max_ms): the slowest entries that were called `least` times or more."""
        found = M.summary(self._traffic().filter("entry is not null"), ["service", "entry"]).filter(F.col("count") >= least)
        return O.top(found, [F.desc("p95"), F.col("service"), F.col("entry")], most).drop("errors")

    def hot_paths(self, each: int = 3) -> DataFrame:
        """(entry, service, hits, place): the services that an entry's spans are in most often, `each` of an entry."""
        counts = self._traffic().filter("entry is not null").groupBy("entry", "service").agg(F.count("*").alias("hits"))
        return O.first_of_each(counts, ["entry"], [F.desc("hits"), F.col("service")], each)

    def trace_for(self, entry: str, most: int = 3) -> DataFrame:
        """(why slow|failing, rank, and the spans' columns): all spans of an entry's slowest and latest failing traces."""
        s = self._traffic()
        picked = M.samples(s.filter(F.col("entry") == entry), "entry", most).select("why", "rank", "span_id")
        traces = picked.join(s.filter(F.col("entry") == entry).select("span_id", "trace_id"), "span_id").select("why", "rank", "trace_id").distinct()
        return s.join(F.broadcast(traces), "trace_id")  # at most 2 x `most` traces

    def undeclared_failures(self, declared: DataFrame) -> DataFrame:
        """(entry, open5, open_all, share): failures (400 and over) that declared (entry, status) doesn't have, worst first.

        open5 are those of 500 and over; share is the largest of one status among all of the entry's spans.
        """
        counts = self._traffic().filter("entry is not null").groupBy("entry", "status").agg(F.count("*").alias("n"))
        total = counts.groupBy("entry").agg(F.sum("n").alias("total"))
        left = counts.filter("status >= 400").join(declared.select("entry", "status").distinct(), ["entry", "status"], "left_anti").join(total, "entry")
        out = left.groupBy("entry").agg(F.sum(F.when(F.col("status") >= 500, F.col("n")).otherwise(0)).alias("open5"), F.sum("n").alias("open_all"), M.round_half_up(F.max(F.col("n") / F.col("total")), 4).alias("share"))
        return out.orderBy(F.desc("open5"), F.desc("open_all"), F.desc("share"), "entry")

    def never_seen(self) -> DataFrame:
        """(id, kind, service, label): entries that no span was credited to."""
        seen = self._traffic().select(F.col("entry").alias("id")).distinct()
        return self.nodes.filter("type = 'entry'").join(seen, "id", "left_anti").select("id", "kind", "service", "label")

    def get_source(self, refs: Sequence[str]) -> DataFrame:
        """(ref, id, file, line): where what the references resolve to is written; refs that fit nothing or several have no place."""
        found = self.find_symbol(refs)
        return found.select("ref", "id").join(self.nodes.select("id", "file", "line"), "id", "left").select("ref", "id", "file", "line")

    def who_emits(self, channel: str) -> DataFrame:
        return self.edges.filter((F.col("type") == "emits") & (F.col("to_id") == U.channel_id(F.lit(channel)))).select(F.col("from_id").alias("id"), "confidence").join(self.nodes, "id", "left")

    def who_consumes(self, channel: str) -> DataFrame:
        return self.edges.filter((F.col("type") == "consumes") & (F.col("from_id") == U.channel_id(F.lit(channel)))).select(F.col("to_id").alias("id"), "confidence").join(self.nodes, "id", "left")

    def get_type(self, name: str, depth: int = 3) -> DataFrame:
        """(id, path, type, optional) of the types of that id or name, nested ones to `depth`."""
        own = self.types.filter((F.col("id") == name) | (F.col("name") == name)).select("id")
        return D.flatten_types(self.types.select("id", "fields"), depth).join(F.broadcast(own) if own.limit(1001).count() <= 1000 else own, "id", "left_semi")

    def type_usage(self, type_id: str) -> DataFrame:
        """(how, id): types with a field of this one, and edges whose parameters or results name it."""
        inside = self.types.filter(F.exists("fields", lambda f: F.array_contains(F.regexp_extract_all(f["type"], F.lit(r"(type:[\w#./-]+)"), 1), type_id))).select(F.lit("nested").alias("how"), "id")
        for column, how in (("params", "taking"), ("returns", "returning")):
            if column in self.edges.columns:
                text = F.array_join(column, " ") if column == "params" else F.col(column)
                inside = inside.unionByName(self.edges.filter(F.contains(F.coalesce(text, F.lit("")), F.lit(type_id))).select(F.lit(how).alias("how"), F.col("from_id").alias("id")))
        return inside.distinct()

    def check_contract(self, pairs: DataFrame, ignored: Sequence[str] = ()) -> DataFrame:
        """pairs (pair, sent, wanted) -> (pair, status, path, kind, severity)."""
        return K.check(pairs, self.types, list(ignored))

    def get_spec(self) -> DataFrame:
        return K.json_schemas(self.types)

    def what_changed(self, base: Graph) -> DataFrame:
        """(what, id, change): nodes and edges that were added, removed or changed since base."""
        n = D.diff_rows(base.nodes, self.nodes, ["id"], [c for c in ("type", "kind", "label", "service") if c in self.nodes.columns]).select(F.lit("node").alias("what"), "id", "change")
        key = F.concat(F.col("from_id"), F.lit(" -"), "type", F.lit("-> "), "to_id").alias("id")
        return n.unionByName(D.diff_rows(base.edges.select(key, "confidence"), self.edges.select(key, "confidence"), ["id"], ["confidence"]).select(F.lit("edge").alias("what"), "id", "change"))

    def changed_flows(self, base: Graph, depth: int = 16) -> DataFrame:
        """(id, depth, confidence): entries that reach a node that was changed or removed since base, or added."""
        changed = self.what_changed(base).filter("what = 'node'").select("id")
        both = self.edges.select("from_id", "to_id", "type", "confidence").unionByName(base.edges.select("from_id", "to_id", "type", "confidence")).distinct()
        found = T.blast_radius(both, changed, FORWARD, depth)
        return found.join(self.nodes.unionByName(base.nodes, allowMissingColumns=True).filter("type in ('entry', 'ui_action')").select("id").distinct(), "id", "left_semi")

    def check_rules(self, rules: Sequence[R.Rule]) -> DataFrame:
        return R.evaluate(self.nodes, self.edges, rules)

    def dead(self, kinds: Sequence[str] = ("entry", "method", "provider", "channel")) -> DataFrame:
        """(id, type, verdict): nodes of those types that nothing leads to; entries that something outside starts are unknown."""
        used = self.edges.filter(F.col("type").isin(*FORWARD, "injects")).select(F.col("to_id").alias("id")).distinct()
        out = self.nodes.filter(F.col("type").isin(*kinds)).join(used, "id", "left_anti")
        return out.select("id", "type", F.when((F.col("type") == "entry") & U.never_dead(F.coalesce("kind", F.lit(""))), "unknown").otherwise("dead").alias("verdict"))

    def findings(self, most: int = 20) -> DataFrame:
        """Rows not followed by reason, worst first."""
        return U.doctor(U.decoded(self.unresolved, self.reasons), self.reasons, most)

    def cant_follow(self, service: str | None = None) -> DataFrame:
        """(service, reason, rows, sites): missed rows only."""
        rows = U.decoded(self.unresolved, self.reasons).filter(U.missed())
        rows = rows if service is None else rows.filter(F.col("service") == service)
        return rows.groupBy("service", "reason").agg(F.count("*").alias("rows"), F.sum("sites").alias("sites"))

    def hotspots(self, types: Sequence[str] = FORWARD, most: int = 20) -> DataFrame:
        """(id, degree, services): most called nodes and how many services call them."""
        n = self.nodes.select(F.col("id").alias("from_id"), "service")
        g = self.edges.filter(F.col("type").isin(*types)).join(n, "from_id", "left").groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("degree"), F.count_distinct("service").alias("services"))
        return O.top(g, [F.desc("degree"), F.col("id")], most)

    def crossings(self, a: str, b: str) -> DataFrame:
        """(from_id, to_id, type, confidence): edges between two services, either way, weakest first."""
        n = self.nodes.select("id", "service")
        e = self.edges.join(n.select(F.col("id").alias("from_id"), F.col("service").alias("x")), "from_id").join(n.select(F.col("id").alias("to_id"), F.col("service").alias("y")), "to_id")
        own = e.filter(((F.col("x") == a) & (F.col("y") == b)) | ((F.col("x") == b) & (F.col("y") == a)))
        return own.orderBy(rank(F.col("confidence")), "from_id", "to_id").select("from_id", "to_id", "type", "confidence")

    def cycles(self, types: Sequence[str] = FORWARD) -> DataFrame:
        return T.strong_components(self.edges.filter(F.col("type").isin(*types)))
