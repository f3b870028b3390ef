"""Bounded traversal: reach, simple paths, blast radius, components; the state of each level is a table in the shared folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CONFIDENCE, rank
from ..store import BROADCAST_BYTES, materialise, sized

#: Bytes of an id with what goes along, when a set of ids is measured for a broadcast.
ROW_BYTES = 64


def steps_of(edges: DataFrame, direction: str = "out", types: Sequence[str] | None = None) -> DataFrame:
    """(a, b, type, confidence): from the near to the far end. An empty or missing list of types is no filter."""
    near, far = ("from_id", "to_id") if direction == "out" else ("to_id", "from_id")
    own = edges.filter(F.col("type").isin(*types)) if types else edges
    return own.select(F.col(near).alias("a"), F.col(far).alias("b"), "type", "confidence")


def reach(edges: DataFrame, seeds: DataFrame, direction: str = "out", types: Sequence[str] | None = None, depth: int = 6, by: str | None = None) -> DataFrame:
    """(id, depth) of all ids within `depth` steps of seeds.id, least depth first reached. With `by`, apart for each value of seeds.by."""
    keys = [by, "id"] if by else ["id"]
    step = steps_of(edges, direction, types).select("a", "b")
    step = materialise(step, "steps") if depth > 1 else step  # edges may be a costly view; levels read them again and again
    seen = materialise(seeds.select(*keys).distinct().withColumn("depth", F.lit(0)), "reach")
    front, size = seen, seen.count()
    total = size
    for k in range(1, depth + 1):
        # a front and a seen set of measured size are broadcast, so the edges stay where they are; larger ones are met by their different ids
        near = front.withColumnRenamed("id", "a").drop("depth")
        new = _met(step, near, size).select(*([by] if by else []), F.col("b").alias("id")).distinct()
        if total * ROW_BYTES <= BROADCAST_BYTES:
            new = new.join(F.broadcast(seen.select(*keys)), keys, "left_anti")
        else:
            new = materialise(new, "reach")
            old = _of(seen.select(*keys), "id", new)
            if not old.isEmpty():
                new = new.join(old, keys, "left_anti")
        front = materialise(new.withColumn("depth", F.lit(k)).select(*keys, "depth"), "reach")
        size = front.count()
        if not size:
            break
        seen, total = seen.unionByName(front), total + size
    return seen


def _of(df: DataFrame, key: str, other: DataFrame) -> DataFrame:
    """The rows of df whose key some row of other has; broadcast where the different keys are few."""
    own = materialise(other.select(key).distinct(), "ids")
    return df.join(sized(own, own.count(), ROW_BYTES), key, "left_semi")


def _met(step: DataFrame, near: DataFrame, size: int) -> DataFrame:
    """step (a, b) joined with a front (a, ...) of so many rows. Of a long front that stands at few ids, the steps of those are
    sought first: where they are few they go to the front, and neither side is shuffled."""
    if size * ROW_BYTES <= BROADCAST_BYTES:
        return step.join(F.broadcast(near), "a")
    own = materialise(near.select("a").distinct(), "ids")
    ids = own.count()
    if ids * ROW_BYTES > BROADCAST_BYTES:
        return step.join(near, "a")
    few = materialise(step.join(F.broadcast(own), "a", "left_semi"), "steps")
    return near.join(sized(few, few.count(), 2 * ROW_BYTES), "a")


def reach_all(edges: DataFrame, seeds: DataFrame, by: str) -> DataFrame:
    """(by, id) of all ids that seeds (by, id) reach in any number of steps, apart for each value of `by`, they themselves too.

    An id with one way out jumps: 1, 2, 4 ... steps of such ids are a table each, so a chain of n ids is walked in about log2(n)
    rounds; ids with more ways out are left by single steps. What grows with the graph is shuffled, never sent through the driver.
    """
    keys = [by, "id"]
    step = materialise(edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).filter("a is not null and b is not null").distinct(), "steps")
    jumps = [materialise(step.groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("n")).filter("n = 1").drop("n"), "jumps")]
    fork = materialise(step.join(jumps[0].select("a").hint("merge"), "a", "left_anti"), "forks")
    seen, front = None, materialise(seeds.select(*keys).filter("id is not null").distinct(), "reach")
    forks = not fork.isEmpty()
    while True:
        k = 0
        while True:  # all within 2^k steps of the front are in it; if jumps of 2^k meet nothing new, no chain leaves it
            if k == len(jumps):
                on = jumps[-1].select(F.col("a").alias("b"), F.col("b").alias("c")).hint("merge")
                jumps.append(materialise(jumps[-1].join(on, "b").select("a", F.col("c").alias("b")), "jumps"))
            new = front.withColumnRenamed("id", "a").join(jumps[k].hint("merge"), "a").select(by, F.col("b").alias("id")).distinct()
            new = materialise(new.join(front.hint("merge"), keys, "left_anti"), "reach")
            if new.isEmpty():
                break
            front, k = front.unionByName(new), k + 1
        if not forks:
            return front
        front = front if seen is None else front.join(seen.hint("merge"), keys, "left_anti")
        front = materialise(front, "reach")
        seen = front if seen is None else materialise(seen.unionByName(front), "reach")
        new = front.withColumnRenamed("id", "a").join(fork.hint("merge"), "a").select(by, F.col("b").alias("id")).distinct()
        front = materialise(new.join(seen.hint("merge"), keys, "left_anti"), "reach")
        if front.isEmpty():
            return seen


def simple_paths(edges: DataFrame, seeds: DataFrame, direction: str = "out", types: Sequence[str] | None = None, depth: int = 6) -> DataFrame:
    """(id, depth, path, edge_type): one row for each simple path of at most `depth` steps; path is the ids joined by ">"."""
    step = steps_of(edges, direction, types).select("a", "b", "type")
    step = materialise(step, "steps") if depth > 1 else step
    front = seeds.select("id", F.lit(0).alias("depth"), F.array("id").alias("ids"), F.lit(None).cast("string").alias("edge_type"))
    out = front
    for k in range(1, depth + 1):
        grown = front.select(F.col("id").alias("a"), "ids").join(step, "a").filter(~F.array_contains("ids", F.col("b")))
        front = materialise(grown.select(F.col("b").alias("id"), F.lit(k).alias("depth"), F.array_append("ids", F.col("b")).alias("ids"), F.col("type").alias("edge_type")), "paths")
        if not front.limit(1).count():
            break
        out = out.unionByName(front)
    return out.select("id", "depth", F.array_join("ids", ">").alias("path"), "edge_type")


def shortest_cycles(edges: DataFrame) -> DataFrame:
    """(id, length, path): for each id on a cycle its shortest way back to itself, of any length; path is the ids joined by ">",
    the first among equals.

    Breadth first from each id; of the ways to an id of a level only the first by path goes on, as all end alike. An id whose
    way is closed walks no further.
    """
    step = materialise(steps_of(edges).select("a", "b").distinct(), "steps")
    front = step.select(F.col("a").alias("start"), F.col("a").alias("id"), F.col("a").alias("path")).distinct()
    seen, out, k = front.select("start", "id").limit(0), None, 0
    while True:
        k += 1
        grown = front.withColumnRenamed("id", "a").join(step, "a").select("start", F.col("b").alias("id"), F.concat_ws(">", "path", "b").alias("path"))
        new = materialise(grown.join(seen, ["start", "id"], "left_anti").groupBy("start", "id").agg(F.min("path").alias("path")), "cycles")
        closed = new.filter("id = start").select("id", F.lit(k).alias("length"), "path")
        out = closed if out is None else out.unionByName(closed)
        front = new.filter("id <> start").join(closed.select(F.col("id").alias("start")), "start", "left_anti")
        if not front.limit(1).count():
            return out
        seen = seen.unionByName(front.select("start", "id"))


def traverse(nodes: DataFrame, paths: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The first `most` paths by (depth, path) whose end has a node, with its columns; and whether there are more."""
    rows = paths.join(nodes, "id").orderBy("depth", "path").limit(most + 1)
    cut = rows.count() > most
    return rows.orderBy("depth", "path").limit(most), cut


def first_per_id(rows: DataFrame) -> DataFrame:
    """The first path to each id by (depth, path)."""
    w = Window.partitionBy("id").orderBy("depth", "path")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def blast_radius(edges: DataFrame, seeds: DataFrame, types: Sequence[str] | None = None, depth: int = 16) -> DataFrame:
    """(id, depth, confidence) of all that reaches the seeds: least depth, and of all ways within `depth` the best one's weakest step.

    Walks do as well as simple paths, as a detour weakens none; so a level keeps only ids that are new or better than before.
    """
    step = steps_of(edges, "in", types).select("a", "b", rank(F.col("confidence")).alias("r"))
    step = materialise(step, "steps") if depth > 1 else step
    best = materialise(seeds.select("id").distinct().select("id", F.lit(0).alias("depth"), F.lit(len(CONFIDENCE) - 1).alias("r")), "blast")
    front, size = best, best.count()
    total = size
    for k in range(1, depth + 1):
        own = sized(front.select(F.col("id").alias("a"), F.col("r").alias("q")), size, ROW_BYTES)
        new = step.join(own, "a").groupBy(F.col("b").alias("id")).agg(F.max(F.least("q", "r")).alias("r"))
        old = sized(best.select("id", F.col("r").alias("was")), total, ROW_BYTES)
        front = materialise(new.join(old, "id", "left").filter("was is null or r > was").select("id", F.lit(k).alias("depth"), "r"), "blast")
        size = front.count()
        if not size:
            break
        best, total = best.unionByName(front).groupBy("id").agg(F.min("depth").alias("depth"), F.max("r").alias("r")), total + size
        if k < depth:
            best = materialise(best, "blast")
    names = F.array(*[F.lit(c) for c in CONFIDENCE])
    return best.select("id", "depth", F.element_at(names, F.col("r") + 1).alias("confidence"))


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """labels (id, c), each id's own at first, spread along edges (a, b) till each id has the least c of all that reach it.

    What reaches an id's label reaches the id, so each round also takes over the label of the label: what an id has seen of a chain
    doubles, and rounds grow with the logarithm of its length.
    """
    while True:
        came = edges.join(labels.select(F.col("id").alias("a"), F.col("c").alias("d")), "a").groupBy(F.col("b").alias("id")).agg(F.min("d").alias("d"))
        near = labels.join(came, "id", "left").select("id", F.col("c").alias("was"), F.least("c", F.coalesce("d", "c")).alias("c"))
        jumped = near.join(labels.select(F.col("id").alias("c"), F.col("c").alias("up")), "c", "left")
        new = materialise(jumped.select("id", F.least("c", F.coalesce("up", "c")).alias("c"), "was").select("id", "c", (F.col("c") < F.col("was")).alias("less")), "colours")
        changed = new.filter("less").limit(1).count()
        labels = new.select("id", "c")
        if not changed:
            return labels


def strong_components(edges: DataFrame, a: str = "from_id", b: str = "to_id") -> DataFrame:
    """(id, component): strongly connected components of two ids or more; component is the least id.

    Ids without a way in or out are trimmed. Then the least id that reaches an id colours it; what an id of its own colour
    reaches backwards within the colour is that id's component; the rest goes on.
    """
    left = materialise(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "scc")
    found = None
    while True:
        n = left.count()
        while n:  # trim
            kept = left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
            kept = materialise(kept.select("a", "b"), "scc")
            m = kept.count()
            left, done, n = kept, m == n, m
            if done:
                break
        if not n:
            break
        ids = left.select(F.col("a").alias("id")).union(left.select("b")).distinct()
        colour = _spread(left, ids.withColumn("c", F.col("id")))
        same = left.join(colour.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(colour.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
        inner = materialise(same.filter("ca = cb").select("a", "b"), "scc")
        back = reach(inner.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.lit("e").alias("type"), F.lit("static").alias("confidence")), colour.filter("id = c").select("id"), "in", None, 1 << 20)
        own = materialise(back.join(colour, "id").select("id", F.col("c").alias("component")), "scc")
        found = own if found is None else found.unionByName(own)
        left = materialise(inner.join(own.select(F.col("id").alias("a")), "a", "left_anti").join(own.select(F.col("id").alias("b")), "b", "left_anti"), "scc")
    if found is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1")
    return found.join(sizes.select("component"), "component", "left_semi").select("id", "component")


def in_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, in_degree, callers, by_type): edges into each id, services they come from, and edges by type."""
    rows = edges.join(nodes.select(F.col("id").alias("from_id"), "service"), "from_id", "left")
    per = rows.groupBy("to_id", "type").agg(F.count("*").alias("n"), F.collect_set("service").alias("s"))
    return per.groupBy(F.col("to_id").alias("id")).agg(
        F.sum("n").alias("in_degree"), F.size(F.array_distinct(F.flatten(F.collect_list("s")))).alias("callers"), F.sort_array(F.collect_list(F.concat_ws("=", "type", "n"))).alias("by_type")
    )


def collapse_channels(edges: DataFrame) -> DataFrame:
    """Producer to consumer through each channel: (from_id, to_id, channel, confidence), the weaker of both steps."""
    a = edges.filter("type = 'emits'").select("from_id", F.col("to_id").alias("channel"), rank(F.col("confidence")).alias("x"))
    b = edges.filter("type = 'consumes'").select(F.col("from_id").alias("channel"), "to_id", rank(F.col("confidence")).alias("y"))
    names = F.array(*[F.lit(c) for c in CONFIDENCE])
    return a.join(b, "channel").select("from_id", "to_id", "channel", F.element_at(names, F.least("x", "y") + 1).alias("confidence"))


def flow_tree(edges: DataFrame, nodes: DataFrame, entry: str, depth: int = 8, most: int = 150) -> list[tuple[int, str, str, str]]:
    """(level, id, edge type, note) of what an entry leads to, in reading order; the first `most` rows, level by level.

    Steps into another service come first. A node on its own way is noted "cycle", one expanded elsewhere "again", one under which
    something is left out "cut" (see flows.flow_rows, which has the trees of many entries).
    """
    from .flows import flow_rows

    rows = flow_rows(edges, nodes, nodes.filter(F.col("id") == entry), depth, most)
    return [(r.level, r.id, r.type or "", r.note) for r in rows.orderBy("path").select("level", "id", "type", "note").collect()]  # at most `most`


def walk_back(edges: DataFrame, seeds: DataFrame, steps: DataFrame, base: int = 8, types: Sequence[str] | None = None) -> tuple[DataFrame, int]:
    """(ids reached backwards with their depth, the depth walked): `base` hops and one more for each step (steps.id) climbed.

    Walked again, further, whenever it climbed steps that it wasn't lengthened for; there are so many steps, so this ends.
    """
    depth = base
    steps = materialise(steps.select("id").distinct(), "steps")
    while True:
        got = reach(edges, seeds, "in", types, depth)
        needed = base + got.select("id").distinct().join(steps, "id", "left_semi").count()
        if needed <= depth:
            return got, depth
        depth = needed
