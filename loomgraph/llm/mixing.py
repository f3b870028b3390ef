"""Mixing sources to target weights (op8), by Pfair scheduling.

The rows of a source are put in a random order and cut into blocks. Block j of a source of weight w may not start before
floor(j/w) and has to be done by ceil((j+1)/w); earliest deadline first fills one slot after another, so at every slot each
source has had less than one block more or less than w times the slots. Weights are exact: whole numbers over their sum, so
nothing is rounded and nothing adds up over many blocks. The driver walks the slots once and keeps only how many blocks each
source has had at the start of every stretch; tasks walk their stretch again from there and say which block has which slot.
When a source has no more blocks a new phase begins with the weights of the others: no row is dropped or repeated.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction
from itertools import accumulate
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PRE, buckets_for, importable, ranked, sized, table

#: A stretch of a phase: first slot of the phase, slots in the stretch, and of each source its place, blocks before the phase, blocks since.
STRETCH = "base long, n long, who array<int>, before array<long>, done array<long>"
PLACED = "who int, block long, slot long, release long, deadline long, start long"


def shares(weights: Mapping, cycle: int) -> dict:
    """Whole slots of a cycle for each source, at least one, by largest remainders; they add up to `cycle`. mix() rounds nothing and doesn't use them."""
    total = sum(weights.values())
    exact = {s: w / total * cycle for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(out, key=lambda s: (out[s] - exact[s], str(s)))
    while (gap := cycle - sum(out.values())) > 0:
        for s in order[:gap]:
            out[s] += 1
    while (gap := sum(out.values()) - cycle) > 0:
        for s in [s for s in reversed(order) if out[s] > 1][:gap]:
            out[s] -= 1
    return out


def whole(weights: Mapping) -> dict:
    """The weights as whole numbers in exactly the same proportions."""
    parts = {s: Fraction(w) for s, w in weights.items()}
    unit = lcm(*(p.denominator for p in parts.values()))
    return {s: int(p * unit) for s, p in parts.items()}


def turns(parts: Sequence[int], done: list[int]) -> Iterator[int]:
    """The source of one slot after another, for ever, once source i has had done[i] blocks (kept up to date): earliest deadline
    first among the blocks released; ties by the place of the source."""
    total, t = sum(parts), sum(done)
    waiting = [(n * total // a, i) for i, (n, a) in enumerate(zip(done, parts, strict=True))]  # (release, source) of each source's next block
    heapq.heapify(waiting)
    ready: list = []
    while True:
        while waiting and waiting[0][0] <= t:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[i] + 1) * total // parts[i]), i))
        _, i = heapq.heappop(ready)
        done[i] += 1
        t += 1
        heapq.heappush(waiting, (done[i] * total // parts[i], i))
        yield i


def one_cycle(share: Mapping, cycle: int) -> dict:
    """The slots of each source in a cycle, by turns(), of shares that add up to `cycle`."""
    names = sorted(share, key=lambda s: (s is not None, str(s)))
    slots: dict = {s: [] for s in names}
    for t, i in zip(range(cycle), turns([share[s] for s in names], [0] * len(names)), strict=False):
        slots[names[i]].append(t)
    return slots


def plan(blocks: Sequence[int], parts: Sequence[int], stretch: int) -> tuple[list[tuple], list[int]]:
    """The stretches of at most `stretch` slots, as STRETCH says, and the slot of each source's last block.

    Sources have at least one block; those with parts 0 come after all others, in equal parts.
    """
    out: list[tuple] = []
    last, had, base = [0] * len(blocks), [0] * len(blocks), 0
    while left := [i for i, n in enumerate(blocks) if had[i] < n]:
        who = [i for i in left if parts[i]] or left
        before, done = [had[i] for i in who], [0] * len(who)
        t, begun, ended = 0, 0, False
        state = list(done)
        for k in turns([parts[i] or 1 for i in who], done):
            t += 1
            if ended := before[k] + done[k] == blocks[who[k]]:
                last[who[k]] = base + t - 1
            if ended or t - begun == stretch:
                out.append((base, t - begun, who, before, state))
                begun, state = t, list(done)
            if ended:
                break
        for i, n in zip(who, done, strict=True):
            had[i] += n
        base += t
    return out, last


def slots(rows: DataFrame, parts: Sequence[int], short: Sequence[tuple[int, int]], block_rows: int) -> DataFrame:
    """Each block of the stretches in rows, as PLACED says; short: (slot, rows it lacks) of blocks that aren't full, by slot."""
    at, lacks = [a for a, _ in short], [0, *accumulate(n for _, n in short)]
    fields = [x.split()[0] for x in PLACED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                who, done = r["who"], r["done"]
                own = [parts[i] or 1 for i in who]
                total, t = sum(own), r["base"] + sum(done)
                got = []
                for slot, k in zip(range(t, t + r["n"]), turns(own, done), strict=False):
                    j = done[k] - 1
                    start = slot * block_rows - lacks[bisect_left(at, slot)]
                    got.append((who[k], r["before"][k] + j, slot, r["base"] + j * total // own[k], r["base"] - (-(j + 1) * total // own[k]), start))
                kinds = [pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)], names=fields)

    return rows.mapInArrow(run, PLACED)


def mix(docs: DataFrame, weights: Mapping | None = None, source: str = "source", block_rows: int = 64, temperature: float = 0.5, cycle: int = 1000, seed: int = 11, prefix: str = "") -> DataFrame:
    """All rows and columns of docs plus block (in its source), slot, release and deadline (in slots) and position (gapless).

    weights: by source, in any unit; sources that are missing or have none come after all others. None: rows to the power
    `temperature`. Positions follow the slots; rows of a block lie together; only a source's last block may be short. release
    and deadline are those of the block's phase. A null source is a source of its own; repeated rows stay; an empty table
    gives an empty result. The driver walks a slot for each block and holds a number or two for each source and stretch of
    `cycle` slots: sources are counted, not their rows. The added columns' names begin with `prefix`.
    """
    out = {c: prefix + c for c in ("block", "slot", "release", "deadline", "position")}
    taken = set(out.values()) & set(docs.columns)
    if taken:
        raise ValueError(f"docs already has {sorted(taken)}")
    spark = docs.sparkSession
    importable(spark)
    counts = {r[0]: r[1] for r in docs.groupBy(source).count().collect()}
    names = sorted(counts, key=lambda s: (s is not None, str(s)))
    if weights is None:
        weights = {s: n**temperature for s, n in counts.items()}
    exact = whole({s: w for s in names if (w := weights.get(s, 0)) > 0})
    parts = [exact.get(s, 0) for s in names]
    blocks = [-(-counts[s] // block_rows) for s in names]
    stretches, last = plan(blocks, parts, max(cycle, 10 * len(names)))
    short = sorted((t, -counts[s] % block_rows) for s, t in zip(names, last, strict=True) if counts[s] % block_rows)
    total = sum(counts.values())
    tasks = max(1, min(len(stretches), 4 * spark.sparkContext.defaultParallelism))
    steps = slots(spark.createDataFrame(spark.sparkContext.parallelize(stretches, tasks), STRETCH), parts, short, block_rows)
    known = spark.createDataFrame(list(enumerate(names)), f"who int, {PRE}source {docs.schema[source].dataType.simpleString()}")
    steps = steps.join(sized(known, len(names), 100), "who").withColumnsRenamed({c: f"{PRE}{c}" for c in ("block", "slot", "release", "deadline", "start")})
    plain = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    key = F.xxhash64(F.lit(seed), *plain)
    placed = ranked(docs, [source], key, f"{PRE}rank", buckets_for(total, 8_000)).withColumn(f"{PRE}at", F.floor(F.col(f"{PRE}rank") / block_rows))
    joined = placed.join(sized(steps, sum(blocks), 100), F.col(source).eqNullSafe(F.col(f"{PRE}source")) & (F.col(f"{PRE}at") == F.col(f"{PRE}block")), "left")
    return joined.select(
        *docs.columns,
        F.col(f"{PRE}at").alias(out["block"]),
        *[F.col(f"{PRE}{c}").alias(out[c]) for c in ("slot", "release", "deadline")],
        (F.col(f"{PRE}start") + F.col(f"{PRE}rank") % block_rows).alias(out["position"]),
    )


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return mix(docs).drop("lang", "text")


def mixed(docs: DataFrame) -> DataFrame:
    """docs in the order of the mix: file by file and row by row, once written; with their own columns, whatever these are called.

    A null source is a source of its own, repeated rows stay, an empty table gives none; rows of a source that equal one another
    may change places.
    """
    order, position = mix(docs, prefix=f"{PRE}mix_"), f"{PRE}mix_position"
    return order.repartitionByRange(position).sortWithinPartitions(position).select(*docs.columns)
