"""Sharding (op1): a uniform shuffle with exact shard sizes, by a hypergeometric communication matrix. DataFrame functions only.

Rows lie in P blocks (by a hash). How many rows of block p go to cell v is drawn beforehand for all (p, v), as a uniform
shuffle would deal them: row by row of the matrix, multivariate hypergeometric. Then each block is permuted, its first
rows go to cell 0, the next to cell 1 and so on (the exchange), and each cell is permuted again. Cells are the shards, each
cut into equal parts where it is large; as cell sizes are fixed beforehand, a row's slot is its cell's offset plus its rank.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PRE, ranked, table

#: Cells of the communication matrix at most; it is planned on the driver.
MATRIX_CELLS = 200_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` rows taken without putting back are good; exact inversion, outward from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low >= high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma

    def choose(n: int, k: int) -> float:
        return lg(n + 1) - lg(k + 1) - lg(n - k + 1)

    at = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u = rng.random() - at
    up = down = at
    i = j = mode
    while u > 0 and (i < high or j > low):
        if i < high:
            up *= (good - i) * (draws - i) / ((i + 1) * (bad - draws + i + 1))
            i += 1
            u -= up
            if u <= 0:
                return i
        if j > low:
            down *= j * (bad - draws + j) / ((good - j + 1) * (draws - j + 1))
            j -= 1
            u -= down
            if u <= 0:
                return j
    return mode


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """Counts with these row and column sums (equal totals), distributed as a uniform shuffle distributes them."""
    rng, left, out = random.Random(seed), list(columns), []
    for n in rows:
        rest, row = sum(left), []
        for v, c in enumerate(left):
            x = hypergeometric(rng, c, rest - c, n)
            row.append(x)
            rest -= c
            n -= x
            left[v] -= x
        out.append(row)
    return out


def _parts(n: int, k: int) -> list[int]:
    return [n // k + (i < n % k) for i in range(k)]


def shard_documents(docs: DataFrame, shards: int, seed: int = 7, rows_each: int = 20_000) -> DataFrame:
    """All columns of docs plus shard (int, from 0) and slot (long, gapless from 0 in each shard).

    Shard sizes differ by one row at most, whatever the keys are, and every arrangement is equally likely (up to the hash).
    Nulls and empty texts are rows like others; of rows that are equal in all columns it is undefined which is which; an
    empty table gives an empty result. Blocks and cells have about rows_each rows until MATRIX_CELLS bounds their number;
    then larger ones are ranked in parts, by many tasks.
    """
    taken = {f"{PRE}block", f"{PRE}cell", f"{PRE}local", "shard", "slot"} & set(docs.columns)
    if taken:
        raise ValueError(f"docs already has {sorted(taken)}")
    plain = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    n = docs.count()
    most = math.isqrt(MATRIX_CELLS)
    blocks = max(1, min(most, math.ceil(n / rows_each)))
    parts = max(1, min(MATRIX_CELLS // (blocks * shards), math.ceil(n / shards / rows_each)))
    parts_in_block, parts_in_cell = (max(1, math.ceil(n / x / (4 * rows_each))) for x in (blocks, shards * parts))
    block = F.pmod(F.xxhash64(*plain, F.lit(seed)), F.lit(blocks)).cast("int")
    keyed = docs.withColumn(f"{PRE}block", block)
    counts = {r[0]: r[1] for r in keyed.groupBy(f"{PRE}block").count().collect()}  # at most `blocks` rows
    cells = [x for s in _parts(n, shards) for x in _parts(s, parts)]
    matrix = communication_matrix([counts.get(p, 0) for p in range(blocks)], cells, seed)
    ends = [[sum(row[: v + 1]) for v in range(len(row))] for row in matrix]
    starts = [sum(cells[v - v % parts : v]) for v in range(len(cells))]

    def constant(x: list, kind: str):
        return F.from_json(F.lit(json.dumps(x)), kind)

    local = ranked(keyed, [f"{PRE}block"], F.xxhash64(F.lit(seed + 1), *plain), f"{PRE}local", parts_in_block)
    own = F.element_at(constant(ends, "array<array<bigint>>"), F.col(f"{PRE}block") + 1)
    cell = F.size(F.filter(own, lambda e: e <= F.col(f"{PRE}local")))
    dealt = local.withColumn(f"{PRE}cell", cell).drop(f"{PRE}block", f"{PRE}local")
    placed = ranked(dealt, [f"{PRE}cell"], F.xxhash64(F.lit(seed + 2), *plain), "slot", parts_in_cell)
    start = F.element_at(constant(starts, "array<bigint>"), F.col(f"{PRE}cell") + 1)
    return placed.select(
        *docs.columns, F.floor(F.col(f"{PRE}cell") / parts).cast("int").alias("shard"), (F.col("slot") + start).alias("slot")
    )


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), 24)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return placed.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
