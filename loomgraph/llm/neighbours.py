"""Approximate nearest neighbours (op9): a permutation index.

A vector is represented by its PREFIX nearest pivots, nearest first. Vectors are posted in inverted files from each pivot of
their prefix to (vector, place in the prefix); a query reads the files of its own prefix and ranks the vectors it meets by
Spearman's footrule (a pivot that a prefix lacks stands after its end); the best SHARE of a block's vectors is ranked again by
the cosine of the original vectors, in double precision.

The index is cut into groups by the vectors' nearest pivots, and a group into blocks of bounded size, each with its own
inverted files; so a hot pivot is many tasks. Of a dense group all vectors with a small footrule are ranked again, however many. With `visited` a query only goes to the groups of its first pivots: right
where vectors lie in tight clusters. By default it goes to all, since in data without clusters neighbours share few of their
first pivots (on 10,256 vectors of the test tables, which are spread evenly over 64 dimensions, a recall of 0.9 takes 40 % of all
vectors whatever is posted and visited): the work then is queries times vectors, block by block, of small integers. Queries that
find fewer vectors than asked for are compared with all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, sized, table

PIVOTS, PREFIX, SHARE, LEAST_CANDIDATES = 256, 128, 0.08, 256
#: Vectors whose footrule is under this share of the greatest are ranked again however many they are (dense groups).
NEAR = 0.5
#: The cosine of two pivots is under this: a dense group gives one pivot, not many.
APART = 0.8
#: Vectors from which pivots are taken at most, and vectors and queries of a task.
PIVOT_SAMPLE, VECTOR_BLOCK, QUERY_BLOCK = 16_384, 16_384, 1024


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) with v array<double>: not null, not empty, all finite, not all zero; null ids are left out."""
    v = F.col(vector).cast("array<double>")
    own = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.filter(F.col("v").isNotNull() & (F.size("v") > 0) & fine & F.exists("v", lambda x: x != 0))


def scaled(v: np.ndarray) -> np.ndarray:
    """Each row times a power of two, which brings its largest component near one: squares neither overflow nor vanish, and
    nothing is rounded."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def dots(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Products of the rows with q, each summed by itself in one order: equal rows have equal results."""
    return (v * q).sum(1)


def unit(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.sqrt(dots(v, v))[:, None]


def pivots_of(vectors: DataFrame, n: int, most: int) -> np.ndarray:
    """At most `most` vectors of a sample that lie apart, drawn by the hashes of their ids."""
    share = min(1_000_000, math.ceil(PIVOT_SAMPLE / max(1, n) * 1_000_000))
    rows = vectors.filter(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1_000_000)) < share).limit(2 * PIVOT_SAMPLE).collect()
    v = np.array([r[1] for r in sorted(rows, key=lambda r: r[0])])
    if not len(v):
        return v
    v = np.unique(unit(v), axis=0)
    v = v[np.random.default_rng(3).permutation(len(v))]
    kept: list[int] = []
    for i in range(len(v)):
        if len(kept) < most and (not kept or (v[kept] @ v[i]).max() < APART):
            kept.append(i)
    return v[kept]


def permutations(pivots: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = min(PREFIX, len(pivots))
        for f in frames:
            if len(f):
                near = -(unit(np.stack(f.v.to_numpy())) @ pivots.T)
                top = np.argpartition(near, k - 1, 1)[:, :k]
                order = np.argsort(np.take_along_axis(near, top, 1), 1, kind="stable")
                yield f.assign(prefix=list(np.take_along_axis(top, order, 1).astype(np.int32)))

    return run


def search_block(q: pd.DataFrame, v: pd.DataFrame, most: int) -> pd.DataFrame:
    """The `most` nearest of v for each row of q, among the SHARE nearest by footrule."""
    names = ["query_id", "vec_id", "score"]
    if not len(q) or not len(v):
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    v = v.sort_values("id", kind="stable")
    ids, vecs, prefix = v.id.to_numpy(), scaled(np.stack(v.v.to_numpy())), np.stack(v.prefix.to_numpy())
    norms = np.sqrt(dots(vecs, vecs))
    k, c = prefix.shape[1], max(LEAST_CANDIDATES, most + 1, math.ceil(SHARE * len(ids)))
    # the inverted file of a pivot: of each vector how far before the prefix's end the pivot stands (0: not in the prefix)
    files = np.zeros((int(max(prefix.max(), np.stack(q.prefix.to_numpy()).max())) + 1, len(ids)), np.uint16)
    files[prefix, np.arange(len(ids))[:, None]] = k - np.arange(k, dtype=np.uint16)
    out = []
    shared = np.empty(len(ids), np.uint16)
    for qid, own, qp in zip(q.id.to_numpy(), scaled(np.stack(q.v.to_numpy())), q.prefix.to_numpy(), strict=True):
        # half the footrule less what all have: a pivot in both prefixes saves the shorter of its distances from the end
        saved = np.zeros(len(ids), np.int32)
        for j, p in enumerate(qp):
            np.minimum(files[p], np.uint16(k - j), out=shared)
            saved += shared
        saved[ids == qid] = -1
        if len(ids) > c:
            least = np.partition(saved, len(ids) - c)[len(ids) - c]
            over = np.flatnonzero(saved > least)
            at = np.concatenate([over, np.flatnonzero(saved == least)[: c - len(over)]])  # ids ascend
            if 2 * least > (1 - NEAR) * k * (k + 1):
                at = np.flatnonzero(2 * saved > (1 - NEAR) * k * (k + 1))
        else:
            at = np.arange(len(ids))
        at = at[ids[at] != qid]
        score = dots(vecs[at], own) / (norms[at] * np.sqrt(dots(own[None], own)))
        best = np.lexsort((ids[at], -score))[:most]
        out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[at][best], "score": score[best]}))
    return pd.concat(out)[names]


def nearest(df: DataFrame, queries, most: int = 5, key: str = "vec_id", vector: str = "embedding", visited: int | None = None) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the `most` nearest found of each row that `queries` (a condition) holds for.

    Vectors that are null, empty, zero or hold null or non-finite values take no part, nor do null ids. Vectors of different
    lengths have no cosine: each length is a space of its own. Ties go to smaller ids. Rows with one id count as one vector with the best of their scores, and
    never find each other. Other columns are ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    flagged = df.withColumn("_q", F.coalesce(queries, F.lit(False)))
    own = usable(flagged, key, vector)
    asked = usable(flagged.filter("_q"), key, vector)
    sizes = own.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()  # a row for each length of vectors
    found = [_nearest(spark, own.filter(F.size("v") == d), asked.filter(F.size("v") == d), n, most, visited) for d, n in sizes]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = reduce(DataFrame.union, found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranks = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    return ranks.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _nearest(spark: SparkSession, own: DataFrame, asked: DataFrame, n: int, most: int, visited: int | None) -> DataFrame:
    """(query_id, vec_id, score) with the `most` best of each query, of n vectors of one length."""
    result = "query_id long, vec_id long, score double"
    pivots = pivots_of(own, n, max(1, min(PIVOTS, n // 2)))
    if not len(pivots):
        pivots = unit(np.array([own.first()[1]]))
    schema = "id long, v array<double>, prefix array<int>"
    vectors = own.mapInPandas(permutations(pivots), schema)
    asked = asked.mapInPandas(permutations(pivots), schema)
    groups = max(1, min(len(pivots), -(-n // VECTOR_BLOCK)))
    group = lambda x: x % groups
    posted = vectors.withColumn("cell", group(F.col("prefix")[0]))
    first = F.array_distinct(F.transform(F.slice("prefix", 1, visited), group)) if visited else F.sequence(F.lit(0), F.lit(groups - 1))
    visits = asked.select("id", "v", "prefix", F.explode(first).alias("cell"))
    # a row for each group: blocks of its vectors and of its queries
    size_v = posted.groupBy("cell").agg(F.ceil(F.count("*") / VECTOR_BLOCK).cast("int").alias("nv"))
    size_q = visits.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("nq"))
    cells = materialise(size_v.join(size_q, "cell"), "cells")
    cells = sized(cells, len(pivots), 16)
    every = lambda x: F.explode(F.sequence(F.lit(0), F.col(x) - 1))
    salt = lambda x: F.pmod(F.xxhash64("id", F.lit(5)), F.col(x)).cast("int")
    left = visits.join(cells, "cell").select("cell", "id", "v", "prefix", salt("nq").alias("bq"), every("nv").alias("bv"))
    right = posted.join(cells, "cell").select("cell", "id", "v", "prefix", salt("nv").alias("bv"), every("nq").alias("bq"))
    cell = ["cell", "bq", "bv"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(lambda q, v: search_block(q, v, most), result)
    found = materialise(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "found")
    few = asked.select("id").distinct().join(found.groupBy(F.col("query_id").alias("id")).count().filter(F.col("count") >= min(most, n - 1)), "id", "left_anti")
    few = materialise(few, "few")
    parts = -(-few.count() // QUERY_BLOCK)
    for p in range(parts):
        block = few.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == p).join(asked.select("id", "v"), "id").collect()  # about QUERY_BLOCK
        found = found.union(own.mapInPandas(_brute([(r[0], np.array(r[1])) for r in block], most), result))
    return found


def _brute(block: list[tuple[int, np.ndarray]], most: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            ids, v = f.id.to_numpy(), scaled(np.stack(f.v.to_numpy()))
            norms = np.sqrt(dots(v, v))
            for qid, q in block:
                q = scaled(q[None])[0]
                score = dots(v, q) / (norms * np.sqrt(dots(q[None], q)))
                score[ids == qid] = -np.inf
                best = np.lexsort((ids, -score))[:most]
                best = best[score[best] > -np.inf]
                yield pd.DataFrame({"query_id": qid, "vec_id": ids[best], "score": score[best]})

    return run


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
