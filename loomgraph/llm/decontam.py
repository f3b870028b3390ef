"""Benchmark decontamination (op10): greedy string tiling with running Karp-Rabin, after a join of shared-token seeds.

Tokens are runs of letters and digits in small letters. Every document is looked through for seeds: LEAST_MATCH tokens in a
row (their Karp-Rabin hash) that a test item has too. For each document and item that share one, the longest common run of
unmarked tokens is marked in both, again and again, until none of LEAST_MATCH tokens is left; an item's coverage is the share
of its tokens marked. As tiles may lie anywhere, passages in another order are caught too.

The items are taken in blocks of at most BLOCK_BYTES of text; each block is a task-side table of seeds that all documents
are joined with, so a large set of items means more passes and never a larger table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PRE, materialise, sized, table
from .textbytes import LETTERS, ngrams, release, steps, texts, words

#: Tokens of a match at least (an item with fewer tokens has to match whole), and the coverage from which a document counts.
LEAST_MATCH, COVERAGE = 5, 0.5
BLOCK_BYTES = 8 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _windows(h: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of n tokens in a row, from every place."""
    pw = np.cumprod(np.append(np.ones(1, np.uint64), np.full(len(h), _BASE)), dtype=np.uint64)
    inv = np.cumprod(np.append(np.ones(1, np.uint64), np.full(len(h), _BACK)), dtype=np.uint64)
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(h * pw[:-1], dtype=np.uint64))
    return (sums[n:] - sums[:-n]) * inv[: len(h) - n + 1]


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two rows of token hashes: (place in item, place in doc, length), longest first.

    Only tokens of the document that lie in a shared seed can be in a tile. In each round the length of the longest common run
    of unmarked tokens is found by halving, with Karp-Rabin hashes of all places; the runs of this length are marked, those
    first in the document first, each with the first place of the item that no mark overlaps. Space is linear in both rows.
    """
    if min(len(item), len(doc)) < least:
        return []
    hit = np.isin(_windows(doc, least), _windows(item, least))
    begin = np.flatnonzero(hit)
    if not len(begin):
        return []
    near = np.zeros(len(doc) + 1, np.int32)
    np.add.at(near, begin, 1)
    np.add.at(near, begin + least, -1)
    held = np.flatnonzero(np.cumsum(near)[:-1] > 0)
    # stretches of the document one after another, a marked place between them
    gaps = np.flatnonzero(np.diff(held) > 1) + 1
    place = np.insert(held, gaps, -1)
    own = np.where(place < 0, np.uint64(0), doc[place])
    marked = [np.zeros(len(item), bool), place < 0]
    rows = [item, own]
    out: list[tuple[int, int, int]] = []
    most = min(len(item), len(own))

    def free(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        got = []
        for row, m in zip(rows, marked, strict=True):
            if len(row) < n:
                return []
            upto = np.append(0, np.cumsum(m))
            at = np.flatnonzero(upto[n:] == upto[:-n])
            got.append((at, _windows(row, n)[at]))
        return got

    def common(n: int) -> bool:
        got = free(n)
        return bool(got) and bool(np.isin(got[1][1], got[0][1]).any())

    while not marked[0].all() and common(least):
        low, high = least, most
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if common(mid) else (low, mid - 1)
        (at, theirs), (places, hashes) = free(low)
        where: dict[int, list[int]] = defaultdict(list)
        for p, h in zip(at[::-1].tolist(), theirs[::-1].tolist(), strict=True):
            where[h].append(p)
        done = len(out)
        shared = np.isin(hashes, theirs)
        for q, h in zip(places[shared].tolist(), hashes[shared].tolist(), strict=True):
            if marked[1][q : q + low].any():
                continue
            left = where[h]
            while left and marked[0][left[-1] : left[-1] + low].any():
                left.pop()
            if left and (item[left[-1] : left[-1] + low] == own[q : q + low]).all():
                p = left.pop()
                marked[0][p : p + low] = True
                marked[1][q : q + low] = True
                out.append((p, int(place[q]), low))
        if len(out) == done:  # hashes that only looked alike
            break
        most = low
    return out


def _matcher(block: list[tuple[int, str]], least: int, key: str, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, off = texts(pa.array([t for _, t in block], pa.string()))
        _, _, h, upto = words(data, off, LETTERS)
        items = [h[upto[i] : upto[i + 1]] for i in range(len(block))]
        by_size: dict[int, tuple[np.ndarray, ...]] = {}
        for size in sorted({min(least, len(x)) for x in items if len(x)}):
            own = [(i, *np.unique(ngrams(x, np.array([0, len(x)]), size)[0], return_counts=True)) for i, x in enumerate(items) if min(least, len(x)) == size]
            seed = np.concatenate([x for _, x, _ in own])
            of, times = np.repeat([i for i, _, _ in own], [len(x) for _, x, _ in own]), np.concatenate([n for *_, n in own])
            order = np.argsort(seed, kind="stable")
            sieve = np.zeros(1 << 22, bool)
            sieve[seed >> np.uint64(42)] = True
            by_size[size] = seed[order], of[order], times[order], sieve
        tokens = np.array([len(x) for x in items])
        for b in batches:
            ids = b.column(0)
            out = []
            for first, _, d, o in steps(*texts(b.column(1))):
                _, _, h, upto = words(d, o, LETTERS)
                for size, (seed, of, times, sieve) in by_size.items():
                    g, upto_g = ngrams(h, upto, size)
                    at = np.flatnonzero(sieve[g >> np.uint64(42)])
                    lo, hi = np.searchsorted(seed, g[at]), np.searchsorted(seed, g[at], "right")
                    hit = hi > lo
                    at, lo, n = at[hit], lo[hit], (hi - lo)[hit]
                    # each seed of a document once, with all items that have it
                    doc = np.searchsorted(upto_g, at, "right") - 1
                    _, one = np.unique(np.stack([doc, lo]), axis=1, return_index=True) if len(at) else (None, np.zeros(0, np.int64))
                    doc, lo, n = doc[one], lo[one], n[one]
                    entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    pair, back = np.unique(np.repeat(doc, n) * len(items) + of[entry], return_inverse=True)
                    most = size * np.bincount(back, times[entry], len(pair))  # tokens of the item in shared seeds, at most
                    for k, i in (divmod(int(x), len(items)) for x in pair[most >= coverage * tokens[pair % len(items)] - 1e-9]):
                        t = tiles(items[i], h[upto[k] : upto[k + 1]], size)
                        if t:
                            out.append((ids[first + k].as_py(), block[i][0], sum(n for *_, n in t), len(items[i]), t))
            kind = pa.list_(pa.struct([("item_at", pa.int32()), ("doc_at", pa.int32()), ("tokens", pa.int32())]))
            names = [key, "item_id", "covered", "item_tokens", "tiles"]
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), kind]
            cols[4] = [[{"item_at": p, "doc_at": q, "tokens": n} for p, q, n in t] for t in cols[4]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
        release()

    return run


def item_blocks(items: DataFrame, item_key: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about BLOCK_BYTES of text, one block on the driver at a time."""
    own = items.filter(F.col(text).isNotNull() & F.col(item_key).isNotNull()).select(F.col(item_key).cast("long").alias("i"), F.lower(text).alias("t"))
    size = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for k in range(n):
        yield [(r[0], r[1]) for r in own.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).sort("i", "t").collect()]


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", least: int = LEAST_MATCH, coverage: float = 0.0) -> DataFrame:
    """(key, item_id, covered, item_tokens, tiles) of each document and item with a tile. Keys and items' keys are longs.

    Pairs whose shared seeds can't cover `coverage` of the item's tokens are left out without tiling. Null keys, null or empty texts and items give nothing; repeated rows give repeated rows; other columns are ignored.
    """
    own = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias(key), F.lower(text).alias("text"))
    tile = "array<struct<item_at int, doc_at int, tokens int>>"
    schema = f"{key} long, item_id long, covered long, item_tokens long, tiles {tile}"
    found = None
    for block in item_blocks(items, item_key, text):
        part = own.mapInArrow(_matcher(block, least, key, coverage), schema)
        found = part if found is None else found.union(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, key: str = "doc_id") -> DataFrame:
    """A row for each key with an item covered to `coverage` or more: its best item (ties: least id), coverage, tiles, items."""
    hits = matches(docs, items, key, coverage=coverage).withColumn("coverage", F.col("covered") / F.col("item_tokens")).filter(F.col("coverage") >= coverage)
    return hits.groupBy(key).agg(F.max_by(F.struct("item_id", "coverage", F.size("tiles").alias("n_tiles")), F.struct("coverage", -F.col("item_id"))).alias("x"), F.count_distinct("item_id").alias("n_items")).select(key, "x.*", "n_items")


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = materialise(contaminated(docs, table(spark, sf_dir, "benchmark")), "hits")
    hit = found.withColumnRenamed("doc_id", f"{PRE}id")
    out = docs.select("doc_id").join(sized(hit, found.count(), 64), F.col("doc_id") == F.col(f"{PRE}id"), "left")
    return out.select("doc_id", F.col("item_id").isNotNull().alias("contaminated"), "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), "n_tiles", F.coalesce("n_items", F.lit(0)).alias("n_items"))


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without the contaminated ones; rows without a key stay."""
    gone = materialise(contaminated(docs, items, key=key).select(F.col(key).alias(f"{PRE}gone")), "gone")
    return docs.join(sized(gone, gone.count(), 16), docs[key] == F.col(f"{PRE}gone"), "left_anti")
