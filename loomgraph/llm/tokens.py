"""Token-ID output (op3): raw id payloads in blocks, and a minimal perfect hash index from document keys to places in them.

A corpus is four Parquet tables under one path of the shared store, written and read by Spark alone, so that any store will do:

* payload: (shard, block, doc_ids, lengths, n_docs, n_ids, raw) with blocks in ascending key order; `raw` holds the ids of the
  block's documents one after another as little-endian unsigned 32-bit integers.
* shards: (shard, n_ids, n_docs) for the ids before each shard.
* meta: the number of buckets of the index.
* index: (bucket, n, seeds, prints, places): in each bucket of keys a minimal perfect hash function (hash and displace: `seeds`
  has one displacement for each group of about four keys). Key k has slot f(k) in 0..n-1; prints[slot] is a 32-bit fingerprint
  that tells most absent keys, places[slot] is (shard, block, position in the block, first id in the shard, ids).

A lookup takes a bucket, one displacement, one slot: constant time, and no key is stored in the index. `fetch` and `fetch_one` cut
the ids of keys from the payload by their places; Spark skips the row groups of other shards, blocks and buckets.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PRE, materialise, shared_dir, sized, table
from .textbytes import hashes, mix, release, steps, texts

#: Ids of a payload block after which the next one begins, and keys of an index bucket on average.
BLOCK_IDS, BUCKET_KEYS = 1 << 18, 1024
PLACE = np.dtype([("shard", "<i4"), ("block", "<i4"), ("pos", "<i4"), ("start", "<i8"), ("n", "<i8")])
#: Different pieces and ids that a Python worker keeps at most; beyond either it begins anew.
PIECES, POOL = 1 << 19, 1 << 22
#: Pieces that are encoded as one text.
TOGETHER = 512
#: What the fast path knows, as the tokenizer's file says it. Other normalizers, pre-tokenizers and models get whole texts.
KNOWN_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
KNOWN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Classes of bytes: 0 white space, 1 letters (with the two-byte letters of Latin-1), 2 digits, 3 signs, 4 all else. A word (what
#: lies between white space) with a byte of class 4 is one piece; others are cut into runs of letters, digits and runs of signs.
CLASSES = np.full(256, 4, np.uint8)
CLASSES[33:127] = 3
CLASSES[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = 1
CLASSES[48:58] = 2
CLASSES[[9, 10, 11, 12, 13, 32]] = 0
CLASSES[[39, 124]] = 4  # an apostrophe may begin a suffix, a bar belongs to control strings
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32


def pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with small letters where pieces are cut, starts, ends, whether a piece was cut from a word, number up to each text)."""
    n = len(data)
    kind = CLASSES[data]
    lead = np.flatnonzero(data == 0xC3)
    second = data[np.minimum(lead + 1, n - 1)]
    kind[lead[(second == 0x97) | (second == 0xB7)]] = 4  # the two signs among them
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new |= kind == 2
    first = off[:-1][off[:-1] < n]
    new[first] = True
    odd = np.flatnonzero(kind == 4)
    whole = np.zeros(n + 1, np.int8)
    if len(odd):
        blank = kind == 0
        edge = np.empty(n, bool)
        edge[0] = True
        np.not_equal(blank[1:], blank[:-1], out=edge[1:])
        edge[first] = True
        at = np.flatnonzero(edge)
        word = np.unique(np.searchsorted(at, odd, "right") - 1)
        lo, hi = at[word], np.append(at, n)[word + 1]
        whole[lo] += 1
        whole[hi] -= 1
        whole = np.cumsum(whole, dtype=np.int8)
        new[whole[:-1] > 0] = False
        new[lo] = True
    at = np.flatnonzero(new)
    ends = np.append(at[1:], n)
    solid = kind[at] != 0
    starts, ends = at[solid], ends[solid]
    cut = whole[starts] == 0
    low = SMALL[data]
    upper = lead[(second >= 0x80) & (second <= 0x9E)] + 1
    low[upper] += 32
    if len(odd):
        low = np.where(whole[:-1] > 0, data, low)
    return low, starts, ends, cut, np.searchsorted(starts, off)


class Known:
    """Ids by piece: an open hash table of numpy arrays, keyed by a 64-bit hash and checked by length and outer bytes."""

    def __init__(self):
        self.keys, self.checks = np.zeros(2 * PIECES, np.uint64), np.zeros(2 * PIECES, np.uint32)
        self.at, self.n = np.zeros(2 * PIECES, np.int32), np.zeros(2 * PIECES, np.int32)
        self.pool, self.used, self.held = np.zeros(1 << 16, np.uint32), 1, 0  # the first place is for the end id

    def room(self, n: int) -> None:
        while self.used + n > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])

    def find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The slot of each piece, or -1."""
        mask = len(self.keys) - 1
        out, live, slot = np.full(len(h), -1), np.arange(len(h)), (h & np.uint64(mask)).astype(np.int64)
        while len(live):
            k = self.keys[slot]
            hit = (k == h[live]) & (self.checks[slot] == check[live])
            out[live[hit]] = slot[hit]
            on = ~hit & (k != 0)
            live, slot = live[on], (slot[on] + 1) & mask
        return out

    def add(self, h: np.ndarray, check: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """New pieces, each once; ids: theirs one after another, n: how many each has."""
        self.room(len(ids))
        self.pool[self.used : self.used + len(ids)] = ids
        begin = self.used + np.cumsum(n) - n
        self.used, self.held = self.used + len(ids), self.held + len(h)
        mask = len(self.keys) - 1
        live, slot = np.arange(len(h)), (h & np.uint64(mask)).astype(np.int64)
        while len(live):
            free = self.keys[slot] == 0
            _, one = np.unique(slot[free], return_index=True)
            take = np.flatnonzero(free)[one]
            s, x = slot[take], live[take]
            self.keys[s], self.checks[s], self.at[s], self.n[s] = h[x], check[x], begin[x], n[x]
            rest = np.ones(len(live), bool)
            rest[take] = False
            live, slot = live[rest], (slot[rest] + 1) & mask


class Encoder:
    """Ids of whole texts, the same as the library's encode(text, add_special_tokens=False).

    A tokenizer whose file has the normalizer, split and word ends named above parts every text at white space, and words of
    plain letters, digits and signs as `pieces` does; so a text's ids are those of its pieces in a row, and each different
    piece goes to the library once while it is kept. Many pieces go in one call and are told apart by the ids that end a word;
    where their number isn't as expected each goes by itself, as do words with any other sign. All other tokenizers, and texts
    with separators that only some take as space, are encoded by the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs side by side; idle library threads only spin
        from tokenizers import Tokenizer

        self.tok, self.known = Tokenizer.from_file(path), None
        parts = json.loads(self.tok.to_str())
        vocabulary, suffix = self.tok.get_vocab(), parts["model"].get("end_of_word_suffix")
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that end a word
        if suffix:
            self.last[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        norm, pre = parts.get("normalizer") or {}, parts.get("pre_tokenizer") or {}
        split, level = [*(pre.get("pretokenizers") or []), {}, {}][:2]
        plain = all("<|" in t["content"] and not any(c.isspace() for c in t["content"]) for t in parts.get("added_tokens", []))
        self.fast = bool(
            suffix and plain and parts["model"].get("type") == "BPE" and not parts["model"].get("dropout") and not parts.get("truncation") and not parts.get("padding")
            and norm.get("normalizers") == KNOWN_NORMALIZER and split.get("pattern") == {"Regex": KNOWN_SPLIT} and split.get("behavior") == "Removed" and split.get("invert") is True
            and level.get("type") == "ByteLevel" and not level.get("add_prefix_space") and not level.get("use_regex") and len(pre.get("pretokenizers") or []) == 2
        )

    def whole(self, own: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tok.encode_batch_fast(own, add_special_tokens=False)]
        return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)

    def learn(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, cut: np.ndarray, h: np.ndarray, check: np.ndarray) -> None:
        each: list[int] = []
        plain = np.flatnonzero(cut)
        for i in range(0, len(plain), 16 * TOGETHER):
            parts = [plain[j : j + TOGETHER] for j in range(i, min(i + 16 * TOGETHER, len(plain)), TOGETHER)]
            lines = []
            for p in parts:
                size = ends[p] - starts[p] + 1
                from_ = np.repeat(starts[p] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                line = low[np.minimum(from_, len(low) - 1)]
                line[np.cumsum(size) - 1] = 32
                lines.append(line.tobytes().decode())
            for p, e in zip(parts, self.tok.encode_batch_fast(lines, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                stops = np.flatnonzero(self.last[ids]) + 1
                if len(stops) != len(p) or (len(stops) and stops[-1] != len(ids)):
                    each += p.tolist()
                    continue
                self.known.add(h[p], check[p], ids, np.diff(stops, prepend=0))
        each += np.flatnonzero(~cut).tolist()
        for i in range(0, len(each), 16 * TOGETHER):
            p = each[i : i + 16 * TOGETHER]
            ids, n = self.whole([low[starts[x] : ends[x]].tobytes().decode() for x in p])
            self.known.add(h[p], check[p], ids, n)

    def encode(self, data: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts one after another, how many each has), each text's ids with end_id after them."""
        if not self.fast or not len(data) or (np.bitwise_and(data, 0xFC) == 0x1C).any():  # 0x1C to 0x1F: space to some
            own = [data[x:y].tobytes().decode() for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            ids, n = self.whole(own)
            return np.insert(ids, np.cumsum(n), np.uint32(end_id)), n + 1
        if self.known is None or self.known.held > PIECES * 3 // 4 or self.known.used > POOL:
            self.known = Known()
        low, starts, ends, cut, upto = pieces(data, off)
        h = hashes(low, starts, ends) | np.uint64(1)
        check = (np.minimum(ends - starts, 255) << 24 | cut.astype(np.int64) << 23 | (low[starts] & 127).astype(np.int64) << 16 | low[np.minimum(starts + 1, len(low) - 1)].astype(np.int64) << 8 | low[ends - 1]).astype(np.uint32)
        at = self.known.find(h, check)
        gap = np.flatnonzero(at < 0)
        if len(gap):
            _, one = np.unique(h[gap], return_index=True)
            one = np.sort(gap[one])
            if self.known.held + len(one) > PIECES:
                self.known = Known()
                return self.encode_fresh(low, starts, ends, cut, upto, h, check, end_id)
            self.learn(low, starts[one], ends[one], cut[one], h[one], check[one])
            at[gap] = self.known.find(h[gap], check[gap])
        return self.joined(at, h, check, upto, end_id, low, starts, ends)

    def encode_fresh(self, low, starts, ends, cut, upto, h, check, end_id):
        """As encode, after a new beginning; a step with more different pieces than are kept gets a table of its own size."""
        _, one = np.unique(h, return_index=True)
        one = np.sort(one)
        while len(self.known.keys) < 2 * len(one):
            for c in ("keys", "checks", "at", "n"):
                setattr(self.known, c, np.concatenate([getattr(self.known, c)] * 2))
        self.learn(low, starts[one], ends[one], cut[one], h[one], check[one])
        return self.joined(self.known.find(h, check), h, check, upto, end_id, low, starts, ends)

    def joined(self, at, h, check, upto, end_id, low, starts, ends):
        k = self.known
        first, n = k.at[at].astype(np.int64), k.n[at].astype(np.int64)
        lost = np.flatnonzero(at < 0)  # pieces with the hash of another one of this step: not kept
        if len(lost):
            extra, m = self.whole([low[x:y].tobytes().decode() for x, y in zip(starts[lost].tolist(), ends[lost].tolist(), strict=True)])
            k.room(len(extra))
            k.pool[k.used : k.used + len(extra)] = extra
            first[lost], n[lost] = k.used + np.cumsum(m) - m, m
        k.pool[0] = end_id
        first, n = np.insert(first, upto[1:], 0), np.insert(n, upto[1:], 1)
        to = np.cumsum(n)
        ids = k.pool[np.repeat(first - (to - n), n) + np.arange(to[-1])]
        return ids, np.diff(to[upto[1:] + np.arange(len(upto) - 1)], prepend=0)


@lru_cache(2)
def encoder_of(path: str) -> Encoder:
    """One for each file and Python worker; the pieces met go when a task ends."""
    return Encoder(path)


def _blocks(path: str, end_id: int, key: str, text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The documents of a task (one shard) as rows of about BLOCK_IDS ids."""
    kinds = {"shard": pa.int32(), "block": pa.int32(), "doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "n_docs": pa.int64(), "n_ids": pa.int64(), "raw": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        keys: list[pa.Array] = []
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        block = shard = 0

        def out() -> pa.RecordBatch:
            n = np.concatenate(counts)
            row = [shard, block, pa.concat_arrays(keys).to_pylist(), n.tolist(), len(n), int(n.sum()), np.concatenate(held).astype("<u4").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds.values(), strict=True)], names=list(kinds))

        for b in batches:
            if not b.num_rows:
                continue
            ids, shard = b.column(b.schema.get_field_index(key)), b.column(b.schema.get_field_index(f"{PRE}shard"))[0].as_py()
            for i, _, data, off in steps(*texts(b.column(b.schema.get_field_index(text)))):
                got, n = encoder.encode(data, off, end_id)
                lo, at = 0, np.concatenate([[0], np.cumsum(n)])
                while lo < len(n):
                    room = BLOCK_IDS - sum(len(x) for x in held)
                    hi = max(lo + 1, int(np.searchsorted(at, at[lo] + room, "right")) - 1)
                    keys.append(ids.slice(i + lo, hi - lo))
                    held.append(got[at[lo] : at[hi]])
                    counts.append(n[lo:hi])
                    lo = hi
                    if sum(len(x) for x in held) >= BLOCK_IDS or lo < len(n):
                        yield out()
                        block, keys, held, counts = block + 1, [], [], []
        encoder.known = None  # idle workers would hold them
        if held:
            yield out()
        held = []
        release()

    return run


def _hash(keys: np.ndarray, seed) -> np.ndarray:
    return mix(keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(np.atleast_1d(np.asarray(seed, np.uint64)) + np.uint64(1)))


def perfect_hash(keys: np.ndarray) -> np.ndarray:
    """Displacements for distinct int64 keys: groups of about four keys, largest first, each takes the first displacement
    under which its keys fall on free slots."""
    n = len(keys)
    groups = max(1, -(-n // 4))
    of = (_hash(keys, 0) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[order], np.arange(groups + 1))
    seeds, taken = np.zeros(groups, "<u4"), np.zeros(n, bool)
    for g in np.argsort(-np.diff(ends), kind="stable"):
        own = keys[order[ends[g] : ends[g + 1]]]
        if not len(own):
            break
        seed = 1
        while True:
            tries = np.arange(seed, seed + 64)
            slots = (_hash(own[None, :], tries[:, None]) % np.uint64(n)).astype(np.int64)
            fine = ~taken[slots].any(1)
            if len(own) > 1:
                s = np.sort(slots, 1)
                fine &= (s[:, 1:] != s[:, :-1]).all(1)
            if fine.any():
                k = int(np.argmax(fine))
                seeds[g] = tries[k]
                taken[slots[k]] = True
                break
            seed += 64
    return seeds


def slots_of(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    own = seeds[(_hash(keys, 0) % np.uint64(len(seeds))).astype(np.int64)]
    return (_hash(keys, own) % np.uint64(n)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 1 << 40) >> np.uint64(32)).astype("<u4")


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_hash(keys, 2 << 40) % np.uint64(buckets)).astype(np.int32)


def write_corpus(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2, order: list | None = None, rows_each: int = 20_000) -> None:
    """Encode docs and write payload, shards, meta and index under path.

    Documents lie in the order of `order` (columns; None: the key), nulls first. Null texts are empty. A null key is written and
    isn't in the index; documents with equal keys are all written, and a lookup finds the first of them.
    """
    spark, n = docs.sparkSession, docs.count()
    by = order or [F.col(key)]
    shards = max(1, -(-n // rows_each))
    kept = docs.select(F.col(key).cast("long").alias(key), text, *[c.alias(f"{PRE}o{i}") for i, c in enumerate(by)])
    sort = [f"{PRE}o{i}" for i in range(len(by))]
    # among equal keys the texts' hashes part the rows, so that one key isn't one task
    sort = [*sort, F.xxhash64(text)]
    placed = kept.repartitionByRange(shards, *sort).sortWithinPartitions(*sort).withColumn(f"{PRE}shard", F.spark_partition_id())
    schema = "shard int, block int, doc_ids array<bigint>, lengths array<bigint>, n_docs long, n_ids long, raw binary"
    placed.select(key, text, f"{PRE}shard").mapInArrow(_blocks(tokenizer, end_id, key, text), schema).write.option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(f"{path}/payload")
    payload = spark.read.schema(schema).parquet(f"{path}/payload")
    payload.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"), F.sum("n_docs").alias("n_docs")).write.parquet(f"{path}/shards")
    starts = payload.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("block", "n_ids"))).alias("b"))
    before = starts.select("shard", "b", F.posexplode("b").alias("p", "x")).select(
        "shard", F.col("x.block").alias("block"), F.expr("aggregate(slice(b, 1, p), 0L, (a, y) -> a + y.n_ids)").alias("before")
    )
    buckets = max(1, -(-n // BUCKET_KEYS))
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/meta")

    def places(batches):
        for b in batches:
            ids, lengths = b.column(2), b.column(3)
            for row, (shard, block, first) in enumerate(zip(*(b.column(i).to_pylist() for i in (0, 1, 4)), strict=True)):
                k, m = ids[row].values, lengths[row].values.to_numpy()
                at = first + np.cumsum(m) - m
                real = np.flatnonzero(k.is_valid().to_numpy(zero_copy_only=False))
                own = k.drop_null().to_numpy()
                cols = [pa.array(bucket_of(own, buckets)), pa.array(own), pa.array(np.full(len(own), shard, np.int32)), pa.array(np.full(len(own), block, np.int32)), pa.array(real.astype(np.int32)), pa.array(at[real]), pa.array(m[real])]
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "key", "shard", "block", "pos", "start", "n"])

    def build(pdf):
        import pandas as pd

        keys = pdf.key.to_numpy()
        seeds = perfect_hash(keys)
        at = slots_of(keys, seeds, len(keys))
        prints, put = np.zeros(len(keys), "<u4"), np.zeros(len(keys), PLACE)
        prints[at] = fingerprints(keys)
        for c in PLACE.names:
            put[c][at] = pdf[c].to_numpy()
        return pd.DataFrame([{"bucket": int(pdf.bucket.iloc[0]), "n": len(keys), "seeds": seeds.tobytes(), "prints": prints.tobytes(), "places": put.tobytes()}])

    first = payload.select("shard", "block", "doc_ids", "lengths").join(before, ["shard", "block"])
    rows = first.mapInArrow(places, "bucket int, key long, shard int, block int, pos int, start long, n long")
    once = rows.groupBy("bucket", "key").agg(F.min(F.struct("shard", "block", "pos", "start", "n")).alias("x")).select("bucket", "key", "x.*")
    built = once.groupBy("bucket").applyInPandas(build, "bucket int, n long, seeds binary, prints binary, places binary")
    # in the order of the buckets, so that a lookup of few keys skips files and row groups
    built.write.option("parquet.block.size", 4 << 20).parquet(f"{path}/index")


def buckets_of(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/meta").first()[0]


def _place(row, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the keys the index row of their bucket has, their places): a displacement, a slot, a fingerprint for each."""
    at = slots_of(keys, np.frombuffer(row.seeds, "<u4"), int(row.n))
    fine = np.frombuffer(row.prints, "<u4")[at] == fingerprints(keys)
    return fine, np.frombuffer(row.places, PLACE)[at[fine]]


def lookup(spark: SparkSession, path: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, shard, block, pos, start in the shard, n) of the keys that the index has, by their fingerprints.

    Keys meet the index's rows in their bucket. An absent key passes its fingerprint once in 2**32; nulls are never found;
    repeated keys are found once.
    """
    index, buckets = spark.read.parquet(f"{path}/index"), buckets_of(spark, path)

    def dealt(batches):
        for b in batches:
            k = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(k, buckets)), pa.array(k)], names=["bucket", key])

    def find(_, asked, rows):
        import pandas as pd

        names = [key, "shard", "block", "pos", "start", "n"]
        if not len(rows) or not len(asked):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in names})
        k = asked[key].to_numpy()
        fine, got = _place(rows.iloc[0], k)
        return pd.DataFrame({key: k[fine]} | {c: got[c] for c in names[1:]})

    once = keys.select(F.col(key).cast("long").alias(key)).filter(F.col(key).isNotNull()).distinct()
    asked = once.mapInArrow(dealt, f"bucket int, {key} long")
    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(find, f"{key} long, shard int, block int, pos int, start long, n long")


def fetch(spark: SparkSession, path: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, raw) of the keys that the index has: raw ids (with the end id) as bytes, cut from the payload.

    The places of a block are gathered (at most its documents) and meet the block; only these blocks' raw ids are read where
    few keys are asked for. A key whose block holds another one there (a false fingerprint) isn't returned.
    """
    payload = spark.read.parquet(f"{path}/payload")
    wanted = materialise(lookup(spark, path, keys, key).groupBy("shard", "block").agg(F.collect_list(F.struct(F.col(key).alias("key"), "pos")).alias("asked")), "wanted")
    few = wanted.select("shard", "block").limit(65).collect()
    if len(few) <= 64:
        cond = F.lit(False)
        for shard, block in few:
            cond = cond | ((F.col("shard") == shard) & (F.col("block") == block))
        payload = payload.filter(cond)

    def cut(batches):
        for b in batches:
            for row in range(b.num_rows):
                asked, ids, lengths = b.column(0)[row].as_py(), b.column(1)[row].values.to_pylist(), b.column(2)[row].values.to_numpy()
                raw, to = memoryview(b.column(3)[row].as_buffer()), np.cumsum(lengths)
                own = [(x["key"], int(lengths[x["pos"]]), bytes(raw[4 * int(to[x["pos"]] - lengths[x["pos"]]) : 4 * int(to[x["pos"]])])) for x in asked if ids[x["pos"]] == x["key"]]
                cols = list(zip(*own, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=[key, "n_tokens", "raw"])

    met = payload.join(sized(wanted, wanted.count(), 32 * 1024), ["shard", "block"]).select("asked", "doc_ids", "lengths", "raw")
    return met.mapInArrow(cut, f"{key} long, n_tokens long, raw binary")


def fetch_one(spark: SparkSession, path: str, key: int) -> np.ndarray | None:
    """The ids of one document, end id included, or None: one row of the index and one block of the payload are read."""
    k = np.array([key], np.int64)
    row = spark.read.parquet(f"{path}/index").filter(F.col("bucket") == int(bucket_of(k, buckets_of(spark, path))[0])).first()
    if row is None:
        return None
    fine, got = _place(row, k)
    if not fine[0]:
        return None
    p = got[0]
    at = F.slice("lengths", 1, int(p["pos"]))
    block = spark.read.parquet(f"{path}/payload").filter((F.col("shard") == int(p["shard"])) & (F.col("block") == int(p["block"])) & (F.element_at("doc_ids", int(p["pos"]) + 1) == key))
    raw = block.select(F.substring("raw", F.lit(4) * F.aggregate(at, F.lit(0).cast("long"), lambda a, x: a + x).cast("int") + 1, F.lit(4 * int(p["n"])))).first()
    return None if raw is None else np.frombuffer(raw[0], "<u4")


def read_corpus(spark: SparkSession, path: str, key: str = "doc_id", digest: bool = False) -> DataFrame:
    """One row a document, from the files: key, shard, block, pos, start (ids before it), n_tokens, raw ids as bytes.

    With digest, ids_crc32 (unsigned) of those bytes instead of them.
    """
    payload = spark.read.parquet(f"{path}/payload")
    shards = spark.read.parquet(f"{path}/shards")
    # one row a shard of about rows_each documents; sums of sums keep any array small
    part = shards.withColumn("part", F.floor(F.col("shard") / 1024))
    sums = part.groupBy("part").agg(F.sum("n_ids").alias("n"))
    totals = sums.orderBy("part").collect()  # one row for each 1024 shards that have any
    starts = [(r[0], s - r[1]) for r, s in zip(totals, accumulate(r[1] for r in totals), strict=True)]
    firsts = sized(spark.createDataFrame(starts, "part long, first long"), len(starts), 16)
    arrays = part.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("shard", "n_ids"))).alias("s"))
    base = arrays.join(firsts, "part").select("first", "s", F.posexplode("s").alias("p", "x")).select(
        F.col("x.shard").alias("shard"),
        (F.expr("aggregate(slice(s, 1, p), 0L, (a, y) -> a + y.n_ids)") + F.col("first")).alias("base"),
    )

    blocks = payload.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("block", "n_ids"))).alias("b"))
    before = blocks.join(base, "shard").select("shard", "base", "b", F.posexplode("b").alias("p", "x")).select(
        F.col("shard"), F.col("x.block").alias("block"), (F.col("base") + F.expr("aggregate(slice(b, 1, p), 0L, (a, y) -> a + y.n_ids)")).alias("first")
    )

    last = ("ids_crc32", pa.int64()) if digest else ("raw", pa.binary())

    def documents(batches):
        for b in batches:
            docs, sizes, raws = b.column(2), b.column(3), b.column(4)
            for row, (shard, block, first) in enumerate(zip(*(b.column(i).to_pylist() for i in (0, 1, 5)), strict=True)):
                k, m = docs[row].values, sizes[row].values.to_numpy()
                to = np.cumsum(m)
                at = to - m
                raw = memoryview(raws[row].as_buffer())
                cut = (raw[4 * x : 4 * y] for x, y in zip(at.tolist(), to.tolist(), strict=True))
                data = [zlib.crc32(x) for x in cut] if digest else [bytes(x) for x in cut]
                cols = [k, pa.array(np.full(len(k), shard, np.int32)), pa.array(np.full(len(k), block, np.int32)), pa.array(np.arange(len(k), dtype=np.int32)), pa.array(first + at), pa.array(m), pa.array(data, last[1])]
                yield pa.RecordBatch.from_arrays(cols, names=[key, "shard", "block", "pos", "start", "n_tokens", last[0]])
        release()

    rows = before.count()
    joined = payload.join(sized(before, rows, 32), ["shard", "block"]).select("shard", "block", "doc_ids", "lengths", "raw", "first")
    return joined.mapInArrow(documents, f"{key} long, shard int, block int, pos int, start long, n_tokens long, {last[0]} {'long' if digest else 'binary'}")


def encoded(spark: SparkSession, docs: DataFrame, order: list | None = None) -> DataFrame:
    """docs written as a corpus in the shared folder and read back: doc_id, start, n_tokens, ids_crc32, shard, block, indexed.

    Every key of docs is looked up; what the index says of its place and length has to agree with the files, else the query
    fails. indexed is false for null keys and for all but the first document of a key.
    """
    import public_tokenizers

    path = f"{shared_dir(spark)}/loomgraph/corpus-{uuid.uuid4().hex}"
    write_corpus(docs, path, public_tokenizers.path("word_bpe_49k.json"), order=order)
    read = read_corpus(spark, path, digest=True)
    found = lookup(spark, path, docs.select("doc_id")).select("doc_id", F.struct("shard", "block", "pos").alias("at"), F.col("n").alias("said"))
    indexed = F.col("at") == F.struct("shard", "block", "pos")
    wrong = (F.col("doc_id").isNotNull() & F.col("at").isNull()) | (indexed & (F.col("said") != F.col("n_tokens")))
    return read.join(found, "doc_id", "left").select(
        "doc_id", "start", F.when(wrong, F.raise_error(F.lit("the index and the files differ"))).otherwise(F.col("n_tokens")).alias("n_tokens"), "ids_crc32", "shard", "block", F.coalesce(indexed, F.lit(False)).alias("indexed")
    )


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
