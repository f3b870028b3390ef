"""Cross-tokenizer alignment (op11): two tokenizers' tokens over the same bytes, their groups, links and how usual each link is.

The cumulative byte ends of both sides are merged as two pointers would merge them: at each end the side whose token ends moves on.
Each stretch between neighbouring ends lies in one token of either side, so it is one link; where both end, a group ends. This is
done inside mapInArrow, for about a megabyte of texts at a time by array operations.

Documents come in blocks of about BLOCK_BYTES of text. A block sends each different pair once, with the number of its documents
that hold it; Spark sums these by pair, takes each token's highest sum and joins both back to the blocks' pairs. So what is
shuffled grows with blocks times different pairs, not with links, and a pair that all documents hold is one row a block.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, sized, table
from .textbytes import release, steps, texts

BLOCK_BYTES = 16 << 20
#: Ids fit in so many bits; a pair is a << BITS | b, a document's place in a block goes above it.
BITS = 21
#: A text whose bytes are all under this has no character from U+0240 on; below that, letters, digits and white space are the same
#: in every version of Unicode, so both libraries cut it alike.
PLAIN_BYTE = 0xC9
#: Letters, digits or signs in a row from which the library with a queue for merges is taken.
LONG_RUN = 2000


def spread(flat: np.ndarray, begin: np.ndarray, n: np.ndarray, at_once: int = 1 << 18) -> np.ndarray:
    """Stretches of flat, one after another; worked on in parts, so little more than the result is held."""
    out, done = np.empty(int(n.sum()), flat.dtype), 0
    for i in range(0, len(n), at_once):
        b, k = begin[i : i + at_once], n[i : i + at_once]
        total = int(k.sum())
        out[done : done + total] = flat[np.arange(total) + np.repeat(b - (np.cumsum(k) - k), k)]
        done += total
    return out


class Side:
    """A tokenizer: ids of texts, and each id's bytes as a stretch of one array."""

    def __init__(self, token_bytes: list[bytes]):
        self.size = len(token_bytes)
        self.n = np.array([len(x) for x in token_bytes], np.int64)
        self.begin = np.cumsum(self.n) - self.n
        self.flat = np.frombuffer(b"".join(token_bytes), np.uint8)


def byte_letters() -> dict[str, int]:
    """The bytes that byte-level vocabularies write as characters: printable ones as themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel(Side):
    """A byte-level BPE file of the tokenizers library.

    Where the file has no normalizer, the common split and merges in the order of ids, a library that does the same work faster
    encodes texts of plain characters; all else goes to the file's own library.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        special = {x["id"]: x["content"].encode() for x in spec.get("added_tokens", [])}
        known = {i: bytes(letters[c] for c in s) for s, i in vocab.items() if i not in special} | special
        super().__init__([known.get(i, b"") for i in range(max(known) + 1)])
        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        ranked = all(vocab.get(m.replace(" ", "")) == 256 + k for k, m in enumerate(merges))
        plain = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.fast = None
        if plain and ranked and not model.get("dropout") and not model.get("ignore_merges"):
            import tiktoken

            ranks = {b: i for i, b in known.items() if i not in special}
            self.fast = tiktoken.Encoding("aligned", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, parts: list[str], fast: list[bool]) -> list[np.ndarray]:
        out: list = [None] * len(parts)
        slow = [i for i, ok in enumerate(fast) if not ok or not self.fast]
        for i, e in zip(slow, self.own.encode_batch([parts[i] for i in slow], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.int64)
        return [np.array(self.fast.encode_ordinary(p), np.int64) if x is None else x for p, x in zip(parts, out, strict=True)]


class Pieces(Side):
    """A sentencepiece model; it puts the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.own.get_piece_size())
        shown = [self.own.id_to_piece(i) for i in ids]
        super().__init__([bytes([int(s[3:5], 16)]) if self.own.is_byte(i) else b"" if self.own.is_control(i) or self.own.is_unknown(i) else s.replace("▁", " ").encode() for i, s in zip(ids, shown, strict=True)])

    def encode(self, parts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.own.encode(parts, num_threads=1)]


@lru_cache(2)
def sides(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces, np.ndarray]:
    """Both tokenizers, and every id as text with each of three signs after it, padded with zero bytes."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    a, b = ByteLevel(a_path), Pieces(b_path)
    most = max(a.size, b.size)
    return a, b, np.array([f"{i}{s}".encode() for s in ",|;" for i in range(most)])


class Aligned:
    """Some texts' tokens, merged. Arrays over all of them; `*_upto` say how many there are up to each text (one more than texts)."""

    def __init__(self, a: ByteLevel, b: Pieces, data: np.ndarray, off: np.ndarray):
        n = len(off) - 1
        size = np.diff(off)
        raw = data.tobytes()
        parts = [raw[x:y].decode() for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        live = np.flatnonzero(size)
        ids_a, ids_b, good = {}, {}, np.zeros(n, bool)
        if len(live):
            top = np.maximum.reduceat(data, off[live])
            dense = longest_runs(data, off, live)
            plain = ((top < PLAIN_BYTE) & (dense < LONG_RUN)).tolist()
            own = [parts[i] for i in live]
            for i, x, y in zip(live.tolist(), a.encode([f" {p}" for p in own], plain), b.encode(own), strict=True):
                ids_a[i], ids_b[i] = x, y
                good[i] = int(a.n[x].sum()) == size[i] + 1 == int(b.n[y].sum())
        fine = np.flatnonzero(good)
        want = np.frombuffer(b"".join(b" " + raw[off[i] : off[i + 1]] for i in fine), np.uint8)
        bad = np.zeros(len(want), bool)
        for side, ids in ((a, ids_a), (b, ids_b)):
            t = np.concatenate([ids[i] for i in fine]) if len(fine) else np.zeros(0, np.int64)
            bad |= spread(side.flat, side.begin[t], side.n[t]) != want
        if bad.any():
            begin = np.cumsum(size[fine] + 1) - size[fine] - 1
            good[fine[np.logical_or.reduceat(bad, begin)]] = False
            fine = np.flatnonzero(good)
        none = np.zeros(0, np.int64)
        self.a = np.concatenate([none, *[ids_a[i] for i in fine]])
        self.b = np.concatenate([none, *[ids_b[i] for i in fine]])
        self.a_upto = np.concatenate([[0], np.cumsum([len(ids_a[i]) if good[i] else 0 for i in range(n)])]).astype(np.int64)
        self.b_upto = np.concatenate([[0], np.cumsum([len(ids_b[i]) if good[i] else 0 for i in range(n)])]).astype(np.int64)
        ends_a, ends_b = np.cumsum(a.n[self.a]), np.cumsum(b.n[self.b])
        doc_ends = np.cumsum(np.where(good, size + 1, 0))
        side_at = np.zeros(int(doc_ends[-1]) + 1 if n else 1, np.uint8)
        side_at[ends_a] = 1
        side_at[ends_b] += 2
        ends = np.flatnonzero(side_at)
        kind = side_at[ends]
        self.both = kind == 3
        self.end_a, self.end_b = (kind & 1).astype(bool), kind >= 2
        #: for each link, which token of either side covers it: as many as have ended before
        self.link_a = np.cumsum(self.end_a) - self.end_a
        self.link_b = np.cumsum(self.end_b) - self.end_b
        self.link_upto = np.concatenate([[0], np.searchsorted(ends, doc_ends, "right")])
        groups = np.concatenate([[0], np.cumsum(self.both)])
        self.group_upto = groups[self.link_upto]
        self.ends, self.doc_ends = ends, doc_ends

    def digests(self, shown: np.ndarray) -> list[str]:
        """SHA-256 of `a1,a2|b1;a3|b2,b3` of each text; '' where it has no tokens."""
        most = len(shown) // 3
        width = shown.dtype.itemsize
        before = np.cumsum(self.both) - self.both
        group_a, group_b = before[self.end_a], before[self.end_b]
        last_a, last_b = self.both[self.end_a], self.both[self.end_b]
        upto_a = np.cumsum(np.bincount(group_a, minlength=int(self.both.sum())))
        n_b = np.bincount(group_b, minlength=len(upto_a))
        out = np.empty(len(self.a) + len(self.b), shown.dtype)
        out[np.arange(len(self.a)) + (np.cumsum(n_b) - n_b)[group_a]] = shown[self.a + np.where(last_a, most, 0)]
        out[np.arange(len(self.b)) + upto_a[group_b]] = shown[self.b + np.where(last_b, 2 * most, 0)]
        flat = out.view(np.uint8)
        full = flat != 0
        upto = np.concatenate([[0], np.cumsum(full.reshape(-1, width).sum(1))])[self.a_upto + self.b_upto].tolist()
        text = memoryview(flat[full])
        return [hashlib.sha256(text[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(upto, upto[1:], strict=False)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(text << 2 BITS | a << BITS | b, number of links) of the different pairs of each text, ascending."""
        text = np.repeat(np.arange(len(self.link_upto) - 1), np.diff(self.link_upto))
        return np.unique(text << (2 * BITS) | self.a[self.link_a] << BITS | self.b[self.link_b], return_counts=True)


def longest_runs(data: np.ndarray, off: np.ndarray, live: np.ndarray) -> np.ndarray:
    """The longest run of bytes without white space of each text that isn't empty."""
    gap = np.flatnonzero((data <= 32) & (data != 0))
    cuts = np.unique(np.concatenate([gap, off[live], [len(data)]]))
    return np.maximum.reduceat(np.diff(cuts), np.searchsorted(cuts, off[live]))


def packed(x: np.ndarray) -> bytes:
    """Compressed: equal bytes of the numbers together, which leaves most of them zero."""
    own = np.ascontiguousarray(x.astype("<u4"))
    return pa.compress(own.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def unpacked(x: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(x, 4 * n, "zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def blocks(docs: DataFrame, a_path: str, b_path: str, key: str, text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of about block_bytes of text: each document's counts and digest, the block's different pairs and who holds which."""
    kind = dict(docs.dtypes)[key]
    id_type = docs.select(key).limit(0).toArrow().schema.field(0).type
    longs = pa.list_(pa.int64())
    fields = [("block", pa.int64()), ("ids", pa.list_(id_type)), *[(c, longs) for c in COUNTS], ("sha", pa.list_(pa.string())), ("different", longs), ("pairs", longs), ("held", longs), ("links", pa.binary()), ("times", pa.binary())]

    def row(block: int, ids: list, counts: list, shas: list, keys: list, times: list) -> pa.RecordBatch:
        n, t = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (keys, times))
        pairs, place, held = np.unique(n & ((1 << 2 * BITS) - 1), return_inverse=True, return_counts=True)
        doc = n >> (2 * BITS)
        different = np.bincount(doc, minlength=len(ids))
        gaps = np.diff(place, prepend=0)
        first = (np.cumsum(different) - different)[different > 0]
        gaps[first] = place[first]
        cols = [block, ids, *np.concatenate(counts, axis=1), shas, different, pairs, held, packed(gaps), packed(t)]
        return pa.RecordBatch.from_arrays([pa.array([list(c) if isinstance(c, np.ndarray) else c], k) for c, (_, k) in zip(cols, fields, strict=True)], names=[f[0] for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, shown = sides(a_path, b_path)
        own: tuple[list, ...] = ([], [], [], [], [])
        number, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            data, off = texts(batch.column(1))
            for i, j, part, at in steps(data, off):
                x = Aligned(a, b, part, at)
                pairs, times = x.pairs()
                pairs += len(own[0]) << (2 * BITS)
                counts = np.array([np.diff(x.a_upto), np.diff(x.b_upto), np.diff(x.group_upto), np.diff(x.link_upto)])
                for to, value in zip(own[1:], (counts, x.digests(shown), pairs, times), strict=True):
                    to.extend(value) if isinstance(value, list) else to.append(value)
                own[0].extend(batch.column(0).slice(i, j - i).to_pylist())
                held += len(part)
                if held >= block_bytes or len(own[0]) >= 1 << 20:
                    yield row(number, *own)
                    own, number, held = ([], [], [], [], []), number + 1, 0
        if own[0]:
            yield row(number, *own)
        release()

    names = {"int64": "long", "string": "string", "binary": "binary"}
    kinds = {longs: "array<long>", pa.list_(id_type): f"array<{kind}>", pa.list_(pa.string()): "array<string>"}
    return docs.select(key, text).mapInArrow(run, ", ".join(f"{n} {kinds.get(k) or names[str(k)]}" for n, k in fields))


def scored(table_of_blocks: DataFrame, n_a: int, n_b: int) -> DataFrame:
    """(pair, n documents, whether that is the highest of its a, of its b): the highest ones are at most a row an id of a vocabulary."""
    found = table_of_blocks.select(F.explode(F.arrays_zip("pairs", "held")).alias("x"))
    counts = materialise(found.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("n")), "pairs")
    split = counts.withColumns({"a": F.shiftright("pair", BITS), "b": F.col("pair").bitwiseAND(F.lit((1 << BITS) - 1))})
    for side, rows in (("a", n_a), ("b", n_b)):
        top = split.groupBy(side).agg(F.max("n").alias(f"top_{side}"))
        split = split.join(sized(top, rows, 32), side)
    return split.select("pair", "a", "b", "n", (F.col("n") == F.col("top_a")).alias("best_a"), (F.col("n") == F.col("top_b")).alias("best_b"))


def aligned(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: key, n_a, n_b, n_groups, n_links, n_best, n_best_b, count_sum (longs), groups_sha256.

    Texts null, empty or changed by either tokenizer have no tokens: zeros, and '' as digest. Null and repeated keys stay rows of
    their own, and each row counts as a document; other columns are ignored; an empty table gives none. A text is encoded as a
    whole, whatever its length; memory is some twenty times the longest one.
    """
    a, b, _ = sides(a_path, b_path)
    made = materialise(blocks(docs, a_path, b_path, key, text, block_bytes), "blocks")
    asked = made.select("block", F.posexplode("pairs").alias("pos", "pair"))
    told = asked.join(scored(made, a.size, b.size).select("pair", "n", "best_a", "best_b"), "pair").select(F.col("block").alias("of"), "pos", "n", "best_a", "best_b")
    id_type = docs.select(key).limit(0).toArrow().schema.field(0).type

    def score(own: pa.Table, values: pa.Table) -> pa.Table:
        order = np.argsort(values["pos"].to_numpy())
        n, best_a, best_b = (values[c].to_numpy()[order].astype(np.int64) for c in ("n", "best_a", "best_b"))
        r = {c: own[c].combine_chunks().flatten() for c in ("ids", *COUNTS, "sha", "different")}
        different = r["different"].to_numpy()
        upto = np.concatenate([[0], np.cumsum(different)])
        gaps, times = (unpacked(own[c][0].as_py(), int(upto[-1])) for c in ("links", "times"))
        run = np.cumsum(gaps)
        first = upto[:-1][different > 0]
        place = run - np.repeat(run[first] - gaps[first], different[different > 0])
        sums = [np.diff(np.concatenate([[0], np.cumsum(times * x[place])])[upto]) for x in (best_a, best_b, n)]
        return pa.table([r["ids"], *[r[c] for c in COUNTS], *[pa.array(x) for x in sums], r["sha"]], names)

    names = [key, *COUNTS, "n_best", "n_best_b", "count_sum", "groups_sha256"]
    schema = f"`{key}` {dict(docs.dtypes)[key]}, {', '.join(f'{c} long' for c in names[1:-1])}, groups_sha256 string"
    return made.drop("pairs", "held").groupBy("block").cogroup(told.groupBy("of")).applyInArrow(score, schema)


def alignments(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document with the tokens and links themselves: key, a, b (ids), group_ends (bytes of space + text before each
    group's end), link_a, link_b (the numbers of the linked tokens, in order). Empty arrays where there are no tokens."""
    id_type = docs.select(key).limit(0).toArrow().schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, _ = sides(a_path, b_path)
        for batch in batches:
            data, off = texts(batch.column(1))
            for i, j, part, at in steps(data, off):
                x = Aligned(a, b, part, at)
                rows = []
                for d in range(j - i):
                    (p, q), (s, t), (u, v) = x.a_upto[d : d + 2], x.b_upto[d : d + 2], x.link_upto[d : d + 2]
                    start = x.doc_ends[d - 1] if d else 0
                    rows.append((x.a[p:q], x.b[s:t], x.ends[u:v][x.both[u:v]] - start, x.link_a[u:v] - p, x.link_b[u:v] - s))
                cols = [pa.array([list(r[k]) for r in rows], pa.list_(pa.int64())) for k in range(5)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(id_type), *cols], names=[key, "a", "b", "group_ends", "link_a", "link_b"])
        release()

    schema = f"`{key}` {dict(docs.dtypes)[key]}, a array<long>, b array<long>, group_ends array<long>, link_a array<long>, link_b array<long>"
    return docs.select(key, text).mapInArrow(run, schema)


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
