"""N-gram Jaccard join (op7): a MinHash LSH forest finds candidates, then exact verification.

A document is the set of its shingles (five words in a row; fewer words are one shingle), as 64-bit hashes. It has a label of
DEEPEST min-values in each of TREES trees. The labels of all trees are sorted as one table (a range sort, so that a hot prefix is
many tasks); in a sorted array of labels the documents under a node of the prefix trie lie side by side, and the common prefix
of neighbours tells the node where they part. Prefixes are shortened level by level: at each level a document that hasn't yet
reached the target recall there matches all that share its prefix. How far it has to go follows from the least similarity that a
partner can have: for a small set some similarities of LEAST and more can't occur, so it stops at a longer prefix. Where few
documents share a prefix it is shortened one value more than the target needs. Neighbours matched in this way are joined;
the components of these links (at most one a label) bound where partners can be. Within a component all pairs are compared by
their shingle sets, in tiles of blocks against blocks, so that no task holds more than two blocks, and pairs are counted where
they are found and never written: a tile gives each document's links and a forest that joins what it found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PRE, importable, materialise, sized, table
from .components import components
from .textbytes import SPACES, mix, ngrams, release, steps, texts, words

WORDS, LEAST, RECALL = 5, 0.8, 0.998
TREES, DEEPEST = 16, 8
#: Documents under a node up to which a prefix is shortened by one more value than the target recall asks for.
SPARSE = 4
#: Documents, and bytes of their sets, that are compared at a time; larger components are cut into blocks of about as many.
BLOCK, BLOCK_BYTES = 256, 8 << 20
#: Sets of more shingles may have partners of any similarity from LEAST on, about.
SMALL_SET = 40
_SALT = mix(np.arange(1, TREES * DEEPEST + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def depth(trees: int = TREES, deepest: int = DEEPEST, least: float = LEAST, recall: float = RECALL) -> int:
    """The longest prefix at which two documents of similarity `least` share one with a chance of `recall` or more."""
    d = deepest
    while d > 1 and 1 - (1 - least**d) ** trees < recall:
        d -= 1
    return d


def least_similarity(n: int, least: float = LEAST) -> float:
    """The least similarity from `least` on that a set of n shingles can have to any set."""
    found = [o / u for o in range(1, n + 1) for u in range(n, 2 * n + 1) if o * 1.0 >= least * u]
    return min(found, default=1.0)


def depths(least: float = LEAST) -> np.ndarray:
    """By number of shingles (more than SMALL_SET: the last one) the prefix at which the target recall is reached."""
    return np.array([DEEPEST, *(depth(least=least_similarity(n, least)) for n in range(1, SMALL_SET + 1)), depth(least=least)], np.int8)


def shingles(data: np.ndarray, off: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of texts in small letters, their number up to each text, and a hash of each word sequence."""
    _, _, h, upto = words(data, off, SPACES)
    g, upto_g = ngrams(h, upto, k)
    counts = np.diff(upto)
    few = np.flatnonzero((counts > 0) & (counts < k))
    if len(few):
        own = np.array([mix(np.array([sum(int(x) * pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j, x in enumerate(h[upto[i] : upto[i + 1]])) & (1 << 64) - 1], np.uint64))[0] for i in few])
        g, upto_g = np.insert(g, upto_g[few], own), upto_g + np.concatenate([[0], np.cumsum((counts > 0) & (counts < k))])
    order = np.arange(len(h), dtype=np.uint64) - np.repeat(upto[:-1], counts).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + order * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)])
    return g, upto_g, mix((sums[upto[1:]] - sums[upto[:-1]]) + counts.astype(np.uint64))


def labels(g: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """DEEPEST values of 16 bits for each tree, a row a text (texts without shingles: 0)."""
    out = np.zeros((len(upto) - 1, TREES * DEEPEST), ">u2")
    full = np.flatnonzero(np.diff(upto))
    if not len(full):
        return out
    at = upto[:-1][full]
    small = (g >> np.uint64(32)).astype(np.uint32)
    for k, s in enumerate(_SALT.tolist()):
        x = (small ^ np.uint32(s & 0xFFFFFFFF)) * np.uint32(s >> 32 | 1)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        out[full, k] = np.minimum.reduceat(x, at) * np.uint32(0x9E3779B1) >> np.uint32(16)
    return out


def _lowered(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))


def signatures(docs: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """(id, same, bytes, need, labels): a hash of the word sequence (null: no word), bytes of the set at most, the prefix length
    that meets the target recall, and the labels of all trees, one after another."""
    by_size = depths(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for _, _, data, off in steps(*texts(b.column("text"))):
                g, upto, h = shingles(data, off)
                n = np.diff(upto)
                distinct = np.minimum(n, SMALL_SET + 1)
                for i in np.flatnonzero((n > 1) & (n <= 4 * SMALL_SET)):
                    distinct[i] = min(SMALL_SET + 1, len(set(g[upto[i] : upto[i + 1]].tolist())))
                for i in np.flatnonzero(n > 4 * SMALL_SET):  # more than enough places, but few may differ
                    if len(set(g[upto[i] : upto[i] + 4 * SMALL_SET].tolist())) <= SMALL_SET:
                        distinct[i] = min(SMALL_SET + 1, len(np.unique(g[upto[i] : upto[i + 1]])))
                cols[0].append(pa.array(h.view(np.int64), mask=n == 0))
                cols[1].append(pa.array(8 * n))
                cols[2].append(pa.array(by_size[distinct].astype(np.int32)))
                raw = labels(g, upto)
                size = raw.shape[1] * raw.itemsize
                cols[3].append(pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.arange(len(n) + 1, dtype=np.int32) * size), pa.py_buffer(raw.tobytes())]))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.concat_arrays(c) for c in cols]], names=["id", "same", "bytes", "need", "labels"])
        release()

    return _lowered(docs, key, text).mapInArrow(run, "id long, same long, bytes long, need int, labels binary")


def matched(label: np.ndarray, need: np.ndarray, least_need: int) -> np.ndarray:
    """Of the rows of a sorted label array (tree and values as columns), which are matched with the one before.

    Level by level from the whole label up: all that share a prefix are matched if one of them needs to come up to this level,
    or few share it, or the prefix goes beyond this array's ends, where others may need it.
    """
    n = len(label)
    out = np.zeros(n, bool)
    common = np.zeros(n, np.int64)  # values shared with the row before; rows of two trees share none
    same = label[1:] == label[:-1]
    common[1:] = np.cumprod(same, 1).sum(1) - 1
    common[1:][~same[:, 0]] = 0
    for level in range(label.shape[1] - 1, max(0, least_need - 2), -1):
        begin = common < level
        begin[0] = True
        at = np.flatnonzero(begin)
        size = np.diff(np.append(at, n))
        come = np.minimum.reduceat(need, at) <= level
        if level >= least_need:
            come[[0, -1]] = True
        else:
            come |= (size <= SPARSE) & (np.minimum.reduceat(need, at) <= level + 1)
        out |= ~begin & np.repeat(come, size)
    return out


def forest(reps: DataFrame, least: float, rows_each: int = 400_000) -> DataFrame:
    """(a, b): links of the documents in reps (rep, need, labels) by the sorted label arrays of all trees.

    Parts of an array hold about rows_each labels; the first and the last label of each part are looked at once more on
    the driver (two rows a part) for matches across parts.
    """
    n, least_need = reps.count(), int(depths(least).min())
    parts = max(1, -(-n * TREES // rows_each))
    label = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring(F.col("labels"), t * (2 * DEEPEST) + 1, F.lit(2 * DEEPEST))))
    rows = reps.select("rep", "need", "labels").select("rep", "need", label.alias("tree", "label"))
    rows = rows.repartitionByRange(parts, "tree", "label", "rep").sortWithinPartitions("tree", "label", "rep").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            rep, need, tree = (t[c].to_numpy() for c in ("rep", "need", "tree"))
            raw = t["label"].chunk(0)
            off = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, raw.offset * 4)
            values = np.frombuffer(raw.buffers()[2], ">u2", len(raw) * DEEPEST, int(off[0])).reshape(-1, DEEPEST)
            whole = np.concatenate([tree[:, None], values], 1).astype(np.int32)
            on = matched(whole, need, least_need)
            head = np.flatnonzero(~on)
            first = np.repeat(rep[head], np.diff(np.append(head, len(rep))))
            linked = np.flatnonzero(on & (first != rep))
            ends = np.array([0, len(rep) - 1])
            a, b = np.concatenate([first[linked], rep[ends]]), np.concatenate([rep[linked], rep[ends]])
            edge = [None] * len(linked) + [t["label"][int(i)].as_py() for i in ends]
            at = [None] * len(linked) + [int(tree[i]) for i in ends]
            part = pa.array(np.full(len(a), t["part"][0].as_py(), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), part, pa.array(at, pa.int32()), pa.array(edge, pa.binary())], names=["a", "b", "part", "tree", "label"])
        held = []
        release()

    found = materialise(rows.mapInArrow(run, "a long, b long, part int, tree int, label binary"), "forest")
    ends = [(r.part, r.tree, r.label, r.a) for r in found.filter("label is not null").collect()]
    last: dict[int, list] = {}
    for e in sorted(ends):
        last.setdefault(e[0], []).append(e)
    order = [last[p] for p in sorted(last)]
    across = []
    for before, after in zip(order, order[1:], strict=False):
        (_, t, x, a), (_, u, y, b) = before[-1], after[0]
        if t == u and x[: 2 * least_need] == y[: 2 * least_need] and a != b:
            across.append((a, b))
    links = found.filter("label is null").select("a", "b")
    return links.union(reps.sparkSession.createDataFrame(across, "a long, b long")) if across else links


def sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, same, shingles): the hash of the word sequence, and the sorted distinct shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, same = [], []
            for _, _, data, off in steps(*texts(b.column("text"))):
                g, upto, h = shingles(data, off)
                same.append(h.view(np.int64))
                out += [np.unique(g[upto[i] : upto[i + 1]]).tobytes() for i in range(len(off) - 1)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.concatenate(same or [np.zeros(0, np.int64)])), pa.array(out, pa.binary())], names=["id", "same", "shingles"])
        release()

    return _lowered(docs, key, text).mapInArrow(run, "id long, same long, shingles binary")


def _enough(both, union, least: float):
    """both / union >= least, of counts, with room for the rounding of `least` as a float: the same for single pairs and blocks."""
    return both >= least * union * (1 - 1e-12)


def alike(left: list[np.ndarray], right: list[np.ndarray], least: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of `least` or more, as a matrix; by products of indicator blocks."""
    if len(left) == len(right) == 1:
        both = len(np.intersect1d(left[0], right[0], assume_unique=True))
        return np.array([[_enough(both, len(left[0]) + len(right[0]) - both, least)]])
    sizes = [np.array([len(s) for s in side]) for side in (left, right)]
    cat = [np.concatenate(side) if side else np.zeros(0, np.uint64) for side in (left, right)]
    shared = np.intersect1d(cat[0], cat[1])
    both = np.zeros((len(left), len(right)))
    place = []
    for c, size in zip(cat, sizes, strict=True):
        at = np.searchsorted(shared, c)
        ok = at < len(shared)
        ok[ok] = shared[at[ok]] == c[ok]
        place.append((np.repeat(np.arange(len(size)), size)[ok], at[ok]))
    width = 4096
    for lo in range(0, len(shared), width):
        m = []
        for (row, at), size in zip(place, sizes, strict=True):
            ok = (at >= lo) & (at < lo + width)
            x = np.zeros((len(size), min(width, len(shared) - lo)), np.float32)
            x[row[ok], at[ok] - lo] = 1
            m.append(x)
        both += m[0] @ m[1].T
    return _enough(both, sizes[0][:, None] + sizes[1][None, :] - both, least)


def _tile(i: int, j: int, ids: np.ndarray, blocks: np.ndarray, copies: np.ndarray, own: list[np.ndarray], least: float):
    """(id, least partner or root, links) of the documents of a tile that have a link in it."""
    a, b = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
    same = alike([own[x] for x in a], [own[x] for x in b], least)
    if i == j:
        np.fill_diagonal(same, False)
    rows, cols = np.nonzero(same)
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, a[rows], copies[b[cols]])
    if i != j:
        np.add.at(links, b[cols], copies[a[rows]])
    root = ids.copy()
    while True:  # least id by the links of the tile, with shortcuts
        old = root.copy()
        np.minimum.at(root, a[rows], old[b[cols]])
        np.minimum.at(root, b[cols], old[a[rows]])
        if (root == old).all():
            break
    keep = np.flatnonzero(links)
    return ids[keep], root[keep], links[keep]


def compare(placed: DataFrame, least: float) -> DataFrame:
    """placed: comp, i, j, id, block, copies, shingles, a row for each document of a tile. (id, root, links) by tile."""
    fields = ["comp", "i", "j", "id", "block", "copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seen: set[int] = set()
        now = None

        def out():
            c = [np.array(x) for x in zip(*(h[:3] for h in held), strict=True)]
            got = _tile(now[1], now[2], c[0], c[1], c[2], [h[3] for h in held], least)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["id", "root", "links"])

        for b in batches:
            cols = [b.column(b.schema.get_field_index(f)).to_pylist() for f in fields]
            raw = b.column(b.schema.get_field_index("shingles"))
            for k, (comp, i, j, doc, block, copies) in enumerate(zip(*cols, strict=True)):
                if (comp, i, j) != now:
                    if len(held) > 1:
                        yield out()
                    now, held, seen = (comp, i, j), [], set()
                if doc in seen:  # a repeated row
                    continue
                seen.add(doc)
                held.append((doc, block, copies, np.frombuffer(raw[k].as_buffer(), np.uint64).copy()))
        if len(held) > 1:
            yield out()
        held = []
        release()

    dealt = placed.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    return dealt.mapInArrow(run, "id long, root long, links long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """(key, class_id, n_links, n_copies): one row for each key that isn't null.

    Words are what lies between white space, in small letters; texts with the same words in a row are copies. class_id is the
    least key of all documents joined by chains of links (similarity of `least` or more, copies included); n_links the number
    of other documents that this one is linked to; n_copies of them are copies. Texts without a word (null, empty, blank) have
    no links and are classes of their own. Rows with one key are taken together: of their texts the one with the least hash
    counts, and repeated rows aren't copies. Any key type that casts to long; other columns are ignored. Links are found with
    a chance of at least RECALL each at `least` itself, more above it and where few texts are alike; every link reported is verified by the sets.
    """
    importable(docs.sparkSession)
    rows = signatures(docs, key, text, least)
    sig = materialise(rows.groupBy("id").agg(F.min(F.struct("same", "bytes", "need", "labels")).alias("x")).select("id", "x.*"), "signatures")
    worded = sig.filter("same is not null")
    of_least = F.min(F.struct("id", "bytes", "need", "labels"))
    reps = materialise(worded.groupBy("same").agg(of_least.alias("x"), F.count("*").alias("copies")).select("same", F.col("x.id").alias("rep"), "copies", "x.bytes", "x.need", "x.labels"), "reps")
    comp = components(forest(reps, least))
    # blocks by the number of documents and by the bytes of their sets
    near = comp.join(reps.select(F.col("rep").alias("id"), "copies", "bytes", "same"), "id")
    sizes = near.groupBy("root").agg(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES).alias("size"))
    near = near.join(sizes, "root")
    near = materialise(near.select("id", F.col("root").alias("comp"), "copies", "same", F.ceil("size").cast("int").alias("nb")), "near")
    n = near.count()
    own = sets(docs, key, text).join(sized(near, n, 64), ["id", "same"])
    block = F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")
    whole = own.withColumn("block", block)
    tiles = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j")))
    placed = whole.select("comp", "id", "block", "copies", "shingles", F.explode(tiles).alias("t")).select("comp", "t.i", "t.j", "id", "block", "copies", "shingles")
    found = materialise(compare(placed, least), "links")
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    by_rep = reps.select("same", "rep", "copies").join(links.withColumnRenamed("id", "rep"), "rep", "left").join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left")
    # only classes that differ from the document itself need be looked up
    told = by_rep.filter("copies > 1 or links is not null").select("same", F.coalesce("root", "rep").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), "copies")
    out = sig.select("id", "same").join(told, "same", "left")
    return out.select(
        F.col("id").alias(key),
        F.coalesce("root", "id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
        (F.coalesce("copies", F.lit(1)) - 1).alias("n_copies"),
    )


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def keep_one(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without all documents of a class but the one with the least key; rows without a key stay."""
    classes = near_duplicates(docs, key)
    gone = materialise(classes.filter(F.col("class_id") != F.col(key)).select(F.col(key).alias(f"{PRE}gone")), "gone")
    return docs.join(sized(gone, gone.count(), 16), docs[key] == F.col(f"{PRE}gone"), "left_anti")
