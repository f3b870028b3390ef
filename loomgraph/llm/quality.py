"""Quality classifier (op5): naive Bayes support vectors.

Features of a text are which n-grams (one and two tokens) it has. Tokens are runs of letters, of digits or of other signs; a
run of capitals, a number and a repetition of the token before stand for themselves as kinds, whatever they spell. Indicators
are scaled by the n-gram's class log-count ratio and to unit length; a linear hinge-loss model over them is fitted by dual
coordinate descent; its margins become probabilities by a logistic curve fitted on rows the model hasn't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PRE, crc_of_id, importable, table
from .textbytes import RUNS, ngrams, release, steps, texts, words

#: Labelled rows at most that the model is fitted on: those with the smallest hashes of their ids.
TRAIN_ROWS = 8000
#: An n-gram of fewer training rows is ignored.
LEAST_ROWS = 4
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_CAPS, _NUMBER, _AGAIN = np.uint64(11), np.uint64(12), np.uint64(13)


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all n-grams, with repetitions, and the number of the text of each."""
    starts, ends, h, upto = words(LOWER[data], off, RUNS)
    if not len(h):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    kind = RUNS[data[starts]]
    sums = np.zeros((2, len(data) + 1), np.int32)
    np.cumsum((data >= 65) & (data <= 90), out=sums[0, 1:])
    np.cumsum((data >= 97) & (data <= 122), out=sums[1, 1:])
    upper, lower = sums[0, ends] - sums[0, starts], sums[1, ends] - sums[1, starts]
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[upto[:-1][upto[:-1] < len(h)]] = False
    h[(kind == 1) & (upper > 1) & (lower == 0)] = _CAPS
    h[kind == 3] = _NUMBER
    h[again] = _AGAIN
    two, upto2 = ngrams(h, upto, 2)
    of = np.concatenate([np.repeat(np.arange(len(off) - 1), np.diff(u)) for u in (upto, upto2)])
    return (np.concatenate([ngrams(h, upto, 1)[0], two]) >> np.uint64(32)).astype(np.uint32), of


@dataclass
class Model:
    grams: np.ndarray  # sorted 32-bit hashes
    ratio: np.ndarray  # log-count ratio of each
    weight: np.ndarray
    bias: float
    slope: float  # of the logistic curve, and where it is at one half
    middle: float

    def margins(self, h: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """h holds hashes of grams, without repetitions within a text."""
        at = np.searchsorted(self.grams, h)
        r = self.ratio[at]
        dot = np.bincount(of, r * self.weight[at], n)
        norm = np.sqrt(np.bincount(of, r * r, n))
        return dot / np.maximum(norm, 1e-9) + self.bias

    def scores(self, data: np.ndarray, off: np.ndarray, sieve: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        h, of = features(data, off)
        keep = sieve[h >> np.uint32(8)]
        h, of = h[keep], of[keep]
        at = np.searchsorted(self.grams, h)
        keep = self.grams[np.minimum(at, len(self.grams) - 1)] == h if len(self.grams) else np.zeros(len(h), bool)
        code = np.unique((of[keep].astype(np.uint64) << np.uint64(32)) | h[keep])
        m = self.margins((code & np.uint64(0xFFFFFFFF)).astype(np.uint32), (code >> np.uint64(32)).astype(np.int64), n)
        return 1 / (1 + np.exp(-np.clip(self.slope * (m - self.middle), -50, 50)))


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, dim: int, cost: np.ndarray, rounds: int, rng) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the linear hinge loss; the bias is one more feature of value 1."""
    w, b, alpha = np.zeros(dim), 0.0, np.zeros(len(y))
    square = np.array([v @ v + 1 for v in values])
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            g = y[i] * (values[i] @ w[rows[i]] + b) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if step := (new - alpha[i]) * y[i]:
                w[rows[i]] += step * values[i]
                b += step
                alpha[i] = new
    return w, b


def fit(sample: list[tuple[int, np.ndarray]], cost: float = 1.0, smooth: float = 1.0, rounds: int = 12) -> Model:
    """sample: label (0 or 1) and distinct hashes of each row. With one class only, all scores are its share."""
    rng = np.random.default_rng(5)
    y = np.array([1.0 if q else -1.0 for q, _ in sample])
    share = (np.sum(y > 0) + 1) / (len(y) + 2)
    empty = Model(np.zeros(0, np.uint32), np.zeros(0), np.zeros(0), 0.0, 1.0, -float(np.log(share / (1 - share))))
    if len(set(y)) < 2:
        return empty
    every = np.concatenate([h for _, h in sample])
    grams, df = np.unique(every, return_counts=True)
    grams = grams[df >= LEAST_ROWS]
    rows = []
    for _, h in sample:
        at = np.searchsorted(grams, h)
        at = at[at < len(grams)]
        rows.append(at[grams[at] == h[: len(at)]])  # h is sorted
    count = {s: np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t == s] or [np.zeros(0, int)]), minlength=len(grams)) + smooth for s in (1, -1)}
    n = {s: np.sum(y == s) + 2 * smooth for s in (1, -1)}
    ratio = np.log((count[1] / n[1]) / (count[-1] / n[-1]))
    values = [ratio[r] / max(np.linalg.norm(ratio[r]), 1e-9) for r in rows]
    part = np.arange(len(y)) % 4 == 3
    fit_on = np.flatnonzero(~part)
    costs = np.where(y > 0, cost, cost * np.sqrt(np.sum(y > 0) / np.sum(y < 0)))
    w, b = descend([rows[i] for i in fit_on], [values[i] for i in fit_on], y[fit_on], len(grams), costs[fit_on], rounds, rng)
    m = np.array([v @ w[r] + b for r, v in zip(rows, values, strict=True)])
    t = m[part] if len(set(y[part])) == 2 else m
    target = (y[part] if len(set(y[part])) == 2 else y) > 0
    pos, neg = np.sum(target), np.sum(~target)
    goal = np.where(target, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, 0.0
    for _ in range(60):  # Newton steps for the logistic curve, damped by a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * t + c, -50, 50)))
        v = np.maximum(p * (1 - p), 1e-9)
        g = np.array([np.sum((p - goal) * t) + 1e-3 * a, np.sum(p - goal)])
        hess = np.array([[np.sum(v * t * t) + 1e-3, np.sum(v * t)], [np.sum(v * t), np.sum(v) + 1e-3]])
        d = np.linalg.solve(hess, g)
        d *= min(1.0, 2.0 / max(1e-9, np.abs(d).max()))
        a, c = a - d[0], c - d[1]
    a = max(a, 1e-3)
    return Model(grams, ratio, w, float(b), float(a), float(-c / a))


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = TRAIN_ROWS) -> Model:
    """A model of the labels that aren't held out; `most` of them, by the hash of the id. A doc_id with several
    labels has the least, one with several texts the least of them."""
    importable(docs.sparkSession)
    own = labels.filter(F.col(column).isin(0, 1) & (crc_of_id() % 4 != 2)).groupBy("doc_id").agg(F.min(column).alias("y"))
    own = own.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(most)  # at most `most` rows of two numbers
    # one row an id: of repeated ids the least text counts
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(own), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, out = b.column("y").to_pylist(), []
            ids = b.column("doc_id").to_pylist()
            for i, _, data, off in steps(*texts(b.column("text"))):
                h, of = features(data, off)
                cut = np.searchsorted(of[np.argsort(of, kind="stable")], np.arange(len(off)))
                h = h[np.argsort(of, kind="stable")]
                out += [(ids[i + k], int(y[i + k]), np.unique(h[cut[k] : cut[k + 1]]).tobytes()) for k in range(len(off) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int8(), pa.binary()))], names=["doc_id", "y", "h"])

    got = {r[0]: (r[1], np.frombuffer(r[2], np.uint32)) for r in rows.mapInArrow(take, "doc_id long, y byte, h binary").collect()}
    return fit([got[k] for k in sorted(got)])


def score(docs: DataFrame, model: Model, least: float = 0.7, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of docs plus a score (0 to 1) and a prediction (1 if the score >= least), called `names`.

    Null texts count as empty; repeated rows are scored alike; an empty table gives none. docs must not have those names already.
    """
    if set(names) & set(docs.columns):
        raise ValueError(f"docs already has one of {names}")
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = np.zeros(1 << 24, bool)
        sieve[model.grams >> np.uint32(8)] = True
        for b in batches:
            s = np.concatenate([model.scores(data, off, sieve) for _, _, data, off in steps(*texts(b.column("text")))] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= least).astype(np.int32))], schema=pa.schema([*b.schema, (names[0], pa.float64()), (names[1], pa.int32())]))
        release()

    from pyspark.sql.types import DoubleType, IntegerType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(names[0], DoubleType()).add(names[1], IntegerType()))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_of_id() % 4 == 2).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects, with their own columns, whatever these are called.

    Null texts count as empty texts, which have a score too; of repeated rows all stay or go; null ids are scored like others
    but never learned from; an empty table gives none.
    """
    names = (f"{PRE}score", f"{PRE}predicted")
    return score(docs, train(docs, labels), names=names).filter(F.col(names[1]) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
