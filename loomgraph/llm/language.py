"""Language identification (op2): blended-spectrum string kernels with Nystrom landmarks and kernel ridge regression.

The kernel of two texts is the number of character n-grams (one to three characters) that both have, over the root of the
product of how many each has; n-grams are taken from the landmarks, a bounded sample of texts for each language, and all of
them count: those of the 255 most frequent letters are found in tables, others by binary search. One-versus-
rest ridge regression is fitted in the space of the landmarks. A text's kernel row times the fitted coefficients is a product
of its n-gram indicator row with one matrix, so texts are scored in batches of rows by matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import PRE, crc_of_id, importable, table
from .textbytes import steps, texts

#: Texts for each language, about: landmarks, and further ones that the regression is fitted on.
LANDMARKS, TRAIN = 60, 440
UNKNOWN = "und"
#: Cells of the matrix of texts and n-grams that is held at a time, at most (one text has a row, whatever the model's size).
INDICATORS = 1 << 24
_SPACE = 32


@lru_cache(1)
def lower_letters() -> np.ndarray:
    """For each code point its small letter, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    upto = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=upto[1:])
    return points, upto[off]


def grams(text: str) -> np.ndarray:
    """Distinct n-grams, each packed in 63 bits; what is no letter counts as a blank."""
    c = lower_letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)].astype(np.uint64)
    c[c == 0] = _SPACE
    two = c[:-1] | (c[1:] << np.uint64(21))
    three = two[:-1] | (c[2:] << np.uint64(42)) if len(c) > 2 else two[:0]
    return np.unique(np.concatenate([c, two, three]))


@dataclass
class Model:
    langs: list[str]
    alphabet: np.ndarray  # the most frequent small letters and the blank; their places are 1, 2, ...
    grams: np.ndarray  # sorted, packed
    matrix: np.ndarray  # grams x languages
    bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, list[np.ndarray], np.ndarray | None]:
        """The place of each code point, for one, two and three places the n-gram's row or -1, and which code points are rare:
        in n-grams, but without a place (None: there is none)."""
        low = lower_letters().copy()
        low[low == 0] = _SPACE
        place = np.zeros(0x110000, np.uint8)
        place[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        place = place[low]
        at = {int(c): i + 1 for i, c in enumerate(self.alphabet)}
        rows = [np.full(256**k, -1, np.int32) for k in (1, 2, 3)]
        for i, g in enumerate(self.grams.tolist()):
            c = [at.get(x) for x in (g & 0x1FFFFF, g >> 21 & 0x1FFFFF, g >> 42) if x]
            if None not in c:
                rows[len(c) - 1][sum(x << 8 * k for k, x in enumerate(c))] = i
        rare = np.zeros(0x110000, bool)
        rare[np.setdiff1d(self.grams[self.grams < 1 << 21].astype(np.int64), self.alphabet)] = True
        return place, rows, rare[low] if rare.any() else None

    def decide(self, data: np.ndarray, off: np.ndarray, place: np.ndarray, rows: list[np.ndarray], rare: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Values of each language for each text, and which texts have a letter. N-grams with rare letters are looked up in grams."""
        n, most = len(off) - 1, max(1, INDICATORS // max(1, len(self.grams)))
        if n > most:  # many short texts: their rows of indicators are made a part at a time
            parts = [(i, min(n, i + most)) for i in range(0, n, most)]
            got = [self.decide(data[off[i] : off[j]], off[i : j + 1] - off[i], place, rows, rare) for i, j in parts]
            return np.concatenate([v for v, _ in got]), np.concatenate([x for _, x in got])
        points, at = code_points(data, off)
        of = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
        letter = np.bincount(of[lower_letters()[points] > 0], minlength=n) > 0
        c = place[points].astype(np.uint32)
        have = np.zeros((n, len(self.grams)), np.float32)
        code = c
        for k in range(3):
            if k:
                code = code[:-1] | (c[k:] << np.uint32(8 * k))
            row = rows[k][code]
            ok = (row >= 0) & (of[: len(row)] == of[k:]) if k else row >= 0
            have[of[: len(row)][ok], row[ok]] = 1
        if rare is not None:
            odd = np.flatnonzero(rare[points])
            low = lower_letters()[points].astype(np.uint64)
            low[low == 0] = _SPACE
            for k in range(3):
                i = np.unique((odd[:, None] - np.arange(k + 1)).reshape(-1))
                i = i[(i >= 0) & (i + k < len(points))]
                i = i[of[i] == of[i + k]]
                g = sum(low[i + j] << np.uint64(21 * j) for j in range(k + 1))
                row = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
                ok = self.grams[row] == g
                have[of[i][ok], row[ok]] = 1
        size = np.sqrt(np.maximum(have.sum(1, keepdims=True), 1))
        return have @ self.matrix.astype(np.float32) / size + self.bias, letter


def fit(sample: list[tuple[str, np.ndarray]], ridge: float = 0.1) -> Model:
    """sample: language and distinct n-grams of each text; the first LANDMARKS of a language are its landmarks."""
    langs = sorted({x for x, _ in sample})
    seen = dict.fromkeys(langs, 0)
    marks, rest = [], []
    for lang, g in sample:
        seen[lang] += 1
        (marks if seen[lang] <= LANDMARKS else rest).append((lang, g))
    rest = rest + marks
    letters, often = np.unique(np.concatenate([g[g < 1 << 21] for _, g in marks] or [np.zeros(0, np.uint64)]), return_counts=True)
    alphabet = np.sort(letters[np.argsort(-often, kind="stable")[:255]]).astype(np.int64)
    vocabulary = np.unique(np.concatenate([g for _, g in marks] or [np.zeros(0, np.uint64)]))
    if not len(langs):
        return Model([], alphabet, vocabulary, np.zeros((0, 0)), np.zeros(0))

    def indicators(part):
        out = np.zeros((len(part), len(vocabulary)), np.float32)
        for i, (_, g) in enumerate(part):
            at = np.searchsorted(vocabulary, g[g <= vocabulary[-1]])
            out[i, at[vocabulary[at] == g[g <= vocabulary[-1]]]] = 1
        return out / np.sqrt(np.maximum(out.sum(1, keepdims=True), 1))

    mark, x = indicators(marks).astype(float), indicators(rest).astype(float)
    values, vectors = np.linalg.eigh(mark @ mark.T)
    half = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    phi = np.hstack([x @ mark.T @ half, np.ones((len(rest), 1))])
    y = np.array([[1.0 if lang == k else -1.0 for k in langs] for lang, _ in rest])
    coef = np.linalg.solve(phi.T @ phi + ridge * np.eye(phi.shape[1]), phi.T @ y)
    return Model(langs, alphabet, vocabulary, mark.T @ (half @ coef[:-1]), coef[-1])


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model of docs' rows with a language that aren't held out: the LANDMARKS + TRAIN of each language with the least hashes.

    Null texts and languages teach nothing; repeated rows count each; an empty table gives a model without languages. A hash
    bound per language cuts hot languages before the shuffle, and ranks within a language take exactly so many of the rest.
    """
    importable(docs.sparkSession)
    own = docs.filter((crc_of_id() % 5 != 0) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in own.groupBy(lang).count().collect()}  # a row for each language
    goal = LANDMARKS + TRAIN
    share = F.lit(0)
    for k, n in sorted(counts.items()):
        share = F.when(F.col(lang) == k, F.lit(min(1 << 40, -(-4 * goal * (1 << 40) // n)))).otherwise(share)
    key = F.xxhash64("doc_id", F.lit(9))
    least = F.row_number().over(Window.partitionBy(lang).orderBy(key, "doc_id"))
    picked = own.filter(F.pmod(key, F.lit(1 << 40)) < share).withColumn(f"{PRE}n", least).filter(F.col(f"{PRE}n") <= goal)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = [grams(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("lang"), pa.array(g, pa.binary())], names=["k", "lang", "g"])

    rows = picked.select(key.alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(take, "k long, lang string, g binary").collect()
    return fit([(r[1], np.frombuffer(r[2], np.uint64)) for r in sorted(rows)])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of docs plus lang_pred and score (0 to 1).

    `und` (score 0) for null texts, texts without a letter and a model without languages; ties go to the first language by name.
    """
    if {"lang_pred", "score"} & set(docs.columns):
        raise ValueError("docs already has lang_pred or score")

    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rows, rare = model.tables()
        names = np.array([*model.langs, UNKNOWN], object)
        for b in batches:
            pred, score = [], []
            for _, _, data, off in steps(*texts(b.column(b.schema.get_field_index(text)))):
                if not model.langs:
                    pred.append(np.full(len(off) - 1, UNKNOWN, object))
                    score.append(np.zeros(len(off) - 1))
                    continue
                v, letter = model.decide(data, off, place, rows, rare)
                best = v.argmax(1)
                p = np.exp(3 * (v - v.max(1, keepdims=True)))
                pred.append(names[np.where(letter, best, len(model.langs))])
                score.append(np.where(letter, 1 / p.sum(1), 0.0))
            out = [pa.array(np.concatenate(pred) if pred else [], pa.string()), pa.array(np.concatenate(score).astype(float) if score else [], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *out], schema=pa.schema([*b.schema, ("lang_pred", pa.string()), ("score", pa.float64())]))

    from pyspark.sql.types import DoubleType, StringType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "lang_pred", "score")
