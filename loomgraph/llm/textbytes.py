"""Words and word n-grams of whole Arrow batches as 64-bit hashes, without a Python step per word."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes of text that one step works on (a longer text is one step).
STEP = 1 << 20

#: Classes of bytes: 0 white space, else parts of words. `RUNS` parts them further, `LETTERS` takes other signs as space.
SPACES = np.ones(256, np.uint8)
SPACES[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 0
LETTERS = np.zeros(256, np.uint8)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
RUNS = SPACES * 2
RUNS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
RUNS[48:58] = 3


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        for k, base in enumerate((_P, _INV)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _pow[k] = np.cumprod(x, dtype=np.uint64)
    return _pow[0], _pow[1]


def texts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string column; nulls are empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = pc.fill_null(a.cast(pa.large_string()), "")
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8) if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def steps(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text after the last, bytes, offsets from 0) of parts of about STEP bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + STEP, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, hashes and the number of words up to each text (len(off)): runs of bytes of one class but 0."""
    n = len(data)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    c = classes[data]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(c[1:], c[:-1], out=new[1:])
    new[off[:-1][off[:-1] < n]] = True
    at = np.flatnonzero(new)
    end = np.append(at[1:], n)
    is_word = c[at] != 0
    starts, ends = at[is_word], end[is_word]
    return starts, ends, hashes(data, starts, ends), np.searchsorted(starts, off)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes from starts to ends (ascending, apart from one another), in stretches of about STEP bytes."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + STEP, "right")))
        own = data[base : ends[j - 1]]
        pw, inv = _powers(len(own) + 1)
        sums = np.empty(len(own) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((own.astype(np.uint64) + np.uint64(1)) * pw[: len(own)], dtype=np.uint64, out=sums[1:])
        lo, hi = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[hi] - sums[lo]) * inv[lo] + (hi - lo).astype(np.uint64) * _A)
        i = j
    return out


def ngrams(h: np.ndarray, upto: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in a row, and the number of them up to each text; texts of fewer words have none."""
    counts = np.diff(upto)
    each = np.maximum(counts - k + 1, 0)
    upto_g = np.concatenate([[0], np.cumsum(each)])
    total = int(upto_g[-1])
    if not total:
        return np.zeros(0, np.uint64), upto_g
    first = np.repeat(upto[:-1] - upto_g[:-1], each) + np.arange(total)
    g = np.zeros(total, np.uint64)
    for j in range(k):
        g = g * _B + h[first + j]
    return mix(g + np.uint64(k)), upto_g


def release() -> None:
    """Give memory that a task has freed back to the system: idle Python workers would keep it from the next ones."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
