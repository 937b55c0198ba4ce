"""Vectorised text primitives shared by the training-data operators.

A *word* is a maximal run of ASCII letters, digits and underscores and of
non-ASCII characters, taken from the lower-cased text.  All functions work on
whole Arrow/pandas batches: the texts of a batch are joined into one UTF-8
buffer and words are hashed with NumPy, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: RE2/Java class of one word, for the SQL forms of the operators.
WORD_RE = r"[^\x00-/:-@\[-\^`{-\x7f]+"

_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)
_BASE = _U(0x100000001B3)


def _word_table() -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[128:] = True
    for c in b"abcdefghijklmnopqrstuvwxyz0123456789_ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        t[c] = True
    return t


_IS_WORD = _word_table()
_POW = np.ones(1 << 16, dtype=_U)
with np.errstate(over="ignore"):
    _POW[1:] = np.multiply.accumulate(np.full((1 << 16) - 1, _BASE, dtype=_U))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64), vectorised."""
    x = np.array(x, dtype=_U, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def word_spans(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends (byte offsets), the buffer, and per-text word offsets.

    Text ``i`` owns words ``offsets[i]:offsets[i + 1]``.  Null texts own none.
    """
    parts = [("" if t is None else t.lower()).encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    lens = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
    bounds = np.concatenate([[0], np.cumsum(lens)])
    flag = _IS_WORD[buf].view(np.int8)
    step = np.diff(flag, prepend=np.int8(0))
    starts = np.flatnonzero(step == 1)
    ends = np.flatnonzero(step == -1)
    offsets = np.searchsorted(starts, bounds)
    if not len(parts):
        offsets = np.zeros(1, dtype=np.int64)
    return starts, ends, buf, offsets


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of a batch and the per-text word offsets."""
    starts, ends, buf, offsets = word_spans(texts)
    if not len(starts):
        return np.zeros(0, dtype=_U), offsets
    lens = ends - starts
    total = int(lens.sum())
    first = np.repeat(np.cumsum(lens) - lens, lens)
    pos = np.arange(total, dtype=np.int64) - first
    data = buf[np.repeat(starts, lens) + pos].astype(_U)
    with np.errstate(over="ignore"):
        data += _U(1)
        data *= _POW[pos & 0xFFFF]
        h = np.add.reduceat(data, np.cumsum(lens) - lens)
        h += lens.astype(_U) * _MUL
    return mix64(h), offsets


def shingle_hashes(texts: list[str | None], n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each text and their per-text offsets.

    A text with fewer than ``n`` words (but at least one) has a single
    shingle: all of its words.  A text without words has none.  Repeated
    shingles are not removed here.
    """
    w, off = word_hashes(texts)
    counts = np.diff(off)
    n_sh = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out_off = np.concatenate([[0], np.cumsum(n_sh)])
    total = int(out_off[-1])
    if not total:
        return np.zeros(0, dtype=_U), out_off
    pos = np.repeat(off[:-1] - out_off[:-1], n_sh) + np.arange(total)
    width = np.repeat(np.minimum(counts, n), n_sh)
    h = np.full(total, _U(seed), dtype=_U)
    with np.errstate(over="ignore"):
        for j in range(n):
            live = width > j
            if live.all():
                h = (h ^ w[pos + j]) * _MUL
                h ^= h >> _U(29)
            else:
                x = (h[live] ^ w[pos[live] + j]) * _MUL
                h[live] = x ^ (x >> _U(29))
    return mix64(h), out_off


def distinct_per_text(h: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text."""
    for i in range(len(off) - 1):
        yield np.unique(h[off[i] : off[i + 1]])


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut, without copying, to about ``most`` bytes of the named string column.

    Spark bounds its batches by rows; this bounds what Python objects and
    temporaries a worker holds at once, whatever the texts' lengths.
    """
    for b in batches:
        if b.num_rows < 2:
            yield b
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(name))), 0), dtype=np.int64)
        total = np.cumsum(size)
        begin = 0
        while begin < b.num_rows:
            before = int(total[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, before + most, side="right")))
            yield b.slice(begin, end - begin)
            begin = end


def pieces(texts: list[str | None], most: int = 1_000_000) -> Iterator[slice]:
    """Slices of a batch of about ``most`` characters, to bound working memory."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        k = len(t) if t else 0
        if i > begin and size + k > most:
            yield slice(begin, i)
            begin, size = i, 0
        size += k
    if begin < len(texts):
        yield slice(begin, len(texts))


def as_long(h: np.ndarray) -> np.ndarray:
    """Unsigned hash as the signed 64-bit value Spark stores."""
    return h.view(np.int64)


def concat(frames: list[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame(columns=columns)
