"""Toxicity by FTRL-proximal logistic regression over hashed word features.

Features are the presence of word unigrams, bigrams and skip-grams (two words
with one between them), hashed into ``2 ** BITS`` coordinates.  Per-coordinate
learning rates suit rare words, and L1 leaves few weights other than 0: the
model is a short list of coordinates and weights, broadcast to score every
document.

The model is fit on a bounded sample, ``TRAIN_ROWS`` labelled documents and
``TRAIN_CHARS`` characters in hash order of their id; scoring covers every whole text.

Defined results: null, empty and wordless texts get the score of the bias
alone, like any text without known features; labels that are null or whose
document is missing or null are not used; repeated rows are scored each and
learned once; a null ``doc_id`` is carried; without labels of both kinds
every score is null; an empty table gives an empty result; only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.textkit import column, mix64, pieces, slices, word_hashes
from corpusloom.session import cut, free

BITS = 20
TRAIN_ROWS = 12_000
#: Characters of a training sample.
TRAIN_CHARS = 200_000_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 3.0, 0.01
#: Toxic documents are rare, so the bias is strongly negative; this cut balances misses and false alarms.
THRESHOLD = 0.25
SEED = 11


def grams(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, coordinate)`` of every word, bigram and skip-gram."""
    w, off = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(off))
    salt = np.uint64(0x9E3779B97F4A7C15)
    docs, found = [doc], [w]
    with np.errstate(over="ignore"):
        for gap in (1, 2):
            if len(w) > gap:
                same = doc[gap:] == doc[:-gap]
                docs.append(doc[gap:][same])
                found.append((mix64(w[:-gap][same] + np.uint64(gap)) ^ w[gap:][same]) * salt)
    return np.concatenate(docs), (mix64(np.concatenate(found)) >> np.uint64(64 - bits)).astype(np.int64)


def features(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates present in each text: ``(text number, coordinate)``, distinct, in order."""
    doc, at = grams(texts, bits)
    key = np.unique((doc << bits) | at)
    return key >> bits, key & ((1 << bits) - 1)


@dataclass
class Model:
    """Sorted coordinates with their weights, and the bias; empty if it could not be fit."""

    at: np.ndarray
    weight: np.ndarray
    bias: float
    fit: bool = True

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of each text; repeated grams are sought out only among those with a weight."""
        out = np.full(len(texts), self.bias)
        dense = np.zeros(1 << BITS)
        dense[self.at] = self.weight
        for part in pieces(texts):
            doc, at = grams(texts[part])
            hit = np.flatnonzero(dense[at])
            key = np.unique((doc[hit] << BITS) | at[hit])
            weights = dense[key & ((1 << BITS) - 1)]
            out[part] += np.bincount(key >> BITS, weights=weights, minlength=part.stop - part.start)
        return 1.0 / (1.0 + np.exp(-np.clip(out, -35, 35)))


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Model after ``epochs`` passes in seeded order; the last coordinate is the bias."""
    y = np.asarray(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, False)
    rows: list[np.ndarray] = []
    for part in pieces(texts):
        doc, at = features(texts[part])
        edge = np.searchsorted(doc, np.arange(part.stop - part.start + 1))
        rows += [at[a:b] for a, b in zip(edge, edge[1:])]
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for j in rng.permutation(len(rows)):
            i = np.append(rows[j], size - 1)
            w = weights(i)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y[j]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(size))
    at = np.flatnonzero(w[:-1])
    return Model(at, w[at], float(w[-1]))


def labelled(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int = TRAIN_CHARS
) -> tuple[list[str], list[int], list[int]]:
    """Texts, labels and ids of a sample in hash order of the id.

    It has at most ``rows`` label rows, as many different texts of these, and
    ``chars`` characters: a text that would exceed them is passed over.  Rows
    repeated in full count once.
    """
    order = [F.xxhash64("doc_id"), "doc_id", "y"]
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where("doc_id is not null and y is not null")
        .orderBy(*order)
        .limit(rows)
    )
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")  # two numbers a row
    held = cut(found.groupBy("doc_id", "y", F.xxhash64("text").alias("tkey")).agg(F.min("text").alias("text")))
    kept, left = [], chars
    for r in held.select("doc_id", "y", "tkey", F.length("text").alias("n")).orderBy(*order, "tkey").limit(rows).collect():
        if r.n <= left:
            left -= r.n
            kept.append((r.doc_id, r.y, r.tkey))
    keys = docs.sparkSession.createDataFrame(kept, "doc_id long, y int, tkey long")
    got = held.join(F.broadcast(keys), ["doc_id", "y", "tkey"]).select("doc_id", "y", "text").toArrow().to_pylist()
    free(held)
    got.sort(key=lambda r: (r["doc_id"], r["y"], r["text"]))
    return [r["text"] for r in got], [r["y"] for r in got], [r["doc_id"] for r in got]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    texts, y, _ = labelled(docs, labels, "toxic", rows)
    return fit(texts, y)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, toxic`` of every row; ``toxic`` from a score of ``THRESHOLD``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = shared.value.scores(column(b, "text"))
            none = np.full(len(s), not shared.value.fit)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(s, mask=none), pa.array(s >= THRESHOLD, mask=none)],
                names=["doc_id", "score", "toxic"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, toxic boolean")
