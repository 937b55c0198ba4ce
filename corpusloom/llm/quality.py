"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms are hashed words, single punctuation marks and a few marks of form
(all-capital words, a word that repeats the one before, numbers), counted as
``log(1 + tf) * idf``.  A truncated SVD of a bounded labelled sample gives the
latent space; the sample's unit vectors are broadcast.  Every document is
projected and compared with *all* of them in exact blocked cosine products,
and its ``NEIGHBOURS`` nearest vote with their labels, weighted by similarity.

Defined results: null, empty and termless texts have no vector, so ``score``
and ``quality`` are null; labels that are null or whose document is missing or
null are not used; similarities equal in six decimals are taken in order of the
sample; repeated rows are scored each (and learned once); a null ``doc_id`` is carried; without usable
labels every score is null; an empty table gives an empty result; only the
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.textkit import _POW, _IS_WORD, column, mix64, pieces, slices
from corpusloom.llm.toxicity import labelled

WORD_TERMS = 4000
#: After the words: 128 ASCII characters that are no word characters, then the marks of form.
CAPITALS, REPEAT, NUMBER = (WORD_TERMS + 128 + i for i in range(3))
TERMS = WORD_TERMS + 131
TRAIN_ROWS = 4000
RANK = 64
NEIGHBOURS = 15
SEED = 5
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_NUMERAL = np.zeros(256, dtype=bool)
_NUMERAL[48:58] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[33:127] = True
_MARK &= ~_IS_WORD


def term_counts(texts: list[str | None]) -> np.ndarray:
    """Dense ``(texts, TERMS)`` counts."""
    parts = [("" if t is None else t).encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)
    step = np.diff(_IS_WORD[buf].view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    rows, terms = [], []
    if len(starts):
        lens = ends - starts
        edge = np.cumsum(lens) - lens
        pos = np.arange(int(lens.sum())) - np.repeat(edge, lens)
        with np.errstate(over="ignore"):
            data = (_FOLD[buf[np.repeat(starts, lens) + pos]].astype(np.uint64) + np.uint64(1)) * _POW[pos & 0xFFFF]
            h = mix64(np.add.reduceat(data, edge) + lens.astype(np.uint64))
        doc = np.searchsorted(bounds, starts, side="right") - 1
        rows.append(doc)
        terms.append((h % np.uint64(WORD_TERMS)).astype(np.int64))
        loud = _UPPER[buf[starts]] & _UPPER[buf[np.minimum(starts + 1, ends - 1)]] & (lens > 1)
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])])
        for flag, term in ((loud, CAPITALS), (again, REPEAT), (_NUMERAL[buf[starts]], NUMBER)):
            rows.append(doc[flag])
            terms.append(np.full(int(flag.sum()), term))
    marks = np.flatnonzero(_MARK[buf])
    rows.append(np.searchsorted(bounds, marks, side="right") - 1)
    terms.append(WORD_TERMS + buf[marks].astype(np.int64))
    key = np.concatenate(rows) * TERMS + np.concatenate(terms)
    return np.bincount(key, minlength=len(texts) * TERMS).astype(np.float32).reshape(len(texts), TERMS)


def nearest(sim: np.ndarray, k: int) -> np.ndarray:
    """Mask of each row's ``k`` greatest values; of equal ones the first."""
    least = np.partition(sim, sim.shape[1] - k, axis=1)[:, [-k]]
    take = sim >= least
    for i in np.flatnonzero(take.sum(axis=1) > k):
        equal = np.flatnonzero(sim[i] == least[i])
        take[i, equal[k - (sim[i] > least[i]).sum() :]] = False
    return take


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray  # TERMS x RANK
    vectors: np.ndarray  # unit vectors of the sample
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit latent vectors, and which rows have one."""
        v = (np.log1p(counts) * self.idf) @ self.basis
        norm = np.linalg.norm(v, axis=1)
        return v / np.maximum(norm, 1e-12)[:, None], norm > 1e-9

    def vote(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Similarity-weighted share of good neighbours, and which texts have one."""
        out, has = np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        k = min(NEIGHBOURS, len(self.labels))
        for part in pieces(texts):
            for a in range(part.start, part.stop, 512):
                block = slice(a, min(a + 512, part.stop))
                v, ok = self.project(term_counts(texts[block]))
                if not k:
                    continue
                sim = np.round(v @ self.vectors.T, 6)
                w = np.where(nearest(sim, k), np.maximum(sim, 1e-9), 0.0).astype(np.float64)
                out[block] = (w @ self.labels) / w.sum(axis=1)
                has[block] = ok
        return out, has


def fit(texts: list[str], labels: list[int], rank: int = RANK, seed: int = SEED) -> Model:
    """Randomised truncated SVD (two power steps) of the sample's weighted terms."""
    if not texts:
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, rank), np.float32), np.zeros((0, rank)), np.zeros(0))
    counts = np.concatenate([term_counts(texts[s]) for s in pieces(texts, 1_000_000)])
    idf = (np.log((1 + len(texts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    a = np.log1p(counts) * idf
    a /= np.maximum(np.linalg.norm(a, axis=1), 1e-12)[:, None]
    q = a @ np.random.default_rng(seed).standard_normal((TERMS, rank + 16)).astype(np.float32)
    for _ in range(2):
        q = np.linalg.qr(a @ (a.T @ np.linalg.qr(q)[0]))[0]
    q = np.linalg.qr(q)[0]
    _, _, vt = np.linalg.svd(q.T @ a, full_matrices=False)
    model = Model(idf, np.ascontiguousarray(vt[:rank].T.astype(np.float32)), np.zeros((0, rank)), np.zeros(0))
    vectors, ok = model.project(counts)
    model.vectors, model.labels = vectors[ok].astype(np.float32), np.asarray(labels, dtype=np.float64)[ok]
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    texts, y, _ = labelled(docs, labels, "quality", rows)
    return fit(texts, y)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, quality`` of every row; ``quality`` is 1 from a score of 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s, ok = shared.value.vote(column(b, "text"))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).cast(pa.int64()),
                    pa.array(s, mask=~ok),
                    pa.array((s >= 0.5).astype(np.int32), mask=~ok),
                ],
                names=["doc_id", "score", "quality"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, quality int")
