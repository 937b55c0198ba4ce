"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are normalised, so that cosine ``c`` is distance ``sqrt(2 - 2c)``.
A table hashes a vector to ``m`` quantised Gaussian projections; vectors that
agree on all ``m`` in at least one of ``T`` tables meet, and an exact cosine
check decides.  Both numbers follow from the theory of p-stable hashing: ``m``
from the number of vectors, so that unrelated vectors rarely meet however many
there are, and ``T`` from the recall wanted at the threshold.

Groups are the connected components of the pairs at or above ``THRESHOLD``
(``nearsets`` keeps buckets of thousands of copies linear).

Defined results: vectors that are null, empty, of norm 0 or hold a null, NaN
or infinity are groups of their own; vectors of different dimension never
match; equal directions are one node from the start; a row repeated in full
gives one row; a null ``vec_id`` takes part, but is a group's id only if no
other member has one; an empty table gives an empty result; only ``vec_id``
and ``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm import nearsets
from corpusloom.llm.textkit import as_long, mix64
from corpusloom.session import cut, free

THRESHOLD = 0.95
WIDTH = 1.2
RECALL = 0.95
SEED = 3
#: Tables whose buckets are kept at once; what they join is not compared again in later rounds.
ROUND_TABLES = 64


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised projection of two vectors agrees."""
    if distance <= 0:
        return 1.0
    t = width / distance
    return erf(t / sqrt(2)) - 2 / (sqrt(2 * pi) * t) * (1 - exp(-t * t / 2))


def shape(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Projections a table and tables for ``n`` vectors."""
    near, far = collision(sqrt(2 - 2 * threshold)), collision(sqrt(2.0))
    m = max(4, ceil(log(max(2, n)) / log(1 / far)) + 2)
    return m, ceil(log(1 - recall) / log(1 - near**m))


def by_length(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the lists of each length above 0; nulls inside become NaN."""
    size = np.where(np.asarray(col.is_valid()), np.diff(col.offsets.to_numpy()), 0)
    begin, flat = col.offsets.to_numpy()[:-1], col.values.to_numpy(zero_copy_only=False)
    for n in np.unique(size[size > 0]):
        at = np.flatnonzero(size == n)
        yield at, flat[begin[at][:, None] + np.arange(n)]


def prepared(col: pa.Array) -> tuple[pa.Array, pa.Array]:
    """``node`` (a hash of the direction's coordinates as 32-bit floats) and ``unit`` of each vector; null where it has none."""
    node, size = np.zeros(len(col), dtype=np.int64), np.zeros(len(col), dtype=np.int64)
    found = []
    for at, x in by_length(col):
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt((x * x).sum(axis=1))
        ok = (norm > 0) & (norm < np.inf)
        at, unit = at[ok], x[ok] / norm[ok][:, None]
        bits = (unit.astype(np.float32) + np.float32(0)).view(np.uint32).astype(np.uint64)
        with np.errstate(over="ignore"):
            h = mix64(bits + np.arange(1, unit.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            node[at] = as_long(mix64(h.sum(axis=1, dtype=np.uint64)))
        size[at] = unit.shape[1]
        found.append((at, unit))
    edge = np.concatenate([[0], np.cumsum(size)])
    flat = np.zeros(edge[-1])
    for at, unit in found:
        flat[edge[at][:, None] + np.arange(unit.shape[1])] = unit
    none = pa.array(size == 0)
    return pa.array(node, mask=size == 0), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(flat), mask=none)


def keys(block: np.ndarray, m: int, tables: int, seed: int = SEED, first: int = 0) -> np.ndarray:
    """``(rows, tables)`` bucket keys of unit vectors of one dimension, for the tables from ``first``."""
    dim = block.shape[1]
    rng = np.random.default_rng([seed, dim, first])
    a, b = rng.standard_normal((dim, tables * m)), rng.uniform(0, WIDTH, tables * m)
    q = np.floor((block @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(block), tables, m)
    number = np.arange(first + 1, first + tables + 1, dtype=np.uint64)
    h = np.broadcast_to(number * np.uint64(1_000_003) + np.uint64(dim), q.shape[:2])
    for j in range(m):
        with np.errstate(over="ignore"):
            h = mix64(h * np.uint64(0x100000001B3) + q[:, :, j])
    return h


def near_groups(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``vec_id, group_id, group_size, keep``: one row a vector, ``keep`` on the least id of a group."""
    vectors = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    m, tables = shape(vectors.count(), threshold, recall)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *prepared(b.column(1))], names=["vec_id", "node", "unit"])

    def bucket(batches: Iterator[pa.RecordBatch], first: int, some: int) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = b.column(0).to_numpy()
            for at, x in by_length(b.column(1)):
                h = keys(x, m, some, first=first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(np.ascontiguousarray(h).ravel())), pa.array(np.repeat(nodes[at], some))],
                    names=["value", "node"],
                )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, dtype=bool)
            other = {x.shape[1]: (at, x) for at, x in by_length(b.column(3))}
            for at, x in by_length(b.column(2)):
                there, y = other.get(x.shape[1], (np.zeros(0, np.int64), x[:0]))
                both, i, j = np.intersect1d(at, there, assume_unique=True, return_indices=True)
                ok[both] = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
            yield b.select([0, 1]).filter(pa.array(ok))

    rows = cut(vectors.mapInArrow(prepare, "vec_id long, node long, unit array<double>"))
    nodes = cut(rows.where("node is not null").groupBy("node").agg(F.first("unit").alias("unit")))

    def verify(pairs: DataFrame) -> DataFrame:
        ua = nodes.select(F.col("node").alias("a"), F.col("unit").alias("ua"))
        ub = nodes.select(F.col("node").alias("b"), F.col("unit").alias("ub"))
        return pairs.join(ub, "b").join(ua, "a").select("a", "b", "ua", "ub").mapInArrow(check, "a long, b long")

    comp = None
    for first in range(0, tables, ROUND_TABLES):
        some = min(ROUND_TABLES, tables - first)
        every = cut(nodes.mapInArrow(partial(bucket, first=first, some=some), "value long, node long"))
        lists = cut(nearsets.long_lists(every))
        old, comp = comp, nearsets.group(lists, verify, 0.0, known=comp)
        free(every, lists, old)
    members = cut(
        rows.select("vec_id", "node")
        .distinct()
        .join(comp, "node", "left")
        .select("vec_id", "node", F.coalesce("comp", "node").alias("comp"))
    )
    best = F.struct(F.col("vec_id").isNull().alias("no_id"), F.col("vec_id").alias("id"), F.col("node").alias("node"))
    head = (
        members.where("comp is not null").groupBy("comp").agg(F.min(best).alias("head"), F.count(F.lit(1)).alias("size"))
    )
    mine = F.col("head.id").eqNullSafe(F.col("vec_id")) & (F.col("head.node") == F.col("node"))
    return members.join(head, "comp", "left").select(
        "vec_id",
        F.when(F.col("comp").isNull(), F.col("vec_id")).otherwise(F.col("head.id")).alias("group_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("comp").isNull() | mine).alias("keep"),
    )
