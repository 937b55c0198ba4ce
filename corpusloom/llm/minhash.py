"""MinHash near-dedup with bottom-k sketches from one hash function.

A document is the set of its word ``N``-grams.  Its sketch is the ``K`` least
of their 64-bit hashes.  Inverted lists of retained values generate the pairs
(``nearsets``), the union sketch (the ``K`` least values of two sketches
together) estimates their Jaccard index, pairs estimated below ``THRESHOLD -
SLACK`` go, and the exact index of the two whole texts decides.  Groups are
the connected components of the pairs at or above ``THRESHOLD``.

Documents with the same shingles are one node from the start, so exact copies
cost nothing however many there are; ``nearsets`` keeps near copies in
thousands linear.  Families that share much but stay below the threshold (a
template filled in thousands of times) make long lists of sketch values; their
members are compared by prefix lists of their whole shingle sets instead.

Defined results: null, empty and wordless texts have no shingles and are
groups of their own; a row repeated in full (same id and text) is one
document; an id repeated with different texts is several, told apart by the
text; a null ``doc_id`` takes part, but never becomes a group's id while
another member has one; an empty table gives an empty result; only ``doc_id``
and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm import nearsets
from corpusloom.llm.textkit import as_long, column, mix64, pieces, shingle_hashes, slices
from corpusloom.session import cut, free

N, K = 3, 64
THRESHOLD, SLACK = 0.6, 0.15
#: Keys up to this many (8 bytes each) are broadcast when texts are fetched; more are joined by shuffle.
BROADCAST_KEYS = 2_000_000


def distinct_shingles(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for s in pieces(texts):
        h, off = shingle_hashes(texts[s], n)
        out += [np.unique(h[off[i] : off[i + 1]]) for i in range(len(off) - 1)]
    return out


def node_of(h: np.ndarray) -> int | None:
    """Id of a set of shingles: a hash of all of them, or None for the empty set."""
    if not len(h):
        return None
    with np.errstate(over="ignore"):
        x = mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(h))
    return int(mix64(np.array([x], dtype=np.uint64)).view(np.int64)[0])


def signatures(docs: DataFrame, n: int = N, k: int = K) -> DataFrame:
    """``doc_id, tkey, node, n, vals`` of every row; ``vals`` is the sketch, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = column(b, "text")
            if not texts:
                continue
            sets = distinct_shingles(texts, n)
            heads = [s[:k] for s in sets]
            flat = as_long(np.concatenate(heads)) if heads else np.zeros(0, np.int64)
            off = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).cast(pa.int64()),
                    b.column(1),
                    pa.array([node_of(s) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(off), pa.array(flat)),
                ],
                names=["doc_id", "tkey", "node", "n", "vals"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text").mapInArrow(
        run, "doc_id long, tkey long, node long, n int, vals array<long>"
    )


def union_estimate(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Jaccard estimate from two bottom-k sketches (ascending)."""
    u = np.union1d(a, b)[:k]
    return float(np.isin(u, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean()) if len(u) else 0.0


def exact_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _estimated(pairs: DataFrame, sketches: DataFrame, k: int, least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2), b.column(3)
            xv, yv = x.values.to_numpy(), y.values.to_numpy()
            xo, yo = x.offsets.to_numpy(), y.offsets.to_numpy()
            ok = [
                union_estimate(
                    xv[xo[i] : xo[i + 1]].view(np.uint64), yv[yo[i] : yo[i + 1]].view(np.uint64), k
                )
                >= least
                for i in range(b.num_rows)
            ]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    sa = sketches.select(F.col("node").alias("a"), F.col("vals").alias("va"))
    sb = sketches.select(F.col("node").alias("b"), F.col("vals").alias("vb"))
    return pairs.join(sb, "b").join(sa, "a").select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "tb"):
            ta, tb = column(b, "ta"), column(b, "tb")
            ids = column(b, "a")
            ok, at, hub = [], None, None
            for s in pieces([x + y for x, y in zip(ta, tb)]):
                others = distinct_shingles(tb[s], n)
                for i, other in zip(range(s.start, s.stop), others):
                    if ids[i] != at:
                        at, hub = ids[i], distinct_shingles([ta[i]], n)[0]
                    ok.append(exact_jaccard(hub, other) >= threshold)
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    xa = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    xb = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(xb, "b").join(xa, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def fetch(docs: DataFrame, wanted: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``node, text`` for ``wanted`` (``node, tkey``), one row a node.

    Up to ``broadcast_keys`` keys are broadcast, more are joined by shuffle.
    """
    wanted = F.broadcast(wanted) if wanted.count() <= broadcast_keys else wanted.hint("merge")
    keyed = docs.select(F.xxhash64("text").alias("tkey"), "text")
    return keyed.join(wanted, "tkey").groupBy("node").agg(F.min("text").alias("text"))


def _entries(texts: DataFrame, n: int) -> DataFrame:
    """``value, node, size`` of every shingle of ``texts`` (``node, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = distinct_shingles(column(b, "text"), n)
            if not sets:
                continue
            size = np.array([len(s) for s in sets], dtype=np.int32)
            node = np.repeat(b.column(0).to_numpy(), size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(as_long(np.concatenate(sets))), pa.array(node), pa.array(np.repeat(size, size))],
                names=["value", "node", "size"],
            )

    return texts.select("node", "text").mapInArrow(run, "value long, node long, size int")


def near_groups(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    n: int = N,
    k: int = K,
    slack: float = SLACK,
    broadcast_keys: int = BROADCAST_KEYS,
    heavy: int = nearsets.HEAVY,
) -> DataFrame:
    """``doc_id, tkey, comp, group_id, group_size, keep``: one row a document.

    ``keep`` marks the one document of each group that stays: the least id,
    then the least text hash.
    """
    sig = cut(signatures(docs, n, k))
    nodes = cut(
        sig.where("node is not null")
        .groupBy("node")
        .agg(F.first("vals").alias("vals"), F.first("n").alias("size"), F.min("tkey").alias("tkey"))
        .withColumn("need", F.greatest(F.lit(1), F.ceil((threshold - slack) * F.size("vals"))).cast("int"))
    )
    every = cut(nearsets.inverted_lists(nodes))
    lists = cut(nearsets.long_lists(every))
    listed = nodes.join(lists.select("node").distinct(), "node")
    sketches = cut(listed.select("node", "vals"))
    wanted = cut(listed.select("node", "tkey"))
    texts = cut(fetch(docs, wanted, broadcast_keys))
    free(every, nodes, wanted)

    def verify(pairs: DataFrame) -> DataFrame:
        return _verified(cut(_estimated(pairs, sketches, k, threshold - slack)), texts, n, threshold)

    def whole_sets(wanted: DataFrame) -> DataFrame:
        some = cut(texts.join(wanted, "node", "left_semi"))
        hot = nearsets.hot_values(some, partial(_entries, n=n))
        return nearsets.banded_lists(_entries(some, n), threshold, hot)

    comp = nearsets.group(lists, verify, threshold, whole_sets, heavy)
    free(lists, sketches, texts)
    members = (
        sig.select("doc_id", "tkey", "node")
        .distinct()
        .join(comp, "node", "left")
        .select("doc_id", "tkey", F.coalesce("comp", "node").alias("comp"))
        .distinct()
    )
    best = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("tkey").alias("t"))
    head = (
        members.where("comp is not null")
        .groupBy("comp")
        .agg(F.min(best).alias("head"), F.count(F.lit(1)).alias("group_size"))
    )
    mine = F.col("head.id").eqNullSafe(F.col("doc_id")) & (F.col("head.t") == F.col("tkey"))
    return members.join(head, "comp", "left").select(
        "doc_id",
        "tkey",
        "comp",
        F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("head.id")).alias("group_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("comp").isNull() | mine).alias("keep"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group; a row repeated in full stays once."""
    key, times, gid, gkey = (_fresh(docs, x) for x in ("tkey", "times", "gid", "gkey"))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    groups = cut(near_groups(docs, threshold).select("doc_id", "tkey", "keep"))
    gone = groups.where("not keep").select(F.col("doc_id").alias(gid), F.col("tkey").alias(gkey))
    same = F.col("doc_id").eqNullSafe(F.col(gid)) & (F.col(key) == F.col(gkey))
    kept = keyed.join(gone, same, "left_anti")
    again = cut(
        docs.select(F.col("doc_id").alias(gid), F.xxhash64("text").alias(gkey))
        .groupBy(gid, gkey)
        .agg(F.count(F.lit(1)).alias(times))
        .where(F.col(times) > 1)
        .select(gid, gkey)
    )
    if not again.isEmpty():
        once = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", key])
        kept = kept.join(again, same, "left_anti").unionByName(once)
    return kept.drop(key)


def _fresh(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name
