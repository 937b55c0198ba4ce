"""Document fingerprints by spot signatures.

A spot is an anchor, one of a few very common words, followed by a chain of
``CHAIN`` content words (words that are no anchors), taken ``DISTANCE``
content words apart.  Every anchor may lead.  Navigation and lists hold few
anchors, so signatures come from running text.  A document is the set of its spots; documents with a
Jaccard index of ``THRESHOLD`` or more share a fingerprint group.

Sets are partitioned by length into bands that grow by ``1 / THRESHOLD``, so that
similar sets lie in one band or in neighbours, and inverted lists are kept per
band, with prefixes as short as the lengths to be met there allow.  Within a
list, pairs are pruned by length and by their positions before the sets are
intersected; all these bounds are exact.

Texts without a complete spot are lists, fragments and repeated words.  With
``fallback`` such a text is known by its words in order, so it shares
fingerprint and group with texts of the same words, and with no others; its
``n_spots`` is 0.

Defined results: texts that are null, empty or wordless (without ``fallback``:
or without a complete spot) have fingerprint null and are groups of their own;
repeated rows
give one row; an id repeated with different texts is several documents; a null
``doc_id`` takes part, but is a group's id only if no other member has one;
an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm import nearsets
from corpusloom.llm.minhash import exact_jaccard, node_of
from corpusloom.llm.textkit import as_long, column, mix64, pieces, slices, word_hashes
from corpusloom.session import cut, free

ANCHORS = (
    "the a an is was be to of and der die das und ist ein eine den zu le la les un une est et de des el los las una es y"
).split()
SPOTS = ANCHORS
CHAIN, DISTANCE = 3, 1
THRESHOLD = 0.6


def spot_sets(texts: list[str | None], chain: int = CHAIN, distance: int = DISTANCE) -> list[np.ndarray]:
    """Sorted distinct spot hashes of each text."""
    stop = np.unique(word_hashes(ANCHORS)[0])
    lead = np.unique(word_hashes(SPOTS)[0])
    out: list[np.ndarray] = []
    for part in pieces(texts):
        w, off = word_hashes(texts[part])
        common = np.isin(w, stop)
        content = np.flatnonzero(~common)
        words = w[content]
        anchor = np.flatnonzero(common)
        anchor = anchor[np.isin(w[anchor], lead)]
        doc = np.searchsorted(off, anchor, side="right") - 1
        first = np.searchsorted(content, anchor)
        last = first + distance * (chain - 1)
        whole = last < np.searchsorted(content, off[doc + 1])
        anchor, doc, first = anchor[whole], doc[whole], first[whole]
        h = w[anchor].copy()
        with np.errstate(over="ignore"):
            for j in range(chain):
                h = mix64(h * np.uint64(3) + words[first + distance * j] * np.uint64(2 * j + 1))
        edge = np.searchsorted(doc, np.arange(len(off)))
        out += [np.unique(h[a:b]) for a, b in zip(edge, edge[1:])]
    return out


def word_node(text: str | None) -> int | None:
    """Id of a text by its words in order, or None for a text without words."""
    w = word_hashes([text])[0]
    if not len(w):
        return None
    with np.errstate(over="ignore"):
        x = mix64(mix64(np.arange(len(w), dtype=np.uint64)) ^ w).sum(dtype=np.uint64) + np.uint64(len(w))
    return int(as_long(mix64(np.array([x], dtype=np.uint64)))[0])


def entries(docs: DataFrame, chain: int, distance: int) -> DataFrame:
    """``value, node, size`` of every spot of every row; rows with the same spots repeat them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [s for s in spot_sets(column(b, "text"), chain, distance) if len(s)]
            if not sets:
                continue
            size = np.array([len(s) for s in sets], dtype=np.int32)
            node = np.array([node_of(s) for s in sets], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(as_long(np.concatenate(sets))), pa.array(np.repeat(node, size)), pa.array(np.repeat(size, size))],
                names=["value", "node", "size"],
            )

    return docs.select("text").mapInArrow(run, "value long, node long, size int")


def sets_of(docs: DataFrame, wanted: DataFrame, chain: int, distance: int) -> DataFrame:
    """``node, vals`` of the ``wanted`` nodes, one row a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [s for s in spot_sets(column(b, "text"), chain, distance) if len(s)]
            if not sets:
                continue
            off = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([node_of(s) for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(off), pa.array(as_long(np.concatenate(sets)))),
                ],
                names=["node", "vals"],
            )

    found = docs.select("text").mapInArrow(run, "node long, vals array<long>")
    return found.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("vals").alias("vals"))


def marks(docs: DataFrame, chain: int, distance: int, fallback: bool) -> DataFrame:
    """``doc_id, tkey, node, n_spots`` of every row; ``node`` identifies the set, or the words if there are no spots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = column(b, "text")
            sets = spot_sets(texts, chain, distance)
            node = [node_of(s) if len(s) or not fallback else word_node(t) for s, t in zip(sets, texts)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).cast(pa.int64()),
                    b.column(1),
                    pa.array(node, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                ],
                names=["doc_id", "tkey", "node", "n_spots"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text").mapInArrow(
        run, "doc_id long, tkey long, node long, n_spots long"
    )


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2), b.column(3)
            xv, yv = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
            xo, yo = x.offsets.to_numpy(), y.offsets.to_numpy()
            ok = [
                exact_jaccard(xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]]) >= threshold for i in range(b.num_rows)
            ]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    sa = sets.select(F.col("node").alias("a"), F.col("vals").alias("va"))
    sb = sets.select(F.col("node").alias("b"), F.col("vals").alias("vb"))
    short, long_ = F.least(F.size("va"), F.size("vb")), F.greatest(F.size("va"), F.size("vb"))
    both = pairs.join(sb, "b").join(sa, "a").where(short >= threshold * long_)
    return both.select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def fingerprints(
    docs: DataFrame, threshold: float = THRESHOLD, chain: int = CHAIN, distance: int = DISTANCE, fallback: bool = False
) -> DataFrame:
    """``doc_id, fingerprint, n_spots, group_id, group_size``: one row a document."""
    # The texts are read three times: that costs less than keeping every set.
    hot = nearsets.hot_values(docs, partial(entries, chain=chain, distance=distance))
    every = cut(nearsets.banded_lists(entries(docs, chain, distance), threshold, hot))
    lists = cut(nearsets.long_lists(every))
    free(every)
    sets = cut(sets_of(docs, lists.select("node").distinct(), chain, distance))
    comp = nearsets.group(lists, lambda pairs: _similar(pairs, sets, threshold), threshold)
    free(lists, sets)
    members = cut(
        marks(docs, chain, distance, fallback)
        .distinct()
        .join(comp, "node", "left")
        .select("doc_id", F.col("node").alias("fingerprint"), "n_spots", F.coalesce("comp", "node").alias("comp"))
    )
    head = (
        members.where("comp is not null")
        .groupBy("comp")
        .agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("size"))
    )
    return members.join(head, "comp", "left").select(
        "doc_id",
        "fingerprint",
        "n_spots",
        F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("head")).alias("group_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
    )
