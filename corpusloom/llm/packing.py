"""Sequence packing: shortest-pack-first over the length histogram.

Documents become chunks of at most ``pack_tokens`` tokens (a longer document
gives several full chunks and a rest).  The histogram of chunk lengths, whose
size is bounded by ``pack_tokens`` whatever the corpus, is packed on the
driver: lengths are placed longest first, each into the open packs that are
shortest so far, and only pattern counts are updated.  Each pattern then owns
a range of ranks of every length in it, so a chunk finds its pack and position
from its rank among the chunks of its length, without any search in the data.
Ranks and packs are found on narrow rows; texts move once, to be cut.

Defined results: null texts and texts without tokens have no chunk; a null
``doc_id`` ranks first and is carried; rows with equal ids rank by text, and
repeated rows are each packed; very long texts are chunked whole; an empty
table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.ranks import key_columns, meet, running_total
from corpusloom.llm.textkit import column, slices
from corpusloom.llm.tokens import count_tokens, parts
from corpusloom.session import cut

PACK_TOKENS = 2048
#: Documents a rank bucket aims at; each is split further by chunk length.
BUCKET_ROWS = 1 << 18
SCHEMA = "pack_id long, position long, doc_id long, first_token long, n_tokens long, text string"

Pattern = list[tuple[int, int]]


def pack_histogram(histogram: dict[int, int], size: int) -> list[tuple[int, Pattern]]:
    """Packs as ``(count, pattern)``; a pattern lists ``(length, times)`` in placing order.

    Lengths go longest first.  The shortest open pack takes a length if it
    fits (ties: the pack that was left alone longest), otherwise a new pack
    opens and takes this length as often as it holds.  Equal packs are one
    group with a count, split where it is larger than what is left to place,
    so the work depends on the patterns and not on the number of documents.
    """
    closed: list[tuple[int, Pattern]] = []
    # (-room, age, count, pattern): the shortest pack has most room
    open_: list[tuple[int, int, int, Pattern]] = []
    age = 0
    for length in sorted(histogram, reverse=True):
        left, most = histogram[length], size // length
        while left:
            age += 1
            if open_ and -open_[0][0] >= length:
                room, old, count, pattern = heapq.heappop(open_)
                room = -room
                if count > left:
                    heapq.heappush(open_, (-room, old, count - left, pattern))
                    count = left
                times = 1
                if pattern[-1][0] == length:
                    pattern = [*pattern[:-1], (length, pattern[-1][1] + 1)]
                else:
                    pattern = [*pattern, (length, 1)]
            else:
                room, times = size, min(most, left)
                count, pattern = left // times, [(length, times)]
            left -= count * times
            room -= length * times
            if room:
                heapq.heappush(open_, (-room, age, count, pattern))
            else:
                closed.append((count, pattern))
    return closed + [(count, pattern) for _, _, count, pattern in sorted(open_, key=lambda x: x[:3])]


def rank_ranges(packs: list[tuple[int, Pattern]]) -> dict[int, np.ndarray]:
    """For each length, rows ``first rank, first pack, times, first position`` in rank order."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    first_pack = 0
    for count, pattern in packs:
        position = 0
        for length, times in pattern:
            rank = used.get(length, 0)
            rows.setdefault(length, []).append((rank, first_pack, times, position))
            used[length] = rank + count * times
            position += times
        first_pack += count
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def counted(docs: DataFrame) -> DataFrame:
    """``doc_id, kid, tkey, n`` of every row with tokens; the only pass that counts them."""
    n = count_tokens("text").cast("long").alias("n")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *key_columns(), n).where("n > 0")


def chunks(rows: DataFrame, size: int) -> DataFrame:
    """``doc_id, kid, tkey, first_token, n_tokens`` of every chunk."""
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(size).cast("long")))
    return rows.withColumn("first_token", first).select(
        "doc_id", "kid", "tkey", "first_token", F.least(F.lit(size), F.col("n") - F.col("first_token")).alias("n_tokens")
    )


def length_histogram(rows: DataFrame, size: int) -> dict[int, int]:
    """Chunks of each length; at most ``size`` entries."""
    full = F.struct(F.lit(size).cast("long").alias("length"), F.expr(f"n div {size}").alias("times"))
    rest = F.struct((F.col("n") % size).alias("length"), F.lit(1).cast("long").alias("times"))
    each = rows.select(F.explode(F.array(full, rest)).alias("x")).where("x.length > 0 and x.times > 0")
    return {r.length: r.times for r in each.groupBy("x.length").agg(F.sum("x.times").alias("times")).collect()}


def pack(docs: DataFrame, size: int = PACK_TOKENS) -> DataFrame:
    """``pack_id, position, doc_id, first_token, n_tokens, text`` of every chunk."""
    rows = cut(counted(docs))
    ranges = rank_ranges(pack_histogram(length_histogram(rows, size), size))
    shared = docs.sparkSession.sparkContext.broadcast(ranges)
    ranked = running_total(
        chunks(rows, size), ["n_tokens"], "doc_id", ["tkey", "first_token"], F.lit(1), "rank", BUCKET_ROWS
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = b.column(3).to_numpy(), b.column(4).to_numpy()
            packs, places = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for length in np.unique(n):
                at = np.flatnonzero(n == length)
                found = shared.value[int(length)]
                k = np.searchsorted(found[:, 0], rank[at], side="right") - 1
                step = rank[at] - found[k, 0]
                packs[at] = found[k, 1] + step // found[k, 2]
                places[at] = found[k, 3] + step % found[k, 2]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(4)), pa.array(packs), pa.array(places)],
                names=["kid", "tkey", "first_token", "n_tokens", "pack_id", "position"],
            )

    placed = ranked.select("kid", "tkey", "first_token", "n_tokens", "rank").mapInArrow(
        place, "kid long, tkey long, first_token long, n_tokens long, pack_id long, position long"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (*(pa.int64(),) * 5, pa.string())
        for b in slices(batches):
            out: list[tuple] = []
            for i, t, items in zip(column(b, "doc_id"), column(b, "text"), column(b, "items")):
                whole = len(items) == 1 and items[0]["first_token"] == 0 and items[0]["n_tokens"] < size
                texts = [t] if whole else parts(t, [(x["first_token"], x["first_token"] + x["n_tokens"]) for x in items])
                out += [(x["pack_id"], x["position"], i, x["first_token"], x["n_tokens"], p) for x, p in zip(items, texts)]
            cols = zip(*out) if out else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)],
                names=["pack_id", "position", "doc_id", "first_token", "n_tokens", "text"],
            )

    return meet(docs, placed, ["pack_id", "position", "first_token", "n_tokens"], []).mapInArrow(run, SCHEMA)
