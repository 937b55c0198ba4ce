"""Mixing sources to target weights, by fixed-length blocks of tokens.

1. Each source's documents, in order of id, are one token stream, cut into
   blocks of ``block_tokens`` tokens (the last block of a source may be short,
   so no token is lost).
2. The output has as many blocks as the input, in shards of ``shard_blocks``
   slots.  Each shard draws its source counts from one multinomial with the
   target weights, seeded by the shard's number.
3. The ``j``-th draw of a source over all shards takes block ``perm(j mod n)``
   of the source's ``n`` blocks, where ``perm`` is a Feistel permutation keyed
   by source and epoch ``j div n``: no block repeats before all were used.
4. Slots and blocks are joined by source and block index, on narrow rows; the
   texts move once, to be cut.

Target weights default to the sources' token counts to the power ``ALPHA``.

Defined results: null texts and texts without tokens have no block; a null
source is a source (named null); a null ``doc_id`` comes first in its source;
equal ids are ordered by text, repeated rows each count; very long texts span
many blocks; a source with weight 0 or without tokens is never drawn; an empty
table, or weights that are all 0, give an empty result; more than
``MAX_SOURCES`` sources are an error; other columns than
``doc_id, text, lang, source`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm import sharding
from corpusloom.llm.ranks import key_columns, meet, running_total
from corpusloom.llm.textkit import column, slices
from corpusloom.llm.tokens import count_tokens, parts
from corpusloom.session import cut

BLOCK_TOKENS = 1024
SHARD_BLOCKS = 256
#: Shards whose draws one task adds up.
SHARDS_A_BUCKET = 1 << 14
#: More sources than this are refused: their table is held on the driver and in every task.
MAX_SOURCES = 10_000
ALPHA = 0.7
SEED = 7
SCHEMA = (
    "shard long, slot long, place long, source string, epoch long, block long, doc_id long, lang string,"
    " first_token long, n_tokens long, text string"
)
NAMES = [c.split()[0] for c in SCHEMA.split(",")]
KINDS = [pa.string() if c.endswith("string") else pa.int64() for c in SCHEMA.split(",")]


def draw(shard: int, blocks: int, weights: np.ndarray, seed: int) -> np.ndarray:
    """How many blocks a shard takes from each source."""
    return np.random.default_rng([seed, shard]).multinomial(blocks, weights)


def slot_order(shard: int, blocks: int, seed: int) -> np.ndarray:
    """The slots of a shard in the order in which its draws fill them."""
    return np.random.default_rng([seed, shard, 1]).permutation(blocks)


def block_of(draws: np.ndarray, source: int, n: int, seed: int) -> np.ndarray:
    """Block index of the given draws of a source that has ``n`` blocks."""
    out = np.empty(len(draws), dtype=np.int64)
    epoch = draws // n
    for e in np.unique(epoch):
        at = epoch == e
        out[at] = sharding.permute(draws[at] % n, n, seed * 1_000_003 + source * 7919 + int(e) * 104_729)
    return out


def source_table(docs: DataFrame, block_tokens: int, weights: dict | None) -> list[tuple[str | None, int, float]]:
    """``source, blocks, weight`` of every source with tokens and weight, nulls first."""
    rows = docs.groupBy("source").agg(F.sum("n").alias("n")).where("n > 0").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources to mix")
    rows.sort(key=lambda r: (r.source is not None, r.source))
    w = [float(r.n) ** ALPHA if weights is None else float(weights.get(r.source, 0.0)) for r in rows]
    total = sum(w)
    return [(r.source, -(-r.n // block_tokens), x / total) for r, x in zip(rows, w) if x > 0]


def slots(docs: DataFrame, sources: list, total: int, shard_blocks: int, seed: int) -> DataFrame:
    """``shard, slot, s, epoch, block`` of every output slot; ``s`` is the source's number."""
    spark = docs.sparkSession
    p = np.array([w for _, _, w in sources])
    p = p / p.sum()
    counts = [n for _, n, _ in sources]
    n_shards = -(-total // shard_blocks)

    def size(shard: int) -> int:
        return min(shard_blocks, total - shard * shard_blocks)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            got = np.array([draw(int(x), size(int(x)), p, seed) for x in ids], dtype=np.int64).reshape(-1, len(p))
            k, s = np.nonzero(got)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[k]), pa.array(s.astype(np.int64)), pa.array(got[k, s])], names=["shard", "s", "c"]
            )

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("shard", "slot", "s", "epoch", "block")}
            for shard, items in zip(column(b, "shard"), column(b, "items")):
                order, at = slot_order(shard, size(shard), seed), 0
                for x in sorted(items, key=lambda x: x["s"]):
                    j = np.arange(x["base"], x["base"] + x["c"])
                    n = counts[x["s"]]
                    out["shard"].append(np.full(len(j), shard))
                    out["slot"].append(order[at : at + len(j)])
                    out["s"].append(np.full(len(j), x["s"]))
                    out["epoch"].append(j // n)
                    out["block"].append(block_of(j, x["s"], n, seed))
                    at += len(j)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64)) for v in out.values()],
                names=list(out),
            )

    counted = spark.range(n_shards).mapInArrow(drawn, "shard long, s long, c long")
    based = running_total(counted, ["s"], "shard", [], F.col("c"), "base", SHARDS_A_BUCKET, dense=True)
    per_shard = based.groupBy("shard").agg(F.collect_list(F.struct("s", "c", "base")).alias("items"))
    return per_shard.mapInArrow(filled, "shard long, slot long, s long, epoch long, block long")


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    block_tokens: int = BLOCK_TOKENS,
    shard_blocks: int = SHARD_BLOCKS,
    seed: int = SEED,
) -> DataFrame:
    """Every part of every output slot, to be read in order of ``shard, slot, place``.

    ``shard, slot, place, source, epoch, block, doc_id, lang, first_token,
    n_tokens, text``: the part's ``n_tokens`` tokens begin at ``first_token``
    of the document and at ``place`` of the block.
    """
    n = count_tokens("text").cast("long").alias("n")
    # The only pass that counts tokens; all that follows up to the texts is narrow.
    rows = cut(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", *key_columns("lang", "source"), n).where("n > 0")
    )
    sources = source_table(rows, block_tokens, weights)
    everything = rows.groupBy("source").agg(F.sum("n").alias("n"))
    total = everything.agg(F.sum(F.ceil(F.col("n") / block_tokens))).first()[0] or 0
    if not sources:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    numbers = docs.sparkSession.createDataFrame([(s, i) for i, (s, _, _) in enumerate(sources)], "src string, s long")
    placed = running_total(rows, ["source"], "doc_id", ["tkey"], F.col("n"), "begin")
    first, last = F.expr(f"begin div {block_tokens}"), F.expr(f"(begin + n - 1) div {block_tokens}")
    spans = placed.join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("src"))).select(  # one row a source
        "kid", "tkey", "s", "begin", "n", F.explode(F.sequence(first, last)).alias("block")
    )
    drawn = cut(slots(docs, sources, total, shard_blocks, seed))
    # The draws grow with the corpus and their size is not known to the planner: never broadcast.
    where = spans.join(drawn.hint("merge"), ["s", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[tuple] = []
            for i, t, lang, src, items in zip(*(column(b, c) for c in ("doc_id", "text", "lang", "source", "items"))):
                ranges = [
                    (max(0, x["block"] * block_tokens - x["begin"]), min(x["n"], (x["block"] + 1) * block_tokens - x["begin"]))
                    for x in items
                ]
                whole = all(a == 0 and z == x["n"] for (a, z), x in zip(ranges, items))
                texts = [t] * len(items) if whole else parts(t, ranges)
                for (a, z), x, part in zip(ranges, items, texts):
                    place = x["begin"] + a - x["block"] * block_tokens
                    out.append((x["shard"], x["slot"], place, src, x["epoch"], x["block"], i, lang, a, z - a, part))
            cols = zip(*out) if out else ((),) * len(KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, KINDS)], names=NAMES)

    fields = ["shard", "slot", "epoch", "block", "begin", "n"]
    return meet(docs, where, fields, ["lang", "source"]).mapInArrow(run, SCHEMA)
