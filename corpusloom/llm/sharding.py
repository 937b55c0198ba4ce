"""Reproducible global shuffle: a Feistel permutation over global row numbers.

Rows are numbered in order of ``doc_id``.  A balanced Feistel network permutes
``[0, m * m)`` with ``m = ceil(sqrt(n))``; cycle walking (apply again while the
result is ``n`` or more) turns that into a permutation of ``[0, n)``.  The
permuted number gives shard and slot by division, and both can be computed for
any row, or the row for any slot, without touching the data.

Defined results: rows with a null ``doc_id`` are numbered first; repeated ids
get distinct numbers (which of them gets which is not told apart, as the
result holds only the id); texts are not read, so null, empty and very long
ones are equal; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.ranks import running_total

ROUNDS = 4
PRIME = 2**31 - 1
SEED = 20240607
SHARD_ROWS = 1000


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Multiplier, offset and offset of each round, all below ``PRIME``."""
    x, keys = seed & (2**64 - 1), []
    for _ in range(rounds):
        key = []
        for _ in range(3):
            x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
            z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
            z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
            key.append(1 + ((z ^ (z >> 31)) % (PRIME - 1)))
        keys.append(tuple(key))
    return keys


def side(n: int) -> int:
    """The least ``m`` with ``m * m >= n``."""
    return max(1, isqrt(max(0, n - 1)) + 1) if n > 1 else 1


def _f(r: np.ndarray, key: tuple[int, int, int], m: int) -> np.ndarray:
    a, b, c = key
    x = (r * a + b) % PRIME
    return (x * x + c) % PRIME % m


def _once(x: np.ndarray, m: int, keys: list[tuple[int, int, int]], inverse: bool) -> np.ndarray:
    left, right = x // m, x % m
    if inverse:
        for k in reversed(keys):
            left, right = (right - _f(left, k, m)) % m, left
    else:
        for k in keys:
            left, right = right, (left + _f(right, k, m)) % m
    return left * m + right


def permute(x: np.ndarray, n: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """Permuted numbers (or their origins) of ``x``, all in ``[0, n)``."""
    m, keys = side(n), round_keys(seed)
    out = _once(np.asarray(x, dtype=np.int64), m, keys, inverse)
    while len(walk := np.flatnonzero(out >= n)):
        out[walk] = _once(out[walk], m, keys, inverse)
    return out


def shard_documents(docs: DataFrame, shard_rows: int = SHARD_ROWS, seed: int = SEED) -> DataFrame:
    """``doc_id, row_number, position, shard, slot`` of every row."""
    ids = docs.select("doc_id")
    n = ids.count()
    numbered = running_total(ids, [], "doc_id", [], F.lit(1), "row_number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = permute(b.column(1).to_numpy(), n, seed)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(p), pa.array(p // shard_rows), pa.array(p % shard_rows)],
                names=["doc_id", "row_number", "position", "shard", "slot"],
            )

    return numbered.mapInArrow(run, "doc_id long, row_number long, position long, shard long, slot long")


def oracle(shard_rows: int = SHARD_ROWS, seed: int = SEED) -> str:
    """The same in DuckDB SQL; a recursive CTE walks the cycles."""

    def network(x: str) -> str:
        left, right = f"({x} // m)", f"({x} % m)"
        steps = [f"SELECT *, {left} AS l0, {right} AS r0 FROM src"]
        for i, (a, b, c) in enumerate(round_keys(seed)):
            f1 = f"((r{i} * {a} + {b}) % {PRIME})"
            f2 = f"(({f1} * {f1} + {c}) % {PRIME} % m)"
            steps.append(f"SELECT *, r{i} AS l{i + 1}, (l{i} + {f2}) % m AS r{i + 1} FROM t{i}")
        inner = steps[0]
        for i, s in enumerate(steps[1:]):
            inner = s.replace(f"FROM t{i}", f"FROM ({inner})")
        return f"SELECT doc_id, row_number, n, m, l{ROUNDS} * m + r{ROUNDS} AS p FROM ({inner})"

    first = network("row_number").replace("FROM src", "FROM rows_")
    again = network("p").replace("FROM src", "FROM (SELECT * FROM walk WHERE p >= n)")
    return f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS row_number, count(*) OVER () AS n,
    greatest(1, CAST(ceil(sqrt(count(*) OVER ())) AS BIGINT)) AS m
  FROM documents),
walk AS ({first} UNION ALL {again})
SELECT doc_id, row_number, p AS position, p // {shard_rows} AS shard, p % {shard_rows} AS slot FROM walk WHERE p < n
"""
