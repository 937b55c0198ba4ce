"""Distributed running totals, and narrow plans that meet their texts once.

Running totals use two window levels instead of one global window.

Rows are put into ordered buckets of about ``BUCKET_ROWS``; the bucket totals
(hundreds of thousands of times fewer than the rows) are summed by one window
per group, and each bucket's rows by another.  Buckets are the partitions of a
range partitioning, whose bounds come from a sample: outliers and clusters of
ids do not fill one of them, and rows equal in id and ties, however many, are
spread by a seeded number.  The order is that of the ids and ties, so the result
depends neither on file layout nor on partitioning, but for which of several
rows that are equal in all of these comes first.

Ranks, totals and placements are made on narrow rows, keyed by ``key_columns``;
``meet`` then joins them with the texts in the only shuffle that moves these.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from corpusloom.session import cut

#: Rows a bucket aims at.
BUCKET_ROWS = 1 << 18
SEED = 17


def bucketed(df: DataFrame, id_col: str, ties: list[str], rows: int) -> DataFrame:
    """``df``, cut, with ``rt_bucket``: non-decreasing in the id (nulls first) and the ties."""
    tasks = max(1, ceil(df.count() / rows))
    keys = [F.col(id_col).asc_nulls_first(), *ties, "rt_salt"]
    ranged = df.withColumn("rt_salt", F.rand(SEED)).repartitionByRange(tasks, *keys).drop("rt_salt")
    return cut(ranged.withColumn("rt_bucket", F.spark_partition_id().cast("long")))


def running_total(
    df: DataFrame,
    groups: list[str],
    id_col: str,
    ties: list[str],
    value: Column,
    out: str,
    rows: int = BUCKET_ROWS,
    dense: bool = False,
) -> DataFrame:
    """``df`` with ``out``: the total of ``value`` over all earlier rows of the group.

    Rows are ordered by ``id_col`` (nulls first), then ``ties``.  A null group
    is a group.  ``dense`` ids are the numbers from 0 up, so their buckets are
    computed.  The columns of ``df`` must not begin with ``rt_``.
    """
    df = df.withColumn("rt_value", value.cast("long"))
    if dense:
        df = df.withColumn("rt_bucket", F.floor(F.col(id_col) / rows).cast("long"))
    else:
        df = bucketed(df, id_col, ties, rows)
    before = Window.partitionBy(*groups).orderBy("rt_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*groups, "rt_bucket").agg(F.sum("rt_value").alias("rt_sum"))
    base = sums.select(
        *(F.col(g).alias(f"rt_{g}") for g in groups),
        F.col("rt_bucket").alias("rt_b"),
        F.coalesce(F.sum("rt_sum").over(before), F.lit(0)).alias("rt_base"),
    )
    same = F.col("rt_bucket") == F.col("rt_b")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"rt_{g}"))
    inner = (
        Window.partitionBy(*groups, "rt_bucket")
        .orderBy(F.col(id_col).asc_nulls_first(), *ties)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = df.join(base, same)
    total = F.col("rt_base") + F.coalesce(F.sum("rt_value").over(inner), F.lit(0))
    return joined.withColumn(out, total).select(*[c for c in df.columns if not c.startswith("rt_")], out)


def key_columns(*carried: str) -> list[Column]:
    """``kid, tkey``: a null-free key of a row by its id, its text and the ``carried`` columns."""
    id_ = F.col("doc_id").cast("long")
    return [
        F.coalesce(id_, F.lit(-(2**63))).alias("kid"),
        F.xxhash64(id_.isNull(), F.col("text"), *carried).alias("tkey"),
    ]


def meet(docs: DataFrame, placed: DataFrame, fields: list[str], carried: list[str]) -> DataFrame:
    """``doc_id, text``, the carried columns and ``items``: all of a key's ``fields`` of ``placed``.

    Rows repeated in full have one key; one of them carries the items of all.
    """
    items = placed.groupBy("kid", "tkey").agg(F.collect_list(F.struct(*fields)).alias("items"))
    texts = docs.select(*key_columns(*carried), F.col("doc_id").cast("long").alias("doc_id"), "text", *carried)
    first = F.row_number().over(Window.partitionBy("kid", "tkey").orderBy("kid"))
    # A broadcast would grow with the corpus; the merge join leaves the order that the window needs.
    both = texts.join(items.hint("merge"), ["kid", "tkey"]).withColumn("copy", first)
    return both.where("copy = 1").select("doc_id", "text", *carried, "items")
