"""Incremental analysis: a stored snapshot of records, keyed by path, time, size and configuration."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.session import file_system, grows


def cache_key(config_hash: str) -> Column:
    """Key of a file's record; a changed configuration misses too."""
    return F.concat_ws(":", F.col("path"), F.format_string("%.3f", F.col("mtime")), F.col("size").cast("string"), F.lit(config_hash))


def misses(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files without a stored record."""
    return files.join(grows(stored.select("key")), "key", "left_anti")


def hits(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored records of the given files; records of vanished files are left out."""
    return stored.join(grows(files.select("key")), "key", "left_semi")


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest complete snapshot, or an empty one where there is none."""
    fs, marks = file_system(spark, f"{path}/v*/_SUCCESS")
    found = fs.globStatus(marks)
    folders = sorted((str(f.getPath().getParent()) for f in found or []), key=lambda p: p.rsplit("/", 1)[-1])
    return spark.read.parquet(folders[-1]) if folders else spark.createDataFrame([], schema)


def store(records: DataFrame, path: str, version: int) -> str:
    """Writes a new snapshot beside the older ones, so that a failed write changes nothing."""
    out = f"{path}/v{version:012d}-{uuid.uuid4().hex[:8]}"
    records.write.parquet(out)
    return out
