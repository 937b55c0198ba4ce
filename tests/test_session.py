"""Materialised results: size estimates, files, and where they may lie."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark import SparkConf
from pyspark.sql import functions as F

from corpusloom import session


def planned_bytes(df) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def test_size_estimates_do_not_multiply(spark):
    """Twenty rounds of joins with tables derived from the result before."""
    df = session.cut(spark.range(50).select("id", (F.col("id") + 1).alias("next")))
    for _ in range(20):
        hop = df.select(F.col("id").alias("next"), F.col("next").alias("far"))
        old, df = df, session.cut(df.join(hop, "next").select("id", F.col("far").alias("next")).union(df).distinct().limit(50))
        session.free(old)
        assert planned_bytes(df) < 1 << 20
    assert df.count() == 50


def test_freed_files_are_gone_and_others_stay(spark):
    a, b = session.cut(spark.range(3)), session.cut(spark.range(4))
    paths = [Path(x.inputFiles()[0].removeprefix("file://")).parent for x in (a, b)]
    session.free(a, None, spark.range(1))
    assert not paths[0].exists() and paths[1].exists() and b.count() == 4
    assert session.cut(b.limit(0)).count() == 0


def test_folders_are_plain_paths_on_the_default_file_system_only(spark):
    folder = session.scratch(spark)
    assert Path(folder).is_dir() and session.plain(spark, f"file:{folder}") == session.plain(spark, folder) == folder
    assert session.plain(spark, "hdfs://127.0.0.1:9/a/b") == "hdfs://127.0.0.1:9/a/b"


def test_a_cluster_must_name_a_shared_folder(spark, monkeypatch):
    class Elsewhere:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: SparkConf(loadDefaults=False))
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Elsewhere()

    with pytest.raises(ValueError, match="checkpoint"):
        session.ensure_checkpoint_dir(Session())
