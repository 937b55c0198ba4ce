"""Incremental extraction: new and changed files as a stream, features as a table.

Each micro-batch overwrites its own folder, so a batch that is run again after
a failure leaves one result.  Only row-local features are kept; the graph
stages start from ``latest``.  Spark's streaming file source leaves out names that
begin with ``_`` or ``.``; ``scan.scan`` takes these too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators import extract
from corpusloom.session import file_system, ship
from corpusloom.sources import scan

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch(
    spark: SparkSession, root: str, out: str, checkpoint: str, config: scan.ScanConfig = scan.ScanConfig(), once: bool = True
) -> StreamingQuery:
    """Starts the stream; with ``once`` it ends when all present files are done."""
    ship(spark)
    base = scan._uri(root)
    fs, path = file_system(spark, base)
    base = fs.makeQualified(path).toString()
    raw = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .load(base)
    )

    def batch(df: DataFrame, number: int) -> None:
        files = scan.sources(df, scan.below("path", base), config)
        facts = extract.features(files.select("path", "src"))
        facts.join(files.select("path", "size", "mtime"), "path").write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The newest features of every file seen."""
    rows = spark.read.parquet(out)
    newest = rows.groupBy("path").agg(F.max(F.struct("mtime", "batch")).alias("m"))
    keep = newest.select("path", F.col("m.mtime").alias("mtime"), F.col("m.batch").alias("batch"))
    return rows.join(keep, ["path", "mtime", "batch"], "left_semi").drop("batch")
