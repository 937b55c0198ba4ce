"""Session helpers: defaults for local runs and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings for runs this project starts itself; a cluster brings its own.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for k, v in LOCAL_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    A cluster names it and it is used as it is.  Only where the setting is
    absent and the whole session runs on this machine, as in tests, a
    temporary folder is chosen; elsewhere the other machines could not read
    it, so that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    have = sc.getCheckpointDir()
    if have is None:
        have = named
        if have is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            have = tempfile.mkdtemp(prefix="corpusloom-ckpt-")
            fs, path = file_system(spark, have)
            fs.deleteOnExit(path)
        sc.setCheckpointDir(have)
    return have


_SCRATCH: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """This application's own folder under the shared one; it goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpusloom-{app}-{uuid.uuid4().hex[:8]}"
        fs, path = file_system(spark, folder)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _SCRATCH[app] = plain(spark, folder)
    return _SCRATCH[app]


def plain(spark: SparkSession, folder: str) -> str:
    """``folder`` without scheme and host where these are the default file system's, else as it is.

    Spark names the checkpoint folder by a URI, ``file:`` on one machine.
    """
    fs, path = file_system(spark, folder)
    default, _ = file_system(spark, "/")
    return path.toUri().getPath() if fs.getUri().equals(default.getUri()) else folder


def file_system(spark: SparkSession, folder: str) -> tuple:
    """The Hadoop file system of a path or URI, and the path in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as Parquet in the shared folder and read it again.

    That drops the lineage *and* the planner's size estimate: the result has
    the size of its files, however often it was joined with itself before.
    The files survive the loss of any executor, readers take only the columns
    they need, and ``free`` removes them.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_cut_path"] = path
    return out


def grows(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the input: sorted and merged, never broadcast.

    The planner guesses sizes from files.  Parquet packs paths many times over,
    a few columns count as their share of the file, and ``explode`` counts for
    nothing; so what it takes for less than the broadcast threshold may be
    hundreds of megabytes, and all of them would pass through the driver.
    """
    return df.hint("merge")


def free(*frames: DataFrame | None) -> None:
    """Remove the files of results of ``cut`` that nothing reads any more."""
    for df in frames:
        path = None if df is None else df.__dict__.pop("_cut_path", None)
        if path is not None:
            fs, at = file_system(df.sparkSession, path)
            fs.delete(at, True)


def ship(spark: SparkSession) -> None:
    """Let Python workers on this machine import this package, wherever it lies."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
