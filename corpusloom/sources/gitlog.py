"""Version-control sources: commit log lines and change counts."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, functions as F

FORMAT = "%x1f".join(["%H", "%an", "%ae", "%ai", "%s"])
TIMEOUT_S = 15


def run_git(args: list[str], root: str) -> str:
    """Output of a git command, '' on any failure."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=TIMEOUT_S, check=False)
    except (OSError, subprocess.SubprocessError):
        return ""
    return done.stdout.strip() if done.returncode == 0 else ""


def is_repo(root: str) -> bool:
    return run_git(["rev-parse", "--is-inside-work-tree"], root) == "true"


def parse_log(lines: DataFrame) -> DataFrame:
    """``hash, author, email, date, message`` of lines (``value``) with exactly five fields."""
    f = F.split("value", "\x1f", -1)
    ok = lines.select(f.alias("f")).where(F.size("f") == 5)
    return ok.select(
        F.substring(F.col("f")[0], 1, 12).alias("hash"),
        *[F.col("f")[i].alias(c) for i, c in enumerate(("author", "email", "date", "message"), 1)],
    )


def _lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in text.splitlines()], "value string")


def recent_commits(spark: SparkSession, root: str, n: int = 10) -> DataFrame:
    return parse_log(_lines(spark, run_git(["log", "-n", str(n), f"--pretty=format:{FORMAT}"], root)))


def diff_stat(root: str) -> str:
    return run_git(["diff", "HEAD", "--stat"], root)


def change_counts(files: DataFrame) -> DataFrame:
    """``file, changes`` from one row per changed file."""
    named = files.select(F.trim("file").alias("file")).where("file != ''")
    return named.groupBy("file").agg(F.count(F.lit(1)).alias("changes"))


def change_frequency(spark: SparkSession, root: str, commits: int = 100) -> DataFrame:
    names = run_git(["log", "-n", str(commits), "--name-only", "--pretty=format:"], root)
    return change_counts(_lines(spark, names).withColumnRenamed("value", "file"))
