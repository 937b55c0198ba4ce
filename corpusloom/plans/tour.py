"""A short guided tour of a corpus, and its text for reading aloud."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

STEPS = 6


def overview(files: DataFrame) -> DataFrame:
    """``step, title, explanation, path``: the best entrypoint, hotspots up to six steps, a summary."""
    best = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("priority_score"), "path"))
    # Window.partitionBy of two kinds would move all rows to two tasks; both lists are bounded first.
    front = files.where("entrypoint").orderBy(F.desc("priority_score"), "path").limit(1).withColumn("kind", F.lit(0))
    hot = files.orderBy(F.desc("priority_score"), "path").limit(STEPS + 1).withColumn("kind", F.lit(1))
    hot = hot.join(front.select("path"), "path", "left_anti")
    cols = ["kind", "path", "role_hint", "priority_score", "criticality", "fan_in", "domain"]
    picked = front.select(cols).unionByName(hot.select(cols)).withColumn("r", best)
    step = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("kind", "r"))  # at most 8 rows
    name = F.element_at(F.split("path", "/"), -1)
    stops = picked.withColumn("step", step).where(F.col("step") <= STEPS).select(
        "step",
        F.when(F.col("kind") == 0, F.lit("Main entrypoint")).otherwise(F.concat(F.lit("Hotspot: "), name)).alias("title"),
        F.when(F.col("kind") == 0, F.concat(F.lit("Execution starts in "), "path", F.lit(": "), "role_hint"))
        .otherwise(F.format_string("Priority %d, criticality %s, %d dependents, domain %s", "priority_score", "criticality", "fan_in", "domain"))
        .alias("explanation"),
        "path",
    )
    last = files.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("domain")).alias("d"))
    at = stops.agg((F.coalesce(F.max("step"), F.lit(0)) + 1).alias("step"))
    summary = last.crossJoin(at).select(
        "step",
        F.lit("Summary").alias("title"),
        F.concat(F.format_string("%d files in %d domains: ", "n", F.size("d")), F.array_join("d", ", ")).alias("explanation"),
        F.lit(None).cast("string").alias("path"),
    )
    return stops.unionByName(summary).orderBy("step")


_SPOKEN = [("__", " dunder "), (r"\.py\b", " dot pie"), (r"\.js\b", " dot jay ess"), ("([a-z0-9])(?=[A-Z])", r"\1 "), ("_", " "), (" +", " ")]


def spoken(text: str) -> str:
    for pattern, to in _SPOKEN:
        text = re.sub(pattern, to, text)
    return text.strip()


def script(project: str, steps: list[dict]) -> str:
    """Narration of the steps, one paragraph each."""
    out = [f"A tour of {spoken(project)}."]
    for s in sorted(steps, key=lambda s: s["step"]):
        where = f" In {spoken(s['path'])}." if s["path"] else ""
        out.append(f"Step {s['step']}: {spoken(s['title'])}. {spoken(s['explanation'])}.{where}")
    return "\n".join(out)
