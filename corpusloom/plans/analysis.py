"""The batch analysis as one lazy plan: scan, features, resolve, classify, graph, score."""

from __future__ import annotations

import hashlib
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions.rules import RuleConfig
from corpusloom.operators import classify, extract, graph, resolve, score
from corpusloom.session import cut, grows
from corpusloom.sources import snapshot


@dataclass
class Analysis:
    """Results over one set of files; every member is a lazy DataFrame over cut parts."""

    files: DataFrame
    edges: DataFrame
    resolved: DataFrame

    @property
    def nodes(self) -> DataFrame:
        return self.files.select("path")


def extracted(
    files: DataFrame, security: bool = True, chunk_tokens: int | None = None, cache: str | None = None, config_hash: str = ""
) -> DataFrame:
    """Features of ``files``, cut.

    With a ``cache`` folder, ``files`` has ``mtime`` and ``size`` too; only files
    without a record of their path, time, size and configuration are extracted,
    and the new snapshot of all records is written beside the older ones.
    """
    if cache is None:
        return cut(extract.features(files, security, chunk_tokens))
    spark = files.sparkSession
    columns = [n for n, _, _ in extract.COLUMNS]
    keyed = files.withColumn("key", snapshot.cache_key(f"{config_hash}/{security}/{chunk_tokens}"))
    stored = snapshot.load(spark, cache, "key string, " + ", ".join(f"{n} {t}" for n, t, _ in extract.COLUMNS))
    if not set(columns) <= set(stored.columns):  # written by another version
        stored = stored.limit(0).select("key", *(F.lit(None).cast(t).alias(n) for n, t, _ in extract.COLUMNS))
    old = snapshot.hits(keyed, stored).select("key", *columns)
    new = extract.features(snapshot.misses(keyed, stored).select("path", "src"), security, chunk_tokens)
    now = old.unionByName(new.join(grows(keyed.select("path", "key")), "path").select("key", *columns))
    folder = snapshot.store(now, cache, time.time_ns() // 1_000_000)
    return spark.read.parquet(folder).select(*columns)


def records(
    files: DataFrame,
    config: RuleConfig = RuleConfig(),
    aliases=None,
    bare_names=None,
    security: bool = True,
    chunk_tokens: int | None = None,
    cache: str | None = None,
):
    """Classified features with dependencies, and the resolved imports; both are cut."""
    feats = extracted(files, security, chunk_tokens, cache, hashlib.sha256(repr(config).encode()).hexdigest()[:16])
    resolved = cut(resolve.resolve(resolve.import_specs(feats), feats.select("path"), aliases, bare_names))
    none = F.array().cast("array<string>")
    joined = feats.join(grows(resolve.dependencies(resolved)), "path", "left").withColumns(
        {c: F.coalesce(c, none) for c in ("internal", "external")}
    )
    return cut(classify.classify(joined, config)), resolved


def graded(recs: DataFrame, resolved: DataFrame) -> Analysis:
    """Graph metrics and scores over the results of ``records``."""
    edges = cut(resolve.edges(resolved))
    nodes = recs.select("path")
    full = (
        recs.join(grows(graph.degrees(nodes, edges)), "path")
        .join(grows(graph.pagerank(nodes, edges)), "path")
        .join(grows(graph.radii(nodes, edges)), "path")
        .join(grows(graph.components(nodes, edges)), "path", "left")
        .withColumn("is_in_cycle", F.col("scc_id").isNotNull())
    )
    full = full.withColumn("impact_radius", F.when(F.col("fan_out") > 0, F.col("impact_radius")).otherwise(0))
    full = full.withColumns({"refactor_effort": score.refactor_effort(), "warnings": score.graph_warnings()})
    return Analysis(cut(score.contexts(score.with_scores(full))), edges, resolved)


def analyse(files: DataFrame, config: RuleConfig = RuleConfig(), aliases=None, bare_names=None, security: bool = True, **kept) -> Analysis:
    """All per-file and graph columns of ``files`` (``path, src``); ``kept`` are ``chunk_tokens`` and ``cache`` of ``records``."""
    return graded(*records(files, config, aliases, bare_names, security, **kept))
