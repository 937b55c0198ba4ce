"""Graph metrics over ``edges(src, dst)`` and ``nodes(path)``.

Two-hop measures are joins.  PageRank and strongly connected components
iterate: graphs up to ``LOCAL_EDGES`` edges, a size that is checked, run in one
task; larger ones run as DataFrame loops that cut their lineage in the shared
folder.  Both ways give the same result.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpusloom.session import cut, free, grows

LOCAL_EDGES = 2_000_000
DAMPING, ITERATIONS, TOLERANCE = 0.85, 30, 1e-6


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``path, fan_in, fan_out`` of every node."""
    tagged = edges.select(F.col("src").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(
        edges.select(F.col("dst").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    )
    every = tagged.unionByName(nodes.select("path", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return every.groupBy("path").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def two_hop(edges: DataFrame) -> DataFrame:
    """Distinct ``src, dst`` at one or two steps (``src = dst`` on a 2-cycle).

    A file that a third of all files import meets its few own imports only: the
    rows of a join key are fan-in times fan-out, and a file's imports are few.
    Adaptive execution splits the long side.
    """
    second = edges.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
    return edges.unionByName(edges.join(grows(second), "dst").select("src", F.col("far").alias("dst"))).distinct()


def radii(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``path, impact_radius, blast_radius``: two-hop reach forward without, and backward with, the node itself."""
    reach = two_hop(edges)
    tagged = (
        reach.where("src != dst")
        .select(F.col("src").alias("path"), F.lit(1).alias("f"), F.lit(0).alias("b"))
        .unionByName(reach.select(F.col("dst").alias("path"), F.lit(0).alias("f"), F.lit(1).alias("b")))
        .unionByName(nodes.select("path", F.lit(0).alias("f"), F.lit(0).alias("b")))
    )
    return tagged.groupBy("path").agg(F.sum("f").alias("impact_radius"), F.sum("b").alias("blast_radius"))


def _in_one_task(nodes: DataFrame, edges: DataFrame, f, schema: str) -> DataFrame:
    both = edges.select("src", "dst").unionByName(nodes.select(F.col("path").alias("src"), F.lit(None).cast("string").alias("dst")))
    return both.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(lambda pdf: f(pdf), schema)


def _local_pagerank(pdf: pd.DataFrame) -> pd.DataFrame:
    names = np.sort(pdf.loc[pdf.dst.isna(), "src"].unique())
    e = pdf[pdf.dst.notna()]
    s, t = np.searchsorted(names, e.src.to_numpy()), np.searchsorted(names, e.dst.to_numpy())
    n = len(names)
    out = np.bincount(s, minlength=n).astype(float)
    rank = np.full(n, 1.0 / n)
    for _ in range(ITERATIONS):
        share = np.where(out > 0, rank / np.maximum(out, 1), 0.0)
        spread = np.bincount(t, weights=share[s], minlength=n) if len(s) else np.zeros(n)
        new = (1 - DAMPING) / n + DAMPING * (spread + rank[out == 0].sum() / n)
        moved = np.abs(new - rank).sum()
        rank = new
        if moved < TOLERANCE:
            break
    return pd.DataFrame({"path": names, "pagerank": rank / rank.sum()})


def pagerank(nodes: DataFrame, edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``path, pagerank``: damping 0.85, at most 30 rounds, dangling mass spread evenly, sum 1."""
    if edges.count() <= local_edges and nodes.count() <= local_edges:
        return _in_one_task(nodes, edges, _local_pagerank, "path string, pagerank double")
    n = nodes.count()
    outs = edges.groupBy("src").agg(F.count(F.lit(1)).alias("o"))
    links = cut(edges.join(grows(outs), "src"))
    held = rank = cut(nodes.join(grows(outs.withColumnRenamed("src", "path")), "path", "left").select("path", "o", F.lit(1.0 / n).alias("r")))
    for _ in range(ITERATIONS):
        dangling = rank.where("o is null").agg(F.sum("r")).first()[0] or 0.0
        got = links.join(grows(rank.select(F.col("path").alias("src"), "r")), "src").groupBy("dst").agg(F.sum(F.col("r") / F.col("o")).alias("in"))
        new = cut(
            rank.join(grows(got.withColumnRenamed("dst", "path")), "path", "left").select(
                "path",
                "o",
                F.col("r").alias("old"),
                ((1 - DAMPING) / n + DAMPING * (F.coalesce("in", F.lit(0.0)) + dangling / n)).alias("r"),
            )
        )
        moved = new.agg(F.sum(F.abs(F.col("r") - F.col("old")))).first()[0] or 0.0
        free(held)
        held, rank = new, new.select("path", "o", "r")
        if moved < TOLERANCE:
            break
    total = rank.agg(F.sum("r")).first()[0] or 1.0
    return rank.select("path", (F.col("r") / total).alias("pagerank"))


def _local_components(pdf: pd.DataFrame) -> pd.DataFrame:
    """Tarjan with an explicit stack; components of two nodes or more."""
    e = pdf[pdf.dst.notna()]
    after = defaultdict(list)
    for s, t in zip(e.src, e.dst):
        after[s].append(t)
    order, low, on, stack, out = {}, {}, set(), [], []
    for root in sorted(after):
        if root in order:
            continue
        work = [(root, iter(sorted(after[root])))]
        order[root] = low[root] = len(order)
        stack.append(root)
        on.add(root)
        while work:
            v, it = work[-1]
            nxt = next(it, None)
            if nxt is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == order[v]:
                    members = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        members.append(w)
                        if w == v:
                            break
                    if len(members) > 1:
                        out += [(m, min(members)) for m in members]
            elif nxt not in order:
                order[nxt] = low[nxt] = len(order)
                stack.append(nxt)
                on.add(nxt)
                work.append((nxt, iter(sorted(after.get(nxt, [])))))
            elif nxt in on:
                low[v] = min(low[v], order[nxt])
    return pd.DataFrame(out, columns=["path", "scc_id"]).astype(object)


def components(nodes: DataFrame, edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``path, scc_id`` of nodes in strongly connected components of two or more; the id is the least member."""
    if edges.count() <= local_edges and nodes.count() <= local_edges:
        return _in_one_task(nodes, edges, _local_components, "path string, scc_id string")
    return _coloured_components(edges)


def _coloured_components(edges: DataFrame) -> DataFrame:
    """Trim, colour forward by the least ancestor, walk back inside each colour; repeat on what is left."""
    spark, left, done = edges.sparkSession, cut(edges), None
    while True:
        while True:  # nodes without an edge in or out cannot be on a cycle
            ends = left.select(F.col("src").alias("v")).join(grows(left.select(F.col("dst").alias("v"))), "v", "left_semi").distinct()
            kept = cut(
                left.join(grows(ends.withColumnRenamed("v", "src")), "src", "left_semi")
                .join(grows(ends.withColumnRenamed("v", "dst")), "dst", "left_semi")
                .select("src", "dst")
            )
            same = kept.count() == left.count()
            free(left)
            left = kept
            if same:
                break
        if left.isEmpty():
            return done if done is not None else spark.createDataFrame([], "path string, scc_id string")
        shade = colour = cut(left.select(F.col("src").alias("v")).union(left.select("dst")).distinct().withColumn("c", F.col("v")))
        while True:
            came = left.join(grows(colour.withColumnRenamed("v", "src")), "src").groupBy("dst").agg(F.min("c").alias("n"))
            new = cut(
                colour.join(grows(came.withColumnRenamed("dst", "v")), "v", "left").select(
                    "v", F.least("c", "n").alias("c"), (F.col("n") < F.col("c")).alias("changed")
                )
            )
            free(shade)
            shade, colour = new, new.select("v", "c")
            if new.where("changed").isEmpty():
                break
        a = colour.select(F.col("v").alias("src"), F.col("c").alias("cs"))
        b = colour.select(F.col("v").alias("dst"), F.col("c").alias("cd"))
        inside = cut(left.join(grows(a), "src").join(grows(b), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("c")))
        seen = cut(colour.where("v = c").select("v"))
        front = seen
        while not front.isEmpty():
            front = cut(
                inside.join(grows(front.withColumnRenamed("v", "dst")), "dst", "left_semi")
                .select(F.col("src").alias("v"))
                .distinct()
                .join(grows(seen), "v", "left_anti")
            )
            seen = cut(seen.union(front))
        found = colour.join(grows(seen), "v", "left_semi")
        sizes = found.groupBy("c").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
        good = cut(found.join(grows(sizes), "c").select(F.col("v").alias("path"), F.col("c").alias("scc_id")))
        done = good if done is None else cut(done.union(good))
        left = cut(
            inside.select("src", "dst")
            .join(grows(seen.withColumnRenamed("v", "src")), "src", "left_anti")
            .join(grows(seen.withColumnRenamed("v", "dst")), "dst", "left_anti")
        )


def subgraph_nodes(edges: DataFrame, root: str, depth: int) -> DataFrame:
    """``path`` of all nodes within ``depth`` undirected steps of ``root``, itself included."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).toDF("src", "path")
    seen = edges.sparkSession.range(1).select(F.lit(root).alias("path"))
    for _ in range(depth):
        step = both.join(grows(seen.withColumnRenamed("path", "src")), "src", "left_semi").select("path")
        seen = seen.union(step).distinct()
    return seen


def subgraph_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(grows(nodes.withColumnRenamed("path", "src")), "src", "left_semi").join(
        grows(nodes.withColumnRenamed("path", "dst")), "dst", "left_semi"
    ).select("src", "dst")


def _local_chain(pairs: list, source: str, target: str) -> list[str]:
    near = defaultdict(set)
    for s, d in pairs:
        near[s].add(d)
    came, front = {source: None}, [source]
    while front and target not in came:
        # the front is in order of its chains, so who comes first has the least chain
        nxt = []
        for v in front:
            for u in sorted(near[v]):
                if u not in came:
                    came[u] = v
                    nxt.append(u)
        front = nxt
    chain, v = [], target if target in came else None
    while v is not None:
        chain.append(v)
        v = came[v]
    return chain[::-1]


def dependency_chain(
    edges: DataFrame, source: str, target: str, direction: str = "outbound", local_edges: int = LOCAL_EDGES
) -> list[str]:
    """Shortest path; of several the one that is least in order. ``[]`` if there is none."""
    if source == target:
        return [source]
    e = edges if direction != "inbound" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    e = e.select("src", "dst").where("src is not null and dst is not null")
    if edges.count() <= local_edges:
        run = lambda batches: [pd.DataFrame({"v": _local_chain([p for b in batches for p in zip(b["src"], b["dst"])], source, target)}, dtype=object)]
        return [r.v for r in e.coalesce(1).mapInPandas(run, "v string").collect()]
    front = edges.sparkSession.createDataFrame([(source, [source])], "v string, chain array<string>")
    seen = cut(front.select("v"))
    while True:
        nxt = front.join(grows(e), front["v"] == e["src"]).select(F.col("dst").alias("v"), F.array_append("chain", F.col("dst")).alias("chain"))
        front = cut(nxt.join(grows(seen), "v", "left_anti").groupBy("v").agg(F.min("chain").alias("chain")))
        hit = front.where(F.col("v") == target).select("chain").first()
        if hit:
            return list(hit.chain)
        if front.isEmpty():
            return []
        seen = cut(seen.union(front.select("v")))
