"""Groups of similar sets: prefix-filtered inverted lists, star rounds, components.

Shared by the operators that compare hash sets.  A *node* is one distinct set.
Two nodes can only overlap in ``need`` values or more if the ``size - need +
1`` rarest values of each have one in common, so only these enter the inverted
lists; the filter loses nothing, and values that most documents share (headers,
licence lines) never make a list.

Near copies in thousands would still give quadratically many pairs.  So each
list first pairs its members with one hub only (a star); verified stars merge
into components, and only pairs of *different* components are enumerated after
that.  The components are those of the full pair graph: a pair inside one
component cannot change it, and every other pair of a list is compared.

A family of thousands that share much and yet stay below the threshold would be
enumerated in full.  Two exact bounds prevent that.  A set that is to meet larger
ones has a ``need`` for sets of its own length; in a family of equal lengths whose
common part is smaller none is met at all (``banded_lists``).  And a pair is
dropped where its positions in a list leave too few values (``_met``).  Lists made from sketches cannot have the first bound; where such
a list has more than ``HEAVY`` members of several components, these members are
listed again by their whole sets (``refine`` of ``group``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from corpusloom.session import cut, free

#: Members from which a list of sketch values is replaced by lists of whole sets.
HEAVY = 128
#: Edges that one task contracts at once (16 bytes each).
TASK_EDGES = 1 << 20
#: Rows from which a value that they hold counts as hot, and the sampled rows by which it is known.
HOT_NODES, HOT_SAMPLE = 1 << 21, 1 << 15


def inverted_lists(sets: DataFrame) -> DataFrame:
    """``value, node, size`` of each node's prefix, from ``node, size, need, vals``.

    Values held by one node alone are its rarest and fill the prefix first;
    they are counted, never listed.  Of ``m`` shared values the prefix has
    room for ``m - need + 1``.
    """
    rows = sets.select("node", "size", "need", F.explode("vals").alias("value"))
    df = rows.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = rows.join(df, "value").groupBy("node", "size", "need").agg(
        F.array_sort(F.collect_list(F.struct("df", "value"))).alias("s")
    )
    room = F.size("s") - F.col("need") + 1
    return shared.where(room > 0).select(F.explode(F.slice("s", F.lit(1), room)).alias("x"), "node", "size").select(
        F.col("x.value").alias("value"), "node", "size"
    )


def overlap_needed(a: Column, b: Column, threshold: float) -> Column:
    """Values that sets of these sizes share at a Jaccard index of ``threshold``."""
    return F.ceil(F.lit(threshold / (1 + threshold)) * (a + b) - F.lit(1e-9)).cast("int")


def hot_values(source: DataFrame, entries: Callable[[DataFrame], DataFrame], most: int | None = None) -> DataFrame | None:
    """``value, df`` of values that about ``most`` rows of ``source`` or more hold, estimated on a sample of these.

    There are at most as many as all entries divided by ``most``; None if no value can be one.
    """
    most = HOT_NODES if most is None else most
    if source.count() < most:
        return None
    share = min(1.0, HOT_SAMPLE / most)
    counts = entries(source.sample(share, seed=19)).groupBy("value").agg(F.count(F.lit(1)).alias("c"))
    return cut(counts.where(F.col("c") >= most * share * 0.8).select("value", F.ceil(F.col("c") / share).alias("df")))


def banded_lists(entries: DataFrame, threshold: float, hot: DataFrame | None = None) -> DataFrame:
    """``value, node, size, m, pos, role`` for a Jaccard index of ``threshold``, from ``value, node, size``.

    A list's ``value`` stands for a set's value and a band of lengths.  In the
    list of its own band a set is met by larger ones (``role`` 0), so its prefix
    is as short as sets of at least its length allow; in the lists of its own
    band and the one below it meets smaller ones (``role`` 1).  Bands grow by
    ``1 / threshold``.  ``m`` counts the node's values that other nodes hold too,
    ``pos`` is the value's place among them, rarest first.

    Entries may be repeated and are shuffled once, to be counted where they lie;
    those of ``hot`` values (``value, df``; few, broadcast) are not brought
    together: their number is known well enough for an order.
    """
    cold, rest = entries, None
    if hot is not None:
        known = entries.join(F.broadcast(hot), "value", "left")
        cold = known.where("df is null").drop("df")
        rest = known.where("df is not null").groupBy("value", "node").agg(F.first("size").alias("size"), F.first("df").alias("df"))
    once = cold.repartition("value").groupBy("value", "node").agg(F.first("size").alias("size"))
    counted = once.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("value"))).where("df > 1")
    if rest is not None:
        counted = counted.unionByName(rest)
    shared = (
        counted.groupBy("node")
        .agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("df", "value"))).alias("s"))
        .withColumn("m", F.size("s"))
    )
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(log(1 / threshold) * (1 - 1e-9))).cast("int")
    least = F.ceil(F.lit(threshold) * F.col("size") - F.lit(1e-9)).cast("int")
    roles = F.array(
        F.struct(F.lit(0).alias("role"), F.col("band"), (F.col("m") - overlap_needed(F.col("size"), F.col("size"), threshold) + 1).alias("room")),
        *(F.struct(F.lit(1).alias("role"), (F.col("band") - k).alias("band"), (F.col("m") - least + 1).alias("room")) for k in (0, 1)),
    )
    placed = (
        shared.withColumn("band", band)
        .withColumn("r", F.explode(roles))
        .where("r.room > 0")
        .select(F.posexplode(F.slice("s", F.lit(1), F.least("r.room", "m"))).alias("pos", "x"), "node", "size", "m", "r.role", "r.band")
    )
    return placed.select(F.xxhash64("x.value", "band").alias("value"), "node", "size", "m", "pos", "role")


def long_lists(lists: DataFrame) -> DataFrame:
    """The entries of lists with two members or more."""
    many = lists.groupBy("value").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("value")
    return lists.join(many, "value")


def _met(lists: DataFrame, threshold: float) -> Column:
    """Do two entries ``x, y`` of a list make a pair that may be as similar as ``threshold``?

    Each pair once: ``x`` is the smaller set where the lists know roles, else the smaller node.
    """
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    if "role" not in lists.columns:
        ok = x("node") < y("node")
    else:
        most = F.least(x("pos"), y("pos")) + F.least(x("m") - x("pos"), y("m") - y("pos"))
        ok = (x("role") == 0) & (y("role") == 1) & (F.struct(x("size"), x("node")) < F.struct(y("size"), y("node")))
        ok = ok & (most >= overlap_needed(x("size"), y("size"), threshold))
    if "size" in lists.columns:
        ok = ok & (F.least(x("size"), y("size")) >= F.lit(threshold) * F.greatest(x("size"), y("size")))
    return ok


def star_pairs(lists: DataFrame, threshold: float, known: DataFrame | None = None) -> DataFrame:
    """Distinct ``a, b``: each list's first node with each other one, unless they share a ``known`` component.

    The first one is the smallest set that larger ones are to meet, or the smallest node.
    """
    apart = F.lit(True)
    if known is not None:
        lists = lists.join(known, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        apart = F.col("x.comp") != F.col("y.comp")
    entry = _entry(lists)
    first = lists.where("role = 0") if "role" in lists.columns else lists
    y = lists.where("role = 1") if "role" in lists.columns else lists
    hubs = first.groupBy("value").agg(F.min(entry).alias("x"))
    both = y.select("value", entry.alias("y")).join(hubs, "value").where(apart & _met(lists, threshold))
    return both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _entry(lists: DataFrame) -> Column:
    """An entry without its list; entries are ordered by size, then node, or by node."""
    ahead = [c for c in ("size", "node") if c in lists.columns] if "role" in lists.columns else ["node"]
    return F.struct(*ahead, *[c for c in lists.columns if c not in ("value", "members", *ahead)])


def mixed_lists(lists: DataFrame, comp: DataFrame) -> DataFrame:
    """``lists`` whose members are of several components, with ``comp`` and the number of members ``members``."""
    own = lists.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = (
        own.groupBy("value")
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("members"))
        .where("lo < hi")
    )
    return own.join(mixed.select("value", "members"), "value")


def cross_pairs(mixed: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs ``a, b`` that share a list but no component."""
    entry = _entry(mixed)
    x, y = (mixed.where(f"role = {k}") if "role" in mixed.columns else mixed for k in (0, 1))
    both = x.select("value", entry.alias("x")).join(y.select("value", entry.alias("y")), "value")
    both = both.where((F.col("x.comp") != F.col("y.comp")) & _met(mixed, threshold))
    return both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges ``a, b``, sorted, and the least node of each one's component."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(names))
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            return names, names[root]
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:  # every node points at its root again
            up = root[root]
            if (up == root).all():
                break
            root = up


def _forest(edges: DataFrame, tasks: int) -> DataFrame:
    """Edges ``a < b`` with the same components: those of each of ``tasks`` partitions become stars around their least nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        a, b = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1))
        names, root = _roots(a, b)
        keep = names != root
        yield pa.RecordBatch.from_arrays([pa.array(root[keep]), pa.array(names[keep])], names=["a", "b"])

    return edges.select("a", "b").coalesce(tasks).mapInArrow(run, "a long, b long")


def _order(node: str, turn: int) -> Column:
    """Key of a node: its id in even turns, a hash of the turn's own in odd ones."""
    return F.struct((F.col(node) if turn % 2 == 0 else F.xxhash64(node, F.lit(turn))).alias("h"), F.col(node).alias("v"))


def _composed(mapping: DataFrame | None, hop: DataFrame) -> DataFrame:
    """``node, comp``: where ``hop`` (``node, to``) leads after ``mapping``."""
    if mapping is None:
        return hop.select("node", F.col("to").alias("comp"))
    moved = hop.select(F.col("node").alias("comp"), "to")
    return mapping.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``node, comp`` of the undirected graph with edges ``a, b``; ``comp`` is the least node.

    A task contracts ``task_edges`` edges to stars, so a graph with no more is
    done at once.  A larger one goes through rounds: the tasks contract what they
    hold; every node points at the neighbour (or itself) that comes first, by id
    and by a fresh hash in turn (the former ends stars, the latter chains
    however their ids run); the pointers are followed and the edges contracted to
    where they lead, until one task can hold them.
    """
    plain = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    edges = cut(plain.distinct())
    mapping, turn, n = None, 0, edges.count()
    while n > task_edges:
        stars = cut(_forest(edges, ceil(n / task_edges)).distinct())
        both = stars.union(stars.select("b", "a")).toDF("node", "near")
        nearest = both.groupBy("node").agg(F.min(_order("near", turn)).alias("m"))
        hop = cut(nearest.select("node", F.least(_order("node", turn), "m")["v"].alias("to")))
        for _ in range(2):
            ahead = hop.select(F.col("node").alias("to"), F.col("to").alias("far"))
            longer = cut(hop.join(ahead, "to").select("node", F.col("far").alias("to")))
            free(hop)
            hop = longer
        old, mapping = mapping, cut(_composed(mapping, hop))
        a = hop.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        b = hop.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = stars.join(a, "a").join(b, "b").where("ta != tb")
        left = cut(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        free(edges, stars, hop, old)
        edges, turn, n = left, turn + 1, left.count()
    last = cut(_forest(edges, 1))
    roots = last.select(F.col("a").alias("node"), F.col("a").alias("to")).distinct()
    out = _composed(mapping, last.select(F.col("b").alias("node"), F.col("a").alias("to")).union(roots))
    if mapping is not None:
        least = out.groupBy("comp").agg(F.min("node").alias("least"))
        out = out.join(least, "comp").select("node", F.col("least").alias("comp"))
    out = cut(out)
    free(edges, last, mapping)
    return out


def group(
    lists: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    threshold: float,
    refine: Callable[[DataFrame], DataFrame] | None = None,
    heavy: int = HEAVY,
    known: DataFrame | None = None,
) -> DataFrame:
    """``node, comp`` for all nodes with a verified partner, here or in the ``known`` components.

    ``verify`` takes pairs ``a, b`` and returns those that are similar.
    ``refine`` takes ``node`` and returns ``banded_lists`` of these nodes' whole
    sets; it replaces the mixed lists of more than ``heavy`` members.
    """
    found = verify(star_pairs(lists, threshold, known)).select("a", "b")
    if known is not None:
        found = found.union(known.where("node != comp").select(F.col("comp").alias("a"), F.col("node").alias("b")))
    found = cut(found)
    comp = components(found)
    mixed = cut(mixed_lists(lists, comp))
    light = mixed
    if refine is not None:
        light = mixed.where(F.col("members") <= heavy)
        nodes = cut(mixed.where(F.col("members") > heavy).select("node").distinct())
        if not nodes.isEmpty():
            finer = cut(long_lists(refine(nodes)))
            more = found.union(verify(star_pairs(finer, threshold)).select("a", "b"))
            stars = cut(more)
            free(found, comp)
            found, comp = stars, components(stars)
            again = cut(mixed_lists(finer, comp))
            found = cut(found.union(verify(cross_pairs(again, threshold)).select("a", "b")))
            free(stars, again, finer)
        free(nodes)
    rest = cut(verify(cross_pairs(light, threshold)).select("a", "b"))
    out = components(found.union(rest))
    free(found, rest, comp, mixed)
    return out
