"""Sharding, packing and mixing against plain-Python versions."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from compare import both, database
from corpusloom.llm import mixing, packing, queries, sharding, tokens
from corpusloom.llm.ranks import running_total
from corpusloom.session import table
from helpers import docs, empty, odd
from pyspark.sql import functions as F

TOKEN = re.compile(tokens.TOKEN_RE)


def test_sharding_equals_sql(spark, sf_dir):
    got, want = both(queries.QUERIES["op3_sharding"](spark, sf_dir), database(sf_dir), queries.ORACLES["op3_sharding"])
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**40))
def test_permutation_is_a_bijection_and_inverts(n, seed):
    x = np.arange(n)
    p = sharding.permute(x, n, seed)
    assert np.array_equal(np.sort(p), x)
    assert np.array_equal(sharding.permute(p, n, seed, inverse=True), x)


def test_permutation_of_huge_domains():
    n = 10**13
    x = np.array([0, 1, n // 2, n - 1])
    p = sharding.permute(x, n)
    assert (0 <= p).all() and (p < n).all() and np.array_equal(sharding.permute(p, n, inverse=True), x)


def test_sharding_odd_rows(spark):
    rows = sharding.shard_documents(odd(spark), 4).collect()
    assert sorted(r.position for r in rows) == list(range(13))
    assert all(r.position == r.shard * 4 + r.slot for r in rows)
    assert {r.row_number for r in rows if r.doc_id is None} == {0, 1}
    assert sharding.shard_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("rows", [1, 3, 4096])
def test_running_total(spark, rows):
    data = [("x", 5, 2), ("x", None, 1), (None, 3, 7), ("x", -9, 4), (None, 10**15, 1), ("x", 5, 2)]
    df = spark.createDataFrame(data, "g string, i long, v long")
    got = Counter(map(tuple, running_total(df, ["g"], "i", ["v"], F.col("v"), "t", rows).collect()))
    want, at = Counter(), Counter()
    for g, i, v in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0)):
        want[(g, i, v, at[g])] += 1
        at[g] += v
    assert got == want


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab \t\n\rüß", max_size=60))
def test_cuts_round_trip(text):
    n = len(TOKEN.findall(text))
    for at in ([0], [0, n // 2] if n // 2 else [0], list(range(max(1, n)))):
        parts = tokens.cuts(text, at)
        assert "".join(parts) == text and len(parts) == len(at)
        if n:
            assert [len(TOKEN.findall(p)) for p in parts] == [b - a for a, b in zip(at, [*at[1:], n])]


def one_at_a_time(lengths, size):
    """Shortest-pack-first, item by item: of the shortest packs the one left alone longest takes what fits."""
    packs = []
    for t, x in enumerate(sorted(lengths, reverse=True)):
        best = min(packs, key=lambda p: p[:2], default=None)
        if best is not None and best[0] + x <= size:
            best[0] += x
            best[1] = t
            best[2].append(x)
        else:
            packs.append([x, t, [x]])
    return Counter(tuple(p[2]) for p in packs)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 12), max_size=8))
def test_histogram_packing_equals_item_by_item(histogram):
    got = Counter()
    for count, pattern in packing.pack_histogram(histogram, 20):
        got[tuple(x for length, times in pattern for x in [length] * times)] += count
    assert got == one_at_a_time([k for k, v in histogram.items() for _ in range(v)], 20)


def check_packs(rows, source, size):
    packs, again = defaultdict(list), defaultdict(list)
    for r in rows:
        packs[r.pack_id].append(r)
        again[r.doc_id].append(r)
    for p in packs.values():
        assert sum(r.n_tokens for r in p) <= size
        assert sorted(r.position for r in p) == list(range(len(p)))
    assert sorted(packs) == list(range(len(packs)))
    for i, text in source.items():
        parts = sorted(again[i], key=lambda r: r.first_token)
        assert "".join(r.text for r in parts) == text
        assert [r.n_tokens for r in parts] == [len(TOKEN.findall(r.text)) for r in parts]
    return packs


def test_packing_whole_table(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = packing.pack(d).collect()
    source = {r.doc_id: r.text for r in d.collect() if r.text and TOKEN.search(r.text)}
    packs = check_packs(rows, source, packing.PACK_TOKENS)
    assert {r.doc_id for r in rows} == set(source)
    want = one_at_a_time([r.n_tokens for r in rows], packing.PACK_TOKENS)
    assert Counter(tuple(r.n_tokens for r in sorted(p, key=lambda r: r.position)) for p in packs.values()) == want


def test_packing_odd_rows(spark):
    rows = packing.pack(odd(spark), 50).collect()
    assert {r.doc_id for r in rows} == {None, 1, 2, 3, 6, 7, 8, 9}
    assert sum(r.n_tokens for r in rows if r.doc_id == 7) == 2 * 240_000
    packs = defaultdict(int)
    for r in rows:
        packs[r.pack_id] += r.n_tokens
    assert max(packs.values()) <= 50
    assert packing.pack(empty(spark)).count() == 0


def mixed_by_brute_force(rows, weights, block, shard_blocks, seed):
    """``(shard, slot, place) -> (source, block, doc_id, first_token, n_tokens)``."""
    streams = defaultdict(list)
    for i, t, _, s in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        streams[s] += [(i, k) for k in range(len(TOKEN.findall(t or "")))]
    streams = {s: x for s, x in streams.items() if x}
    total = sum(-(-len(x) // block) for x in streams.values())
    names = sorted(streams, key=lambda s: (s is not None, s or ""))
    w = np.array([len(streams[s]) ** mixing.ALPHA if weights is None else weights.get(s, 0.0) for s in names])
    names, w = [s for s, x in zip(names, w) if x > 0], w[w > 0]
    w = w / w.sum()
    w = w / w.sum()
    used, out = Counter(), {}
    for shard in range(-(-total // shard_blocks)):
        k = min(shard_blocks, total - shard * shard_blocks)
        order, at = mixing.slot_order(shard, k, seed), 0
        for s, c in enumerate(mixing.draw(shard, k, w, seed)):
            n = -(-len(streams[names[s]]) // block)
            for j in range(used[s], used[s] + c):
                b = int(mixing.block_of(np.array([j]), s, n, seed)[0])
                runs = {}
                for place, (i, k_) in enumerate(streams[names[s]][b * block : (b + 1) * block]):
                    runs.setdefault(i, [place, k_, 0])[2] += 1
                for i, (place, first, m) in runs.items():
                    out[(shard, int(order[at]), place)] = (names[s], b, i, first, m)
                at += 1
            used[s] += c
    return out


@pytest.mark.parametrize("weights", [None, {"web": 0.2, "books": 0.8}])
def test_mixing_brute_force(spark, sf_dir, weights):
    if weights is None:
        rows = [(r.doc_id, r.text, r.lang, r.source) for r in table(spark, sf_dir, "documents").collect()]
    else:
        rows = [(i, " ".join(f"t{i}_{k}" for k in range(i * 7 % 90)), "en", ["web", "books", None][i % 3]) for i in range(60)]
    got = mixing.mix(docs(spark, rows), weights, 64, 16).collect()
    want = mixed_by_brute_force(rows, weights, 64, 16, mixing.SEED)
    assert {(r.shard, r.slot, r.place): (r.source, r.block, r.doc_id, r.first_token, r.n_tokens) for r in got} == want
    assert len(got) == len(want)
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        assert TOKEN.findall(r.text) == TOKEN.findall(texts[r.doc_id])[r.first_token : r.first_token + r.n_tokens]


def test_mixing_no_block_repeats_before_all_were_used():
    for n in (1, 2, 7, 100):
        j = np.arange(3 * n)
        b = mixing.block_of(j, 1, n, 5)
        for e in range(3):
            assert sorted(b[e * n : (e + 1) * n]) == list(range(n))


def test_mixing_odd_rows(spark):
    rows = mixing.mix(odd(spark), None, 32, 8).collect()
    assert rows and {r.source for r in rows} <= {None, "web", "books"}
    assert mixing.mix(odd(spark), {"web": 0.0}).count() == 0
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(empty(spark)).columns == mixing.mix(odd(spark)).columns


def test_buckets_stay_even_beside_an_outlier(spark):
    """One far id, clusters, and a third of the rows equal: no bucket holds much more than its share."""
    from corpusloom.llm import ranks

    ids = [*range(3000), 2**60, *(10**15 + i for i in range(3000)), *([77] * 3000)]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long").repartition(8)
    sizes = [r["count"] for r in ranks.bucketed(df, "doc_id", [], 500).groupBy("rt_bucket").count().collect()]
    assert sum(sizes) == len(ids) and len(sizes) >= 15 and max(sizes) <= 1500
    got = ranks.running_total(df, [], "doc_id", [], F.lit(1), "rank", rows=500).collect()
    assert sorted(r["rank"] for r in got) == list(range(len(ids)))
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"])] == sorted(ids)


def test_running_total_of_dense_ids(spark):
    from corpusloom.llm import ranks

    df = spark.range(1000).selectExpr("id", "id % 3 as g", "id as v")
    got = ranks.running_total(df, ["g"], "id", [], F.col("v"), "before", rows=64, dense=True).collect()
    assert all(r.before == sum(range(r.g, r.id, 3)) for r in got) and len(got) == 1000


def test_too_many_sources_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    with pytest.raises(ValueError):
        mixing.mix(docs(spark, [(i, "a b c", "en", f"s{i}") for i in range(3)]))
