"""MinHash, spot signatures and embedding groups against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from compare import both, database
from corpusloom.llm import embeddup, minhash, nearsets, queries, spotsigs
from corpusloom.session import table
from helpers import A, B, components, docs, empty, jaccard, odd, words


def shingles(text, n=minhash.N):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def spots(text):
    """Spot signatures, the slow way."""
    w = words(text)
    content = [(i, x) for i, x in enumerate(w) if x not in spotsigs.ANCHORS]
    out = set()
    for i, x in enumerate(w):
        if x in spotsigs.SPOTS:
            chain = [y for j, y in content if j > i][:: spotsigs.DISTANCE][: spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                out.add((x, *chain))
    return out


def groups_by_brute_force(rows, sets_of, threshold):
    sets = {i: sets_of(t) for i, t in rows}
    ids = sorted(sets)
    edges = [(x, y) for k, x in enumerate(ids) for y in ids[k + 1 :] if sets[x] and jaccard(sets[x], sets[y]) >= threshold]
    return components(ids, edges)


def planted(seed=1):
    """Families of near copies, exact copies, a chain, and strangers that share a passage."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    out, i = [], 0
    for family in range(12):
        base = text(rng.choice([8, 40, 120, 400]))
        for _ in range(rng.choice([1, 2, 5, 40])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, len(base) // 40])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append((i, "the " + " the ".join(" ".join(copy[k : k + 5]) for k in range(0, len(copy), 5))))
            i += 1
    shared = " ".join(text(60))
    for _ in range(25):
        out.append((i, shared + " " + " ".join(text(200))))
        i += 1
    return out


def test_minhash_equals_sql(spark, sf_dir):
    got, want = both(queries.QUERIES["op1_minhash"](spark, sf_dir), database(sf_dir), queries.ORACLES["op1_minhash"])
    assert got == want


def test_minhash_planted(spark):
    rows = planted()
    got = {r.doc_id: r.group_id for r in minhash.near_groups(docs(spark, [(i, t, "en", "w") for i, t in rows])).collect()}
    assert got == groups_by_brute_force(rows, shingles, minhash.THRESHOLD)


def test_minhash_recall_of_pairs_near_the_threshold():
    rng = np.random.default_rng(0)
    found = n = 0
    for _ in range(400):
        size, j = int(rng.integers(20, 2000)), rng.uniform(minhash.THRESHOLD, 1)
        both_ = int(np.ceil(2 * size * j / (1 + j)))
        pool = rng.integers(0, 2**63, 2 * size - both_, dtype=np.uint64)
        a, b = np.unique(pool[:size]), np.unique(np.concatenate([pool[:both_], pool[size:]]))
        n += 1
        found += minhash.union_estimate(a[: minhash.K], b[: minhash.K], minhash.K) >= minhash.THRESHOLD - minhash.SLACK
    assert found / n >= 0.98


def test_minhash_odd_rows(spark):
    rows = minhash.near_groups(odd(spark)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(rows) == 12  # the row repeated in full is one document
    assert {r.group_id for i in (1, 2, 3, 8) for r in by[i]} == {1}
    assert by[1][0].keep and not by[2][0].keep and by[1][0].group_size == 5
    assert all(r.keep and r.group_size == 1 for i in (4, 5, 6, 7) for r in by[i])
    assert len(by[9]) == 2 and len(by[None]) == 2
    assert minhash.near_groups(empty(spark)).count() == 0


def test_keep_one_odd_rows(spark):
    d = odd(spark)
    kept = minhash.keep_one(d)
    assert kept.columns == d.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([1, 4, 5, 6, 7, 9, 9, None], key=str)
    assert minhash.keep_one(empty(spark)).count() == 0


def test_components_of_long_chains(spark):
    n = 200
    edges = spark.createDataFrame([(i * 31 % 997, (i + 1) * 31 % 997) for i in range(n)], "a long, b long")
    assert {r.comp for r in nearsets.components(edges).collect()} == {0}


def test_components_of_a_hashed_chain(spark):
    n = 20_000
    names = [int(x) for x in np.random.default_rng(8).permutation(10 * n)[: n + 1]]
    edges = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long").repartition(16)
    for most in (2_000, nearsets.TASK_EDGES):
        got = nearsets.components(edges, most).collect()
        assert len(got) == n + 1 and {r.comp for r in got} == {min(names)}


@pytest.mark.parametrize("most", [40, nearsets.TASK_EDGES])
def test_components_equal_a_plain_union(spark, most):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 600, (350, 2)) if a != b] + [(0, i) for i in range(700, 900)]
    got = {r.node: r.comp for r in nearsets.components(spark.createDataFrame(edges, "a long, b long").repartition(8), most).collect()}
    assert got == components({x for e in edges for x in e}, edges)
    assert nearsets.components(spark.createDataFrame([], "a long, b long")).count() == 0


def template_family(n, seed=3):
    """Texts that share 40 of 60 shingles each: Jaccard index 0.5 of any two."""
    rng = random.Random(seed)
    common = " ".join(f"t{k}" for k in range(42))
    return [(i, common + " " + " ".join(f"u{rng.getrandbits(60)}" for _ in range(20))) for i in range(n)]


def test_minhash_large_family_below_the_threshold(spark):
    """20,000 texts of one template are not compared pair by pair."""
    rows = template_family(20_000) + [(20_000 + i, t) for i, (_, t) in enumerate(template_family(20, seed=3))]
    got = minhash.near_groups(docs(spark, [(i, t, "en", "w") for i, t in rows]).repartition(8)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.group_id for r in got} == {i: i if i < 20_000 else i - 20_000 for i, _ in rows}


def test_spotsigs_large_family_below_the_threshold(spark):
    rng = random.Random(4)
    spot = lambda: "the " + " ".join(f"u{rng.getrandbits(60)}" for _ in range(3))
    common = " ".join(f"the a{k} b{k} c{k}" for k in range(40))
    rows = [(i, common + " " + " ".join(spot() for _ in range(20))) for i in range(20_000)]
    got = spotsigs.fingerprints(docs(spark, [(i, t, "en", "w") for i, t in rows]).repartition(8)).collect()
    assert len(got) == len(rows) and all(r.group_id == r.doc_id for r in got)


@pytest.mark.parametrize("heavy", [1, 4, 10**9])
def test_minhash_other_ways_give_the_same(spark, heavy):
    """Keys joined by shuffle instead of broadcast, and sketch lists replaced by lists of whole sets."""
    rows = planted(5) + [(10_000 + i, t) for i, t in template_family(30)]
    d = docs(spark, [(i, t, "en", "w") for i, t in rows])
    got = {r.doc_id: r.group_id for r in minhash.near_groups(d, broadcast_keys=0, heavy=heavy).collect()}
    assert got == groups_by_brute_force(rows, shingles, minhash.THRESHOLD)


def test_minhash_chain_of_near_copies(spark):
    """Each text is near the next one only; all are one group."""
    rows = [(i, " ".join(f"w{k}" for k in range(5 * i, 5 * i + 40))) for i in range(300)]
    got = minhash.near_groups(docs(spark, [(i, t, "en", "w") for i, t in rows])).collect()
    assert {r.group_id for r in got} == {0} and sum(r.keep for r in got) == 1


def test_spotsigs_brute_force(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    got = spotsigs.fingerprints(d).collect()
    want = groups_by_brute_force(rows, spots, spotsigs.THRESHOLD)
    assert {r.doc_id: r.group_id for r in got} == want
    sizes = {i: len(spots(t)) for i, t in rows}
    assert all((r.n_spots or 0) == sizes[r.doc_id] for r in got)


def test_spotsigs_planted(spark):
    rows = planted(2)
    got = {r.doc_id: r.group_id for r in spotsigs.fingerprints(docs(spark, [(i, t, "en", "w") for i, t in rows])).collect()}
    assert got == groups_by_brute_force(rows, spots, spotsigs.THRESHOLD)


def test_spotsigs_odd_rows(spark):
    rows = spotsigs.fingerprints(odd(spark)).collect()
    assert len(rows) == 12
    assert {r.group_id for r in rows if r.doc_id in (1, 2, 8)} == {1}
    assert all(r.fingerprint is None and r.group_size == 1 for r in rows if r.doc_id in (4, 5, 6))
    assert spotsigs.fingerprints(empty(spark)).count() == 0


def test_spotsigs_every_anchor_leads():
    texts = [f"{x} casa verde grande" for x in spotsigs.ANCHORS]
    assert [len(s) for s in spotsigs.spot_sets(texts)] == [1] * len(texts)


def test_spotsigs_fallback(spark):
    rows = [(1, "Reorea. Nd."), (2, "reorea nd"), (3, "nd reorea"), (4, "the a"), (5, "The a!"), (6, "la casa verde grande"), (7, "..."), (8, "...")]
    got = {r.doc_id: r for r in spotsigs.fingerprints(docs(spark, [(i, t, "es", "w") for i, t in rows]), fallback=True).collect()}
    assert {i: r.group_id for i, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}
    assert got[1].fingerprint == got[2].fingerprint != got[3].fingerprint
    assert {i: r.group_size for i, r in got.items()} == {1: 2, 2: 2, 3: 1, 4: 2, 5: 2, 6: 1, 7: 1, 8: 1}
    assert {i for i, r in got.items() if r.fingerprint is None} == {7, 8} and [r.n_spots for _, r in sorted(got.items())] == [0] * 5 + [1, 0, 0]


def test_spotsigs_query_groups_identical_texts(spark, sf_dir):
    group = {r.doc_id: r.group_id for r in queries.QUERIES["op8_spotsigs"](spark, sf_dir).collect()}
    first = {}
    for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect():
        if words(r.text):
            assert group[first.setdefault(r.text, r.doc_id)] == group[r.doc_id]


def test_embeddup_equals_sql(spark, sf_dir):
    got, want = both(queries.QUERIES["op10_embeddup"](spark, sf_dir), database(sf_dir), queries.ORACLES["op10_embeddup"])
    assert got == want


def test_embeddup_recall(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    noise = rng.standard_normal(base.shape)
    noise -= (noise * base).sum(1)[:, None] * base
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    c = rng.uniform(embeddup.THRESHOLD, 1, 300)[:, None]
    pairs = np.concatenate([base, c * base + np.sqrt(1 - c * c) * noise])
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(pairs)]
    got = {r.vec_id: r.group_id for r in embeddup.near_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(got[i] == got[i + 300] for i in range(300)) >= 270
    assert len(set(got.values())) >= 300


def test_embeddup_odd_rows(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [float("nan"), 1.0]), (7, [None, 1.0]),
        (8, [1.0, 0.0, 0.0]), (9, [0.0, 1.0]), (9, [0.0, 1.0]), (None, [1.0, 0.001]), (10, [float("inf"), 1.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS node", "'x' AS unit", "'x' AS value")
    got = embeddup.near_groups(df).collect()
    size = {r.vec_id: r.group_size for r in got}
    assert len(got) == 11
    assert size[1] == size[2] == size[None] == 3 and all(size[i] == 1 for i in (3, 4, 5, 6, 7, 8, 9, 10))
    assert {r.group_id for r in got if r.vec_id in (1, 2, None)} == {1}
    assert embeddup.near_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [10, 10_000, 10**8])
def test_embeddup_shape_keeps_recall(n):
    m, tables = embeddup.shape(n)
    near = embeddup.collision((2 - 2 * embeddup.THRESHOLD) ** 0.5)
    assert 1 - (1 - near**m) ** tables >= embeddup.RECALL


def test_fixture_texts_are_near():
    assert jaccard(shingles(A), shingles(B)) >= minhash.THRESHOLD


def test_embeddup_in_rounds(spark, monkeypatch):
    """Tables in rounds of a few find the same groups."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((60, 16))
    rows = [(i, [float(x) for x in base[i % 60] + 0.02 * rng.standard_normal(16)]) for i in range(180)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {r.vec_id: r.group_id for r in embeddup.near_groups(df).collect()}
    monkeypatch.setattr(embeddup, "ROUND_TABLES", 10)
    assert {r.vec_id: r.group_id for r in embeddup.near_groups(df).collect()} == whole
    assert len(set(whole.values())) <= 60


def test_hot_values_change_nothing(spark, monkeypatch):
    """Values that many rows hold are ordered by an estimate and never brought together; the groups are the same."""
    rows = planted(7)
    d = docs(spark, [(i, t, "en", "w") for i, t in rows])
    monkeypatch.setattr(nearsets, "HOT_NODES", 6)
    hot = nearsets.hot_values(d, lambda x: spotsigs.entries(x, spotsigs.CHAIN, spotsigs.DISTANCE))
    assert hot.count() > 50
    got = {r.doc_id: r.group_id for r in spotsigs.fingerprints(d).collect()}
    assert got == groups_by_brute_force(rows, spots, spotsigs.THRESHOLD)
    got = {r.doc_id: r.group_id for r in minhash.near_groups(d, heavy=1).collect()}
    assert got == groups_by_brute_force(rows, shingles, minhash.THRESHOLD)
