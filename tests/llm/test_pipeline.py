"""The pipeline as a whole: what each stage keeps, and its last result against brute force."""

from __future__ import annotations

from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline as pipeline
from corpusloom.llm import langid, minhash, packing, pii, queries
from corpusloom.session import cut, scratch, table
from helpers import A, LONG, components, docs, empty, jaccard, odd
from test_dedup import shingles
from test_layout import TOKEN, check_packs, mixed_by_brute_force, one_at_a_time
from corpusloom.llm import mixing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_names():
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mixing", "packing"]
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_pipeline_brute_force(spark, sf_dir):
    """Every stage redone in plain Python on the whole table."""
    d = table(spark, sf_dir, "documents")
    rows = [tuple(r[c] for c in COLUMNS) for r in d.collect()]
    parser = langid.CrossParser(langid.sample(d))
    judged = parser.judge([r[1] for r in rows], langid.MAX_BITS)
    rows = [(r[0], r[1], lang, r[3]) for r, lang, ok in zip(rows, judged["lang"], judged["accepted"]) if ok]
    sets = {r[0]: shingles(r[1]) for r in rows}
    ids = sorted(sets)
    edges = [(x, y) for k, x in enumerate(ids) for y in ids[k + 1 :] if sets[x] and jaccard(sets[x], sets[y]) >= minhash.THRESHOLD]
    comp = components(ids, edges)
    rows = [r for r in rows if comp[r[0]] == r[0]]
    rows = [(i, pii.redacted(t, f), lang, s) for (i, t, lang, s), f in zip(rows, pii.detect([r[1] for r in rows]))]
    texts = {r[0]: r[1] for r in rows}
    mixed = mixed_by_brute_force(rows, None, mixing.BLOCK_TOKENS, mixing.SHARD_BLOCKS, mixing.SEED)
    parts = Counter()
    for _, _, i, first, n in mixed.values():
        spans = [m.span() for m in TOKEN.finditer(texts[i])]
        a = 0 if first == 0 else spans[first][0]
        b = spans[first + n][0] if first + n < len(spans) else len(texts[i])
        parts[(i, texts[i][a:b])] += 1
    got = pipeline.run(spark, sf_dir).collect()
    chunks = Counter()
    for (i, t), k in parts.items():
        n = len(TOKEN.findall(t))
        assert n <= packing.PACK_TOKENS
        chunks[(i, t)] += k
    assert Counter((r.doc_id, r.text) for r in got) == chunks
    packs = defaultdict(list)
    for r in got:
        packs[r.pack_id].append(r)
    for p in packs.values():
        assert sum(r.n_tokens for r in p) <= packing.PACK_TOKENS and sorted(r.position for r in p) == list(range(len(p)))
    want = one_at_a_time([r.n_tokens for r in got], packing.PACK_TOKENS)
    assert Counter(tuple(r.n_tokens for r in sorted(p, key=lambda r: r.position)) for p in packs.values()) == want


def test_stages_on_odd_rows(spark, sf_dir):
    """Null, empty, wordless, very long, repeated and equal rows, with clashing extra columns."""
    d, kept = odd(spark), {}
    for name, stage in pipeline.STAGES:
        d = cut(stage(spark, d, sf_dir))
        kept[name] = d.collect()
        if name != "packing":
            assert set(COLUMNS) <= set(d.columns)
    ids = lambda name: Counter(r.doc_id for r in kept[name])
    # what has no words has no language; rows 1, 2, 8 and the one without an id are copies, 3 is a near copy
    assert set(ids("language")) & {4, 5, 6} == set() and ids("language")[7] == 2 and {1, 2, 3, 8, None} <= set(ids("language"))
    assert ids("near_duplicates")[1] == 1 and ids("near_duplicates")[7] == 1 and not set(ids("near_duplicates")) & {2, 3, 8, None}
    assert ids("personal_data") == ids("near_duplicates")
    texts = {r.doc_id: r.text for r in kept["personal_data"]}
    assert texts[1] == A and texts[7] == LONG  # nothing personal in them
    tokens = lambda t: len(TOKEN.findall(t))
    per_source = Counter()
    for r in kept["personal_data"]:
        per_source[r.source] += tokens(r.text)
    blocks = sum(-(-n // mixing.BLOCK_TOKENS) for n in per_source.values())
    mixed = sum(tokens(r.text) for r in kept["mixing"])
    assert (blocks - len(per_source)) * mixing.BLOCK_TOKENS * 0.5 < mixed <= blocks * mixing.BLOCK_TOKENS
    assert all(r.n_chars == len(r.text) for r in kept["mixing"])
    assert sum(r.n_tokens for r in kept["packing"]) == mixed
    d = empty(spark)
    for _, stage in pipeline.STAGES:
        d = cut(stage(spark, d, sf_dir))
        assert d.count() == 0


def test_stage_folders_are_removed(spark, sf_dir):
    folder = Path(scratch(spark))
    before = set(folder.iterdir())
    pipeline.run(spark, sf_dir)
    # the last stage still reads the result before it
    named = [p for p in set(folder.iterdir()) - before if (set(COLUMNS) <= set(spark.read.parquet(str(p)).columns))]
    assert len(named) == 1


def test_packing_of_documents(spark, sf_dir):
    rows = [(i, f"tok{i} " * (i * 37 % 3000), "en", "w") for i in range(40)]
    got = packing.pack(docs(spark, rows)).collect()
    check_packs(got, {i: t for i, t, *_ in rows if t}, packing.PACK_TOKENS)
