"""Behaviour on small hand-made inputs, with results known in advance."""

from __future__ import annotations

import json
import subprocess
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from corpusloom import cli
from corpusloom.api import QueryService
from corpusloom.functions import text as X
from corpusloom.functions.rules import RuleConfig
from corpusloom.operators import extract, graph, resolve, score
from corpusloom.plans import analysis, tour
from corpusloom.sinks import documents, payload
from corpusloom.sources import aliases, config, gitlog, scan, snapshot

FILES = {
    "src/app.py": "from dep import helper\n\ndef run():\n    return helper()\n",
    "src/dep.py": "import app\nimport requests\n\ndef helper():\n    pass\n",
    "src/orphan.py": "def noop():\n    pass\n",
    "src/billing/invoice_service.py": "class InvoiceService:\n    pass\n",
    "src/bootstrap.py": "if __name__ == '__main__':\n    pass\n",
    "src/settings.json": "{}",
    "docs/guide.md": "# Guide\n",
    "src/keys.py": "API_KEY = 'AI" + "za" + "0" * 33 + "'\n",
}


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, src string")


@pytest.fixture(scope="module")
def result(spark):
    return analysis.analyse(frame(spark, FILES))


@pytest.fixture(scope="module")
def service(spark, result):
    changes = spark.createDataFrame([("src/app.py", 7), ("src/dep.py", 3)], "file string, changes long")
    return QueryService(result, changes)


@pytest.fixture(scope="module")
def files(result):
    return {r.path: r.asDict(True) for r in result.files.collect()}


def test_classification(files):
    assert files["src/settings.json"]["layer"] == "infrastructure"
    assert files["src/bootstrap.py"]["entrypoint"]
    assert files["src/billing/invoice_service.py"]["domain"] == "billing"
    assert "billing" in files["src/billing/invoice_service.py"]["keywords"]
    assert any("secret" in w for w in files["src/keys.py"]["warnings"])


def test_edges_cycle_and_rank(result, files):
    assert sorted(map(tuple, result.edges.collect())) == [("src/app.py", "src/dep.py"), ("src/dep.py", "src/app.py")]
    assert files["src/app.py"]["is_in_cycle"] and not files["src/orphan.py"]["is_in_cycle"]
    assert sum(f["pagerank"] for f in files.values()) == pytest.approx(1.0)
    assert files["src/app.py"]["external"] == [] and files["src/dep.py"]["external"] == ["requests"]


def test_dependency_chain_of_any_length(spark):
    name = "f{:05d}".format
    edges = spark.createDataFrame([(name(i), name(i + 1)) for i in range(1500)], "src string, dst string")
    assert graph.dependency_chain(edges, name(0), name(1500)) == [name(i) for i in range(1501)]
    assert graph.dependency_chain(edges, name(1500), name(0)) == []


def test_dependency_chain_both_ways(spark):
    edges = spark.createDataFrame([("s", "b"), ("s", "a"), ("b", "c"), ("a", "z"), ("c", "t"), ("z", "t"), ("t", "s"), ("q", "q")], "src string, dst string")
    for source, target, direction in (("s", "t", "outbound"), ("t", "b", "inbound"), ("s", "q", "outbound")):
        both = [graph.dependency_chain(edges, source, target, direction, local_edges=n) for n in (graph.LOCAL_EDGES, 0)]
        assert both[0] == both[1], both
    assert graph.dependency_chain(edges, "s", "t") == ["s", "a", "z", "t"]


def test_query_service(service):
    assert service.get_dependents("src/app.py") == ["src/dep.py"]
    assert service.search_symbol("RUN") == [{"file": "src/app.py", "symbols": ["run"]}]
    assert service.get_file_summary("nowhere") is None
    assert service.get_file_summary("src/app.py")["capabilities"] == {"functions": ["run"]}
    assert "src/orphan.py" in service.list_orphans()
    assert service.get_subgraph("src/app.py", 1)["nodes"] == ["src/app.py", "src/dep.py"]
    assert service.get_subgraph("nowhere", 2)["nodes"] == ["nowhere"]
    assert service.get_dependency_chain("src/app.py", "src/dep.py") == ["src/app.py", "src/dep.py"]
    assert service.get_dependency_chain("src/app.py", "src/orphan.py") == []
    assert service.list_cycles() == [["src/app.py", "src/dep.py"]]
    assert service.list_by_volatility(1) == [{"file": "src/app.py", "changes": 7}]
    hot = service.list_hotspots(3)
    assert [h["priority_score"] for h in hot] == sorted((h["priority_score"] for h in hot), reverse=True)
    assert service.list_hotspots(1, 1) == service.list_hotspots(2)[1:]
    assert all(h["domain"] == "billing" for h in service.list_hotspots(domain="billing"))
    assert service.explain_score("src/app.py")["priority_breakdown"]["cycle_penalty"] == -10.0
    assert len(service.list_by_blast_radius(2)) == 2 == len(service.list_refactor_candidates(2))


def test_rpc(service, tmp_path):
    ask = lambda **r: service.dispatch({"id": 1, **r})
    assert ask(method="get_dependents", params={"file_path": "src/app.py"})["result"] == ["src/dep.py"]
    assert ask(method="nothing")["error"]["code"] == -32601
    assert ask(method="get_dependents")["error"]["code"] == -32602
    assert ask(method="list_cycles", params=[1])["result"]
    out = tmp_path / "out"
    with out.open("w") as f:
        service.serve(["{bad\n", "\n", json.dumps({"id": 2, "method": "list_cycles"})], f)
    bad, good = map(json.loads, out.read_text().splitlines())
    assert bad["error"]["code"] == -32700 and good["id"] == 2


def test_documents(result, tmp_path):
    r = payload.report(result, "demo")
    paths = documents.write(r, str(tmp_path), list(documents.WRITERS))
    assert len(paths) == 5
    data = json.loads((tmp_path / "corpus_report.json").read_text())
    assert set(data["files"]) == set(FILES) and data["dependency_graph"]["src/app.py"] == ["src/dep.py"]
    tree = ElementTree.parse(tmp_path / "corpus_report.xml").getroot()
    assert len(tree.find("files")) == len(FILES)
    toon = (tmp_path / "corpus_report.toon").read_text()
    assert "@columns: f ft_v" in toon and "warn:" in toon
    assert "| `" in (tmp_path / "corpus_report.md").read_text()
    assert "src/app.py" in (tmp_path / "corpus_report.html").read_text()
    payload.tables(result, str(tmp_path / "tables"))
    assert result.files.sparkSession.read.parquet(str(tmp_path / "tables/edges")).count() == 2
    assert payload.compact_rows(result.files).count() == len(FILES)


def test_toon_scalars():
    assert [documents.scalar(x) for x in (None, True, 3, 0.1234567, "a/b.py", "true", 'x "y"\n')] == [
        "null", "true", "3", "0.123457", "a/b.py", '"true"', '"x \\"y\\"\\n"',
    ]
    assert documents.nested({"a": [], "b": {"c": [1, "two words"]}}) == 'a: []\nb:\n  c:\n    - 1\n    - "two words"'


def test_tour(result):
    steps = [r.asDict() for r in tour.overview(result.files).collect()]
    assert [s["step"] for s in steps] == list(range(1, len(steps) + 1))
    assert steps[0]["title"] == "Main entrypoint" and steps[-1]["title"] == "Summary"
    assert "dot pie" in tour.script("demo", steps)


def test_documentation_decides(spark):
    src = {"a/x.py": '"""Says what it does.\n\nMore."""\n', "a/y.ts": "/**\n * @file y\n * Draws it.\n */\nexport const y = 1\n", "a/z.py": "z = 1"}
    got = {r.path: r for r in analysis.analyse(frame(spark, src)).files.collect()}
    assert got["a/x.py"].role_hint == "module - Says what it does.\n\nMore." and got["a/x.py"].description == "Says what it does."
    assert got["a/y.ts"].role_hint == "module - Draws it." and got["a/z.py"].role_hint == "module for core"


def test_registered_language(spark):
    extract.register([".abc"], lambda src: {"functions": src.split(), "specs": ["x"], "bases": ["x"]})
    try:
        got = {r.path: r for r in extract.features(frame(spark, {"q.abc": "one two", "q.abd": "one"})).collect()}
    finally:
        del extract.PARSERS[".abc"]
    assert got["q.abc"].functions == ["one", "two"] and got["q.abc"].specs == ["x"] and got["q.abd"].functions == []


def test_ast_chunks_hold_every_node(spark):
    import ast

    src = "".join(f"def f{i}(a):\n    return a + {i}\n\n" for i in range(40)) + "x = 1\n"
    rows = extract.ast_chunks(frame(spark, {"a.py": src, "b.py": "def (\nline two", "c.txt": "x"}), 30).orderBy("path", "chunk").collect()
    mine = [r.text for r in rows if r.path == "a.py"]
    assert len(mine) > 5 and ast.unparse(ast.parse("\n".join(mine))) == ast.unparse(ast.parse(src))
    assert all(sum(len(ast.unparse(n)) // 4 for n in ast.parse(t).body) <= 30 for t in mine) and [r.text for r in rows if r.path == "b.py"] == ["def (\nline two"]


def test_failed_files_have_a_record(spark):
    """A source that cannot be read, and a parser that raises."""
    extract.register([".bad"], lambda src: 1 / 0)
    try:
        rows = spark.createDataFrame([("auth/a.py", None), ("auth/b.bad", "x"), ("auth/c.py", "")], "path string, src string")
        got = {r.path: r for r in analysis.analyse(rows).files.collect()}
    finally:
        del extract.PARSERS[".bad"]
    for p in ("auth/a.py", "auth/b.bad"):
        r = got[p]
        assert (r.failed, r.file_type, r.type_confidence, r.domain, r.domain_confidence) == (True, "module", 0.3, "core", 0.3)
        assert (r.layer, r.criticality, r.complexity_label, r.complexity_score, r.warnings) == ("unknown", "supporting", "low", 0, [score.ORPHAN_WARNING])
    assert not got["auth/c.py"].failed and got["auth/c.py"].domain == "auth"


def test_incremental_analysis(spark, tmp_path):
    """Only files whose time, size or configuration changed are extracted again."""
    folder = str(tmp_path / "cache")

    def run(rows, **how):
        files = spark.createDataFrame(rows, "path string, size long, mtime double, src string")
        return {r.path: r.functions for r in analysis.extracted(files, cache=folder, **how).collect()}

    first = [("a.py", 1, 1.0, "def one(): pass"), ("b.py", 1, 1.0, "def two(): pass"), ("c.py", 1, 1.0, "")]
    assert run(first) == {"a.py": ["one"], "b.py": ["two"], "c.py": []}
    # the same key keeps the record, whatever the source; another time, size or configuration does not; c.py is gone
    second = [("a.py", 1, 1.0, "def changed(): pass"), ("b.py", 1, 2.0, "def new(): pass")]
    assert run(second) == {"a.py": ["one"], "b.py": ["new"]}
    assert run(second, config_hash="other") == {"a.py": ["changed"], "b.py": ["new"]}
    assert run([], config_hash="other") == {}


def test_chunks_reach_the_documents(spark, tmp_path):
    src = "".join(f"def f{i}(a):\n    return a + {i}\n\n" for i in range(20))
    a = analysis.analyse(frame(spark, {"a.py": src, "b.txt": "line\n" * 3}), chunk_tokens=30)
    documents.write(payload.report(a, "demo"), str(tmp_path), ["json"])
    files = json.loads((tmp_path / "corpus_report.json").read_text())["files"]
    assert len(files["a.py"]["chunks"]) > 3 and files["b.txt"]["chunks"] == ["line\nline\nline"]
    assert all(r.chunks == [] for r in analysis.analyse(frame(spark, {"a.py": src})).files.collect())


COMPACT = {
    "f": "src/app.py", "d": {"value": "billing"}, "c": "c", "l": "a", "ep": True, "ps": 88, "fi": 1, "rh": "main entrypoint", "warns": ["warning"],
    "re": 2.5, "br": 3, "module_doc": "Application entrypoint.", "caps": {"functions": ["main"]}, "internal_dependencies": ["src/db.py"],
}


def test_compact_records_are_read_back(tmp_path):
    full = payload.normalised(COMPACT)
    assert (full["criticality"], full["layer"], full["entrypoint"], full["priority_score"]) == ("critical", "application", True, 88)
    assert full["domain"] == {"value": "", "confidence": 0.0} and full["capabilities"] == {"functions": ["main"], "classes": [], "exports": []}
    assert payload.normalised(full) == full and payload.normalised({}, "x.py")["file"] == "x.py"
    r = payload.of_records("demo", {"src/app.py": COMPACT})
    assert r.stats["critical_files"] == 1 and list(r.edges()) == [("src/app.py", "src/db.py")]
    documents.write(r, str(tmp_path), list(documents.WRITERS))
    node = ElementTree.parse(tmp_path / "corpus_report.xml").getroot().find("./files/file")
    assert node.attrib["criticality"] == "critical" and "critical" in (tmp_path / "corpus_report.html").read_text()


def test_documents_without_a_section_are_refused():
    whole = payload.sections(payload.of_records("demo", {}))
    for fmt in documents.WRITERS:
        payload.validate(whole, fmt)
    for fmt, gone in (("json", "files"), ("xml", "hotspots"), ("html", "dependency_graph"), ("toon", "stats"), ("md", "version")):
        with pytest.raises(ValueError, match=gone):
            payload.validate({k: v for k, v in whole.items() if k != gone}, fmt)
    payload.validate({k: whole[k] for k in ("version", "project", "generated_at")}, "md")


GIT_RULES = [
    ("*.json", ["a.json", "x/a.json", "x/a.json/y"], ["a.jsonx", "json"]), ("docs", ["docs", "docs/a", "x/docs/a"], ["mydocs", "docs2/a"]),
    ("docs/", ["docs/a", "x/docs/a"], ["docs", "x/docs"]), ("/top", ["top", "top/a"], ["x/top"]), ("a/b", ["a/b", "a/b/c"], ["x/a/b"]),
    ("a/*.py", ["a/x.py"], ["a/b/x.py", "x/a/y.py"]), ("a/**/z", ["a/z", "a/b/z", "a/b/c/z"], ["z", "b/a/z"]), ("**/x", ["x", "a/x", "a/b/x/y"], ["xx"]),
    ("x/**", ["x/a", "x/a/b"], ["x", "y/x/a"]), ("f?o[0-9].c", ["fao1.c", "d/fbo2.c"], ["fo1.c", "f/o1.c", "faox.c"]), ("\\#a", ["#a"], ["a"]),
]


def test_ignore_files_as_git_reads_them(spark):
    paths = sorted({p for _, yes, no in GIT_RULES for p in yes + no})
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    hit = df.select("path", *[scan.git_ignored(F.col("path"), [rule]).alias(f"r{i}") for i, (rule, _, _) in enumerate(GIT_RULES)]).collect()
    for i, (rule, yes, no) in enumerate(GIT_RULES):
        got = {r.path for r in hit if r[f"r{i}"]}
        assert set(yes) <= got and not set(no) & got, (rule, got)
    last = df.where(scan.git_ignored(F.col("path"), ["# none", "", "*.json", "!x/*.json", "/"]))
    assert {r.path for r in last.collect()} == {"a.json", "x/a.json/y"} - {"x/a.json/y"}


def test_scan_takes_uris_and_odd_names(spark, tmp_path):
    for name in ("src/a b+c%20d.py", "src/_hidden.py", "src/.git/x.py", "src/deep/é.py"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    want = {"src/a b+c%20d.py", "src/_hidden.py", "src/deep/é.py"}
    for root in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/".replace("file:/", "file:///", 1)):
        assert {r.path for r in scan.scan(spark, root).collect()} == want


def test_scan_of_many_folders(spark, tmp_path, monkeypatch):
    """Folders walked by tasks give the same files; ignored folders are not entered, unreadable files have no source."""
    for i in range(12):
        f = tmp_path / f"src/p{i}/q{i}/r"
        f.mkdir(parents=True)
        (f / "__init__.py").write_text(str(i))
        (f.parent / "node_modules").mkdir()
        (f.parent / "node_modules/x.py").write_text("x")
    (tmp_path / "src/loop").symlink_to(tmp_path / "src")
    whole = {(r.path, r.src) for r in scan.scan(spark, str(tmp_path)).collect()}
    assert whole == {(f"src/p{i}/q{i}/r/__init__.py", str(i)) for i in range(12)}
    monkeypatch.setattr(scan, "WALK_FOLDERS", 3)
    assert {(r.path, r.src) for r in scan.scan(spark, str(tmp_path)).collect()} == whole
    files = scan.scan(spark, str(tmp_path))
    (tmp_path / "src/p0/q0/r/__init__.py").unlink()
    assert [r.path for r in files.where("src is null").collect()] == []  # it is not listed any more
    (tmp_path / "src/dangling.py").symlink_to(tmp_path / "none")
    assert "src/dangling.py" not in {r.path for r in scan.scan(spark, str(tmp_path)).collect()}


def test_file_that_vanishes_has_no_source(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x")
    (tmp_path / "src/b.py").write_text("y")
    files = scan.scan(spark, str(tmp_path))  # few folders: listed by the driver, at once
    (tmp_path / "src/b.py").unlink()
    assert {r.path: r.src for r in files.collect()} == {"src/a.py": "x", "src/b.py": None}


def test_empty_corpus(spark):
    a = analysis.analyse(frame(spark, {"a.py": ""}).limit(0))
    assert a.files.count() == 0 and a.edges.count() == 0


def test_null_and_empty_sources(spark):
    rows = [("a.py", None), ("b.py", ""), ("c.ts", "import x from './a'\n" * 3), ("d.py", "def broken(:\n  def inner():")]
    a = analysis.analyse(spark.createDataFrame(rows, "path string, src string"))
    got = {r.path: r for r in a.files.collect()}
    assert len(got) == 4 and got["d.py"].functions == ["broken", "inner"]


def test_resolution(spark):
    files = {
        "src/demoapp/__init__.py": "",
        "src/demoapp/service.py": "def run(): pass",
        "src/demoapp/main.py": "from demoapp.service import run",
        "src/lib/util.ts": "export const a = 1",
        "src/main.ts": "import {a} from '@lib/util'\nimport b from './lib/util'",
    }
    a = analysis.analyse(frame(spark, files), aliases=[("@lib", "src/lib"), ("demoapp", "src/demoapp")])
    got = {tuple(e) for e in a.edges.collect()}
    assert ("src/demoapp/main.py", "src/demoapp/service.py") in got and ("src/main.ts", "src/lib/util.ts") in got


def test_rule_overrides(spark):
    cfg = RuleConfig(segment_rules=[("app", "special", 0.99)], domain_overrides={"x/": "mine"}, criticality_overrides={"x/": "infra"})
    a, _ = analysis.records(frame(spark, {"x/app/a.py": ""}), cfg)
    row = a.first()
    assert (row.file_type, row.domain, row.criticality) == ("special", "mine", "infra")


def test_distributed_graph_equals_local(spark):
    pairs = [(f"n{i:02d}", f"n{(i * 7 + 3) % 40:02d}") for i in range(40)] + [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(0, 39, 3)]
    edges = spark.createDataFrame([p for p in set(pairs) if p[0] != p[1]], "src string, dst string")
    nodes = spark.createDataFrame([(f"n{i:02d}",) for i in range(45)], "path string")
    near = dict(graph.pagerank(nodes, edges).collect())
    far = dict(graph.pagerank(nodes, edges, 0).collect())
    assert near == pytest.approx(far, abs=1e-12)
    assert sorted(graph.components(nodes, edges).collect()) == sorted(graph.components(nodes, edges, 0).collect())


def test_chunks_and_lines(spark):
    src = "\n".join("x" * 40 for _ in range(500))
    rows = extract.chunk_plan(frame(spark, {"a.txt": src, "e.txt": ""}), 100).collect()
    assert {r.path for r in rows} == {"a.txt"} and all(r.tokens == 100 for r in rows) and sum(r.n_lines for r in rows) == 500
    n = spark.createDataFrame([("a\r\nb\x0bc\n",)], "s string").select(F.size(X.lines("s"))).first()[0]
    assert n == len("a\r\nb\x0bc\n".splitlines())


def test_scan_filters(spark, tmp_path):
    for name, body in {"src/a.py": "x", "src/node_modules/b.py": "x", "src/c.lock": "x", "src/d.py": "\xff", "other.py": "x", ".gitignore": "d*\n"}.items():
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(body)
    (tmp_path / "src/bad.py").write_bytes(b"ok\xff\xfe")
    got = {r.path: r.src for r in scan.scan(spark, str(tmp_path)).collect()}
    assert got == {"src/a.py": "x", "src/bad.py": "ok"}


def test_snapshot(spark, tmp_path):
    now = spark.createDataFrame([("a", 1.0, 5), ("b", 2.0, 6)], "path string, mtime double, size long").withColumn("key", snapshot.cache_key("c"))
    folder = str(tmp_path / "cache")
    assert snapshot.load(spark, folder, "key string").isEmpty()
    snapshot.store(now.where("path = 'a'"), folder, 1)
    old = snapshot.load(spark, folder, "key string")
    assert [r.path for r in snapshot.misses(now, old).collect()] == ["b"]
    assert [r.path for r in snapshot.hits(now, old).collect()] == ["a"]


def test_config(tmp_path):
    assert config.validate(str(tmp_path)) == (True, "ok")
    (tmp_path / config.CONFIG_FILE).write_text("- a\n- b\n")
    ok, message = config.validate(str(tmp_path))
    assert not ok and "mapping" in message and config.load(str(tmp_path)) == config.ProjectConfig()
    (tmp_path / config.CONFIG_FILE).write_text("max_depth: 9\nsecurity: {enabled: false}\ntype_name_rules: [[foo, bar]]\ngit: {logs_count: 3}\n")
    cfg = config.load(str(tmp_path))
    assert (cfg.max_depth, cfg.security_enabled, cfg.git_logs_count) == (9, False, 3) and cfg.rules.name_rules == [("foo", "bar", 0.75)]
    fast = config.apply_profile(cfg, "fast")
    assert fast.max_depth <= 4 and fast.chunk_max_tokens <= 400
    assert config.apply_profile(cfg, "security").security_enabled
    with pytest.raises(ValueError):
        config.apply_profile(cfg, "other")


def test_aliases(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"compilerOptions": {"baseUrl": "src"}}))
    (tmp_path / "tsconfig.json").write_text(json.dumps({"extends": "./base", "compilerOptions": {"paths": {"@lib/*": ["lib/*"], "@out": ["../../x"]}}}))
    (tmp_path / "package.json").write_text(json.dumps({"_moduleAliases": {"@m": "src/m"}, "workspaces": ["packages/*"], "name": "@org/pkg"}))
    (tmp_path / "packages/one/src/deep").mkdir(parents=True)
    (tmp_path / "packages/one/package.json").write_text("{}")
    (tmp_path / "pyproject.toml").write_text('[tool.setuptools.packages.find]\nwhere = ["src"]\n')
    (tmp_path / "src/demo").mkdir(parents=True)
    got = dict(aliases.import_aliases(str(tmp_path)))
    assert got == {"@lib": "src/lib", "@m": "src/m", "src": "src", "demo": "src/demo", "one": "packages/one", "deep": "packages/one/src/deep"}
    assert aliases.package_names(str(tmp_path)) == ["pkg"]


def test_git_sources(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    assert not gitlog.is_repo(str(tmp_path)) and gitlog.recent_commits(spark, str(tmp_path)).count() == 0
    git("init", "-q")
    (tmp_path / "a.py").write_text("1")
    git("add", ".")
    git("commit", "-q", "-m", "first")
    assert [r.message for r in gitlog.recent_commits(spark, str(tmp_path)).collect()] == ["first"]
    assert dict(gitlog.change_frequency(spark, str(tmp_path)).collect()) == {"a.py": 1}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/app.py").write_text(FILES["src/keys.py"])
    run = lambda *a: cli.main([str(tmp_path), *a], spark)
    assert cli.main([str(tmp_path / "none")], spark) == 1
    assert run("--validate-config") == 0
    assert run("--format", "json", "--output", str(tmp_path / "out"), "--fail-on-secret", "--tour", "--diagnostics") == 2
    assert (tmp_path / "out/corpus_report.json").is_file()
    assert run("--summary-only", "--no-security", "--fail-on-secret") == 0
    assert (tmp_path / cli.CACHE).is_dir() and "optional_dependencies" in capsys.readouterr().out
    before = len(list((tmp_path / cli.CACHE).iterdir()))
    assert run("--summary-only", "--no-cache", "--verbose") == 0 and len(list((tmp_path / cli.CACHE).iterdir())) == before
    assert "total_files: 1" in capsys.readouterr().out


def test_lookup_order(spark):
    files = spark.createDataFrame([("a/x.py",), ("b/x.py",)], "path string")
    idx = dict(resolve.file_index(files).collect())
    assert idx["x.py"] == "b/x.py" and idx["a/x"] == "a/x.py"
