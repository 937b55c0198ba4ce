"""All registered queries of the core engine, with their oracle SQL.

Each query reads whole tables.  Results that several queries share are
computed once per session and table folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from corpusloom.api import filtered, search
from corpusloom.functions import rules, text as X
from corpusloom.operators import classify, extract, graph, resolve, score
from corpusloom.plans import analysis, oracle
from corpusloom.sources import gitlog, scan, snapshot
from corpusloom.sources.corpus import CORPUS_SQL, corpus
from corpusloom.session import grows, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_SHARED: dict[tuple, object] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def shared(spark: SparkSession, sf_dir: str, what: str, make: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _SHARED:
        _SHARED[key] = make()
    return _SHARED[key]


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return shared(spark, sf_dir, "records", lambda: analysis.records(corpus(spark, sf_dir).select("path", "src")))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir)[0]


def full(spark: SparkSession, sf_dir: str) -> analysis.Analysis:
    return shared(spark, sf_dir, "full", lambda: analysis.graded(*_parts(spark, sf_dir)))


def joined(c: str, sep: str = "|"):
    return F.array_join(c, sep)


Q = oracle.sql


@query(Q("SELECT path, domain, round(score, 6) AS score FROM evidence", "evidence"))
def domain_evidence(spark, sf_dir):
    e = records(spark, sf_dir).select("path", F.explode("evidence").alias("e"))
    return e.select("path", "e.domain", F.round("e.score", 6).alias("score"))


@query(Q("SELECT path, domain, secondary_domain, round(domain_confidence, 3) AS confidence FROM pick", "pick"))
def domain_pick(spark, sf_dir):
    return records(spark, sf_dir).select(
        "path", "domain", "secondary_domain", F.round("domain_confidence", 3).alias("confidence")
    )


@query(Q("SELECT domain, path, confidence FROM (SELECT domain, path, round(domain_confidence, 3) AS confidence, row_number() OVER (PARTITION BY domain ORDER BY domain_confidence DESC, path) AS r FROM pick) WHERE r <= 10", "pick"))
def domain_top10(spark, sf_dir):
    w = Window.partitionBy("domain").orderBy(F.desc("domain_confidence"), "path")
    r = records(spark, sf_dir).select("domain", "path", "domain_confidence").withColumn("r", F.row_number().over(w))
    return r.where("r <= 10").select("domain", "path", F.round("domain_confidence", 3).alias("confidence"))


@query(Q("SELECT path, file_type, round(type_confidence, 2) AS confidence FROM types", "types"))
def file_type(spark, sf_dir):
    return records(spark, sf_dir).select("path", "file_type", F.round("type_confidence", 2).alias("confidence"))


@query(Q("SELECT path, layer FROM cls", "cls"))
def layer(spark, sf_dir):
    return records(spark, sf_dir).select("path", "layer")


@query(Q("SELECT path, entrypoint FROM entry", "entry"))
def entrypoint(spark, sf_dir):
    return records(spark, sf_dir).select("path", "entrypoint")


_CRIT = "type_baseline entrypoint_boost critical_domain_boost path_risk_boost dependency_risk_boost secret_warning_boost".split()


@query(Q(f"SELECT path, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _CRIT)}, criticality_score FROM crit", "crit"))
def criticality_signals(spark, sf_dir):
    m = F.col("criticality_signals")
    return records(spark, sf_dir).select("path", *[m[c].alias(c) for c in _CRIT], "criticality_score")


@query(Q("SELECT path, criticality FROM cplx", "cplx"))
def criticality(spark, sf_dir):
    return records(spark, sf_dir).select("path", "criticality")


_CPLX = "size responsibilities fanout branches logical_ops nesting long_lines entropy".split()


@query(Q(f"SELECT path, {', '.join(f'round({c}, 6) AS {c}' for c in _CPLX)} FROM cplx", "cplx"))
def complexity_signals(spark, sf_dir):
    m = F.col("complexity_signals")
    return records(spark, sf_dir).select("path", *[F.round(m[c], 6).alias(c) for c in _CPLX])


@query(Q("SELECT path, complexity_score, complexity_label FROM cxl", "cxl"))
def complexity_label(spark, sf_dir):
    return records(spark, sf_dir).select("path", "complexity_score", "complexity_label")


@query(Q("SELECT path, line, label FROM secrets", "secrets"))
def secret_findings(spark, sf_dir):
    s = records(spark, sf_dir).select("path", F.explode("secrets").alias("s"))
    return s.select("path", "s.line", "s.label")


@query(Q("SELECT label, count(*) AS files, min(line) AS first_line FROM secrets GROUP BY label", "secrets"))
def secret_summary(spark, sf_dir):
    s = records(spark, sf_dir).select(F.explode("secrets").alias("s"))
    return s.groupBy("s.label").agg(F.count(F.lit(1)).alias("files"), F.min("s.line").alias("first_line"))


_CAMEL = "lower(regexp_replace(regexp_replace(s, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'))"
_PROBE = oracle.values([(d, p) for d, p in rules.PROBES], "label, re")


@query(Q(f"""SELECT path, array_to_string(list_sort(list(DISTINCT k)), '|') AS keywords FROM (
  SELECT path, unnest([domain, file_type]) AS k FROM cls
  UNION ALL SELECT path, lower(h) FROM (SELECT path, string_split(string_split(ltrim(unnest((list_concat(external, internal))[1:12]), '@'), '/')[1], '.')[1] AS h FROM rec) WHERE length(h) > 1
  UNION ALL SELECT path, w FROM (SELECT path, unnest(string_split({_CAMEL}, '_')) AS w FROM (SELECT path, unnest(list_concat(functions[1:8], classes[1:5])) AS s FROM rec)) WHERE length(w) > 3
  UNION ALL SELECT path, lower(d) FROM (SELECT path, trim(unnest(dirs), './') AS d FROM rec) WHERE length(d) > 2 AND d NOT IN ('src', 'lib', 'app')
  UNION ALL SELECT path, label FROM rec JOIN {_PROBE} r ON regexp_matches(lower(src), re)) GROUP BY path""", "cls"))
def hint_keywords(spark, sf_dir):
    return records(spark, sf_dir).select("path", joined("keywords").alias("keywords"))


@query(Q(f"SELECT path, label FROM p JOIN {_PROBE} r ON regexp_matches(lower(src), re)", "p"))
def content_probes(spark, sf_dir):
    return records(spark, sf_dir).select("path", F.explode("probes").alias("label"))


@query(Q("SELECT path, concat(file_type, ' for ', domain, ' domain', CASE WHEN dirs[-1] <> 'src' THEN concat(' in ', dirs[-1], '/') ELSE '' END) AS description FROM cls", "cls"))
def hint_description(spark, sf_dir):
    return records(spark, sf_dir).select("path", "description")


def _symbols(spark, sf_dir, suffixes):
    r = records(spark, sf_dir).where(F.lower(X.suffix("path")).isin(suffixes))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("names")) for k in ("functions", "classes", "exports")])
    r = r.select("path", F.explode(kinds).alias("s")).select("path", "s.kind", F.posexplode("s.names").alias("pos", "name"))
    return r.select("path", "kind", "pos", "name")


def _symbols_sql(suffixes):
    return Q(
        " UNION ALL ".join(
            f"SELECT path, '{k}' AS kind, generate_subscripts({k}, 1) - 1 AS pos, unnest({k}) AS name FROM feat WHERE sfx IN ({suffixes})"
            for k in ("functions", "classes", "exports")
        ),
        "feat",
    )


@query(_symbols_sql("'.py'"))
def symbols_py(spark, sf_dir):
    return _symbols(spark, sf_dir, [".py"])


@query(_symbols_sql("'.ts', '.js'"))
def symbols_js(spark, sf_dir):
    return _symbols(spark, sf_dir, rules.JS_SUFFIXES)


@query(Q("SELECT path, array_to_string(list_filter(list_concat(functions, classes, exports), lambda s: contains(lower(s), 'order'))[1:10], '|') AS symbols FROM feat WHERE len(list_filter(list_concat(functions, classes, exports), lambda s: contains(lower(s), 'order'))) > 0", "feat"))
def symbol_search(spark, sf_dir):
    return search(records(spark, sf_dir), "Order").select("path", joined("symbols").alias("symbols"))


@query(Q("SELECT path, pos, spec FROM spec", "spec"))
def imports_raw(spark, sf_dir):
    return resolve.import_specs(records(spark, sf_dir)).select("path", "pos", "spec")


@query(Q("SELECT package, count(*) AS files FROM (SELECT unnest(external) AS package FROM deps) GROUP BY package", "deps"))
def package_usage(spark, sf_dir):
    return records(spark, sf_dir).select(F.explode("external").alias("package")).groupBy("package").agg(F.count(F.lit(1)).alias("files"))


@query(Q("SELECT path, length(src) // 4 AS tokens, CASE WHEN src = '' THEN 0 ELSE len(ls) END AS lines FROM p", "p"))
def token_counts(spark, sf_dir):
    return corpus(spark, sf_dir).select("path", F.expr("length(src) div 4").alias("tokens"), F.size(X.lines("src")).alias("lines"))


@query(Q(f"""SELECT path, chunk, min(i) AS first_line, count(*) AS n_lines, CAST(sum(t) AS BIGINT) AS tokens FROM walk WHERE chunk >= 0 GROUP BY path, chunk""".replace("FROM walk", f"""FROM (
  WITH RECURSIVE ln AS (SELECT path, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM p WHERE src <> ''), tk AS (SELECT path, i, length(x) // 4 AS t FROM ln),
  walk AS (SELECT path, i, t, 0 AS chunk, t AS acc FROM tk WHERE i = 1 UNION ALL
    SELECT k.path, k.i, k.t, CASE WHEN w.acc + k.t > {extract.CHUNK_TOKENS} THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.acc + k.t > {extract.CHUNK_TOKENS} THEN k.t ELSE w.acc + k.t END
    FROM walk w JOIN tk k ON k.path = w.path AND k.i = w.i + 1) SELECT * FROM walk)"""), "p"))
def chunk_plan(spark, sf_dir):
    return extract.chunk_plan(corpus(spark, sf_dir).select("path", "src"))


@query(Q("SELECT key, rel FROM idx", "idx"))
def file_index(spark, sf_dir):
    return resolve.file_index(corpus(spark, sf_dir).select("path"))


@query(Q("SELECT path, pos, spec, rel FROM res", "res"))
def resolve_imports(spark, sf_dir):
    return full(spark, sf_dir).resolved.select("path", "pos", "spec", "rel")


_ALIASES = [("@core", "src/services"), ("@core/deep", "web/auth"), ("~", "lib")]


@query(Q("""SELECT a.path AS path, a.spec, coalesce(h.path, i.rel) AS rel FROM (
    SELECT path, concat(CASE WHEN length(path) % 2 = 0 THEN '@core/' ELSE '@core/deep/' END, stem) AS spec, stem,
      concat(CASE WHEN length(path) % 2 = 0 THEN 'src/services/' ELSE 'web/auth/' END, stem) AS base FROM p) a
  LEFT JOIN p h ON h.path = a.base LEFT JOIN idx i ON i.key = a.stem""", "idx"))
def resolve_alias_prefix(spark, sf_dir):
    files = corpus(spark, sf_dir).select("path")
    prefix = F.when(F.length("path") % 2 == 0, F.lit("@core/")).otherwise(F.lit("@core/deep/"))
    specs = files.select("path", F.lit(0).alias("pos"), F.concat(prefix, X.stem("path")).alias("spec"), F.lit("").alias("base"))
    return resolve.resolve(specs, files, _ALIASES).select("path", "spec", "rel")


@query(Q("SELECT src, dst FROM edges", "edges"))
def edges(spark, sf_dir):
    return full(spark, sf_dir).edges


@query(Q("SELECT path, fan_in, fan_out FROM deg", "deg"))
def degree(spark, sf_dir):
    return full(spark, sf_dir).files.select("path", "fan_in", "fan_out")


@query(Q("SELECT dst AS path, array_to_string(list(src ORDER BY src), '|') AS dependents FROM edges GROUP BY dst", "edges"))
def reverse_edges(spark, sf_dir):
    g = full(spark, sf_dir).edges.groupBy(F.col("dst").alias("path")).agg(F.array_sort(F.collect_list("src")).alias("d"))
    return g.select("path", joined("d").alias("dependents"))


_HUB = "(SELECT dst FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"


def hub(a: analysis.Analysis) -> str:
    """The file with most dependents."""
    return a.edges.groupBy("dst").count().orderBy(F.desc("count"), "dst").first().dst


@query(Q(f"SELECT src AS path FROM edges WHERE dst = {_HUB}", "edges"))
def dependents(spark, sf_dir):
    a = full(spark, sf_dir)
    return a.edges.where(F.col("dst") == hub(a)).select(F.col("src").alias("path"))


@query(Q("SELECT path, CASE WHEN fan_out > 0 THEN impact_radius ELSE 0 END AS impact_radius FROM rad JOIN deg USING (path)", "rad"))
def impact_radius(spark, sf_dir):
    return full(spark, sf_dir).files.select("path", "impact_radius")


@query(Q("SELECT path, blast_radius FROM rad", "rad"))
def blast_radius(spark, sf_dir):
    return full(spark, sf_dir).files.select("path", "blast_radius")


@query(Q("SELECT path, round(pagerank, 9) AS pagerank FROM pr", "pr"))
def pagerank(spark, sf_dir):
    return full(spark, sf_dir).files.select("path", F.round("pagerank", 9).alias("pagerank"))


@query(Q("SELECT path, round(refactor_effort, 4) AS refactor_effort FROM gx", "gx"))
def refactor_effort(spark, sf_dir):
    return full(spark, sf_dir).files.select("path", F.round("refactor_effort", 4).alias("refactor_effort"))


@query(Q("SELECT scc_id, array_to_string(list(path ORDER BY path), '|') AS members FROM scc GROUP BY scc_id", "scc"))
def cycles(spark, sf_dir):
    c = full(spark, sf_dir).files.where("scc_id is not null").groupBy("scc_id").agg(F.array_sort(F.collect_list("path")).alias("m"))
    return c.select("scc_id", joined("m").alias("members"))


@query(Q("SELECT path, s.path IS NOT NULL AS is_in_cycle FROM p LEFT JOIN scc s USING (path)".replace("s.path IS NOT NULL", "scc_id IS NOT NULL"), "scc"))
def cycle_flags(spark, sf_dir):
    return full(spark, sf_dir).files.select("path", "is_in_cycle")


@query(Q("SELECT a.src, a.dst FROM edges a JOIN edges b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst", "edges"))
def mutual_edges(spark, sf_dir):
    return score.mutual_edges(full(spark, sf_dir).edges)


@query(Q("SELECT src AS path FROM edges UNION SELECT dst FROM edges", "edges"))
def endpoint_set(spark, sf_dir):
    return score.endpoint_set(full(spark, sf_dir).edges)


_WALK = f"""both_ AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
w1 AS (SELECT {_HUB} AS path UNION SELECT b FROM both_ WHERE a = {_HUB}), w2 AS (SELECT path FROM w1 UNION SELECT b FROM both_ JOIN w1 ON a = path)"""


@query(Q("", "edges").rstrip() + f",\n{_WALK}\nSELECT src, dst FROM edges WHERE src IN (FROM w2) AND dst IN (FROM w2)")
def subgraph_k(spark, sf_dir):
    a = full(spark, sf_dir)
    return graph.subgraph_edges(a.edges, graph.subgraph_nodes(a.edges, hub(a), 2))


_CHAIN = """far AS (SELECT src, dst FROM hop2 h WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = h.src AND e.dst = h.dst)),
tgt AS (SELECT dst AS t, min(src) AS s FROM far JOIN (SELECT dst, count(*) AS c FROM edges GROUP BY dst) USING (dst) GROUP BY dst, c ORDER BY c DESC, dst LIMIT 1)"""


@query(Q("", "hop2").rstrip() + f",\n{_CHAIN}\nSELECT s AS source, t AS target, concat(s, '|', (SELECT min(a.dst) FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src = s AND b.dst = t), '|', t) AS chain FROM tgt")
def dependency_chain(spark, sf_dir):
    """The path to the file with most dependents of those that some file reaches in two steps, but not in one."""
    a = full(spark, sf_dir)
    far = graph.two_hop(a.edges).where("src != dst").join(grows(a.edges), ["src", "dst"], "left_anti")
    fans = a.edges.groupBy("dst").agg(F.count(F.lit(1)).alias("c"))
    ends = far.groupBy("dst").agg(F.min("src").alias("src")).join(grows(fans), "dst").orderBy(F.desc("c"), "dst").limit(1).collect()
    rows = [(e.src, e.dst, "|".join(graph.dependency_chain(a.edges, e.src, e.dst))) for e in ends]
    return spark.createDataFrame(rows, "source string, target string, chain string")


@query(Q("SELECT path FROM gx WHERE orphan", "gx"))
def orphans(spark, sf_dir):
    return full(spark, sf_dir).files.where(score.is_orphan()).select("path")


@query(Q(f"""SELECT path, array_to_string(list_concat(secret_warnings, list_concat(CASE WHEN is_in_cycle THEN ['{score.CYCLE_WARNING}'] ELSE [] END,
  CASE WHEN orphan THEN ['{score.ORPHAN_WARNING.replace("'", "''")}'] ELSE [] END)), '|') AS warnings FROM gx WHERE len(secret_warnings) > 0 OR is_in_cycle OR orphan""", "gx"))
def orphan_warnings(spark, sf_dir):
    return full(spark, sf_dir).files.where(F.size("warnings") > 0).select("path", joined("warnings").alias("warnings"))


@query(Q("SELECT path, priority_score FROM final"))
def priority_score(spark, sf_dir):
    return full(spark, sf_dir).files.select("path", "priority_score")


_PARTS = "criticality complexity entrypoint pagerank fan_in fan_out_penalty layer_bonus cycle_penalty warning_penalty".split()


@query(Q(f"SELECT path, {', '.join(f'round(CAST(s_{c} AS DOUBLE), 6) + 0.0 AS {c}' for c in _PARTS)} FROM final"))
def score_breakdown(spark, sf_dir):
    m = F.col("priority_breakdown")
    return full(spark, sf_dir).files.select("path", *[(F.round(m[c], 6) + 0.0).alias(c) for c in _PARTS])


_HOT = ["path", "priority_score", "fan_in", "domain", "criticality", "blast_radius"]


def top(files: DataFrame, n: int = 10, offset: int = 0, domain=None, criticality=None, layer=None, warnings_only=False, glob=None) -> DataFrame:
    """Files by priority after the optional filters, ties by path."""
    return filtered(files, domain, criticality, layer, warnings_only, glob).orderBy(F.desc("priority_score"), "path").offset(offset).limit(n)


def _hot_sql(where: str = "true", n: int = 10, offset: int = 0) -> str:
    return Q(f"SELECT {', '.join(_HOT)} FROM final WHERE {where} ORDER BY priority_score DESC, path LIMIT {n} OFFSET {offset}")


@query(_hot_sql())
def hotspots(spark, sf_dir):
    return top(full(spark, sf_dir).files).select(_HOT)


@query(_hot_sql("domain = 'billing'", 10, 5))
def hotspots_domain_page(spark, sf_dir):
    return top(full(spark, sf_dir).files, 10, 5, domain="billing").select(_HOT)


@query(_hot_sql("criticality = 'critical' AND layer = 'application'"))
def hotspots_critical_layer(spark, sf_dir):
    return top(full(spark, sf_dir).files, criticality="critical", layer="application").select(_HOT)


@query(_hot_sql("n_warnings > 0 AND path LIKE 'src/%.py'"))
def hotspots_warned_glob(spark, sf_dir):
    return top(full(spark, sf_dir).files, warnings_only=True, glob="src/*.py").select(_HOT)


@query(Q("SELECT path, blast_radius, fan_in FROM final ORDER BY blast_radius DESC, path LIMIT 10"))
def by_blast(spark, sf_dir):
    return full(spark, sf_dir).files.orderBy(F.desc("blast_radius"), "path").limit(10).select("path", "blast_radius", "fan_in")


@query(Q("SELECT path, round(refactor_effort, 4) AS refactor_effort, complexity_score, fan_in FROM final ORDER BY round(refactor_effort, 4) DESC, path LIMIT 10"))
def refactor_candidates(spark, sf_dir):
    f = full(spark, sf_dir).files.withColumn("refactor_effort", F.round("refactor_effort", 4))
    return f.orderBy(F.desc("refactor_effort"), "path").limit(10).select("path", "refactor_effort", "complexity_score", "fan_in")


@query(Q("SELECT count(*) AS total_files, count(*) FILTER (criticality = 'critical') AS critical_files, count(*) FILTER (entrypoint) AS entrypoints, count(DISTINCT domain) AS domains FROM final"))
def project_stats(spark, sf_dir):
    return score.project_stats(full(spark, sf_dir).files)


_MODULE = "concat(parts[1], '/', domain)"


@query(Q(f"SELECT {_MODULE} AS module, array_to_string(list(path ORDER BY path), '|') AS files FROM cls GROUP BY 1", "cls"))
def modules(spark, sf_dir):
    return score.modules(records(spark, sf_dir)).select("module", joined("files").alias("files"))


@query(Q(f"SELECT {_MODULE} AS module, count(*) AS n_files, min(path) AS sample FROM cls GROUP BY 1 ORDER BY n_files DESC, module LIMIT 15", "cls"))
def module_summary(spark, sf_dir):
    return score.module_summary(records(spark, sf_dir))


@query(Q("SELECT 'full' AS analysis_mode, CAST(sum(len(secret_warnings)) AS BIGINT) AS secret_findings, CAST(sum(n_warnings) AS BIGINT) AS warning_count, true AS security_scan_enabled, false AS git_context_enabled FROM final"))
def diagnostics(spark, sf_dir):
    return score.diagnostics(full(spark, sf_dir).files)


@query(Q("""SELECT n AS n_files, warned, linked, round(greatest(0.0, 1 - warned / (2 * greatest(1, n)) - linked / (4 * greatest(1, n))), 9) AS health FROM
  (SELECT count(*) AS n, CAST(sum(CASE WHEN n_warnings > 0 THEN 1 ELSE 0 END) AS BIGINT) AS warned FROM final), (SELECT count(*) AS linked FROM (SELECT src FROM edges UNION SELECT dst FROM edges))"""))
def health(spark, sf_dir):
    a = full(spark, sf_dir)
    return score.health(a.files, a.edges).withColumn("health", F.round("health", 9))


@query("SELECT CAST(user_id AS VARCHAR) AS file, count(*) AS changes FROM events GROUP BY user_id")
def change_frequency(spark, sf_dir):
    return gitlog.change_counts(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file")))


@query("SELECT CAST(user_id AS VARCHAR) AS file, count(*) AS changes FROM events GROUP BY user_id ORDER BY changes DESC, file LIMIT 10 OFFSET 2")
def volatility(spark, sf_dir):
    counts = change_frequency(spark, sf_dir)
    return counts.orderBy(F.desc("changes"), "file").offset(2).limit(10)


@query("""SELECT left(concat('0123456789ab', CAST(conv_id AS VARCHAR)), 12) AS hash, coalesce(role, '') AS author, concat(role, '@example.com') AS email,
  coalesce(CAST(turn AS VARCHAR), '') AS date, replace(replace(coalesce(text, ''), chr(10), ' '), chr(31), ' ') AS message FROM conversations""")
def recent_commits(spark, sf_dir):
    """Every turn as a log line; what is null is an empty field."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat_ws(
        "\x1f", F.concat(F.lit("0123456789ab"), text("conv_id")), text("role"), F.concat(text("role"), F.lit("@example.com")),
        text("turn"), F.translate(text("text"), "\n\x1f", "  "),
    )
    return gitlog.parse_log(table(spark, sf_dir, "conversations").select(line.alias("value")))


_SCAN = scan.ScanConfig(exclude_patterns=["report_1*"], include_patterns=["src/*.py", "web/*", "*.ts"])


@query(f"WITH {CORPUS_SQL}, x AS (SELECT path, string_split(path, '/')[-1] AS name FROM corpus) SELECT path FROM x WHERE name NOT LIKE 'report\\_1%' ESCAPE '\\' AND name NOT LIKE '%.lock' AND (path LIKE 'src/%.py' OR path LIKE 'web/%' OR path LIKE '%.ts')")
def path_filter(spark, sf_dir):
    return scan.accept(corpus(spark, sf_dir).select("path"), _SCAN)


@query(f"WITH {CORPUS_SQL} SELECT path FROM corpus WHERE path LIKE 'src/%/%.py'")
def include_glob(spark, sf_dir):
    return scan.accept(corpus(spark, sf_dir).select("path"), scan.ScanConfig(include_patterns=["src/**/*.py"]))


_IGNORE = ["*.json", "!main_*.json", "docs", "src/auth/*"]


@query(f"""WITH {CORPUS_SQL}, x AS (SELECT path, string_split(path, '/')[-1] AS name FROM corpus)
SELECT path, CASE WHEN path LIKE 'src/auth/%' THEN true WHEN name LIKE 'main\\_%.json' ESCAPE '\\' THEN false ELSE name LIKE '%.json' END AS ignored FROM x""")
def ignore_rules(spark, sf_dir):
    return corpus(spark, sf_dir).select("path", scan.gitignored(F.col("path"), _IGNORE).alias("ignored"))


_GIT_IGNORE = ["docs/", "/web/**/main_*", "*.json", "!user_*.json", "src/*/cache_client_*"]


@query(f"""WITH {CORPUS_SQL}, x AS (SELECT path, string_split(path, '/') AS p, string_split(path, '/')[-1] AS name FROM corpus)
SELECT path, CASE WHEN p[1] = 'src' AND len(p) > 2 AND p[3] LIKE 'cache\\_client\\_%' ESCAPE '\\' THEN true
  WHEN name LIKE 'user\\_%.json' ESCAPE '\\' THEN false WHEN name LIKE '%.json' THEN true
  WHEN p[1] = 'web' AND name LIKE 'main\\_%' ESCAPE '\\' THEN true ELSE list_contains(p[1:len(p) - 1], 'docs') END AS ignored FROM x""")
def ignore_rules_git(spark, sf_dir):
    """An ignore file as git reads it: folders at any depth, patterns bound to the root, ``**``, the last match wins."""
    return corpus(spark, sf_dir).select("path", scan.git_ignored(F.col("path"), _GIT_IGNORE).alias("ignored"))


@query(f"WITH {CORPUS_SQL} SELECT path FROM corpus WHERE doc_id % 3 = 0")
def incremental_misses(spark, sf_dir):
    """Files whose size differs from the stored snapshot need analysis again."""
    now = corpus(spark, sf_dir).select("doc_id", "path", F.lit(1000.0).alias("mtime"), F.length("src").cast("long").alias("size"))
    old = now.withColumn("size", F.when(F.col("doc_id") % 3 == 0, F.col("size") + 1).otherwise(F.col("size"))).drop("doc_id")
    stored = old.withColumn("key", snapshot.cache_key("cfg")).select("key")
    return snapshot.misses(now.withColumn("key", snapshot.cache_key("cfg")), stored).select("path")


@query(Q("""SELECT path, concat_ws(' ', file_type, domain, left(layer, 1), criticality, CAST(entrypoint AS VARCHAR), left(complexity_label, 1), complexity_score, priority_score, fan_in, fan_out, blast_radius) AS row_ FROM final"""))
def toon_rows(spark, sf_dir):
    c = F.col
    cols = [c("file_type"), c("domain"), F.left("layer", F.lit(1)), c("criticality"), c("entrypoint").cast("string"), F.left("complexity_label", F.lit(1))]
    cols += [c(x).cast("string") for x in ("complexity_score", "priority_score", "fan_in", "fan_out", "blast_radius")]
    return full(spark, sf_dir).files.select("path", F.concat_ws(" ", *cols).alias("row_"))


_SIGNALS = "[" + ", ".join(f"{{'neg': -abs(s_{c}), 'key': '{c}', 'value': s_{c}}}" for c in _PARTS) + "]"


@query(Q(f"""SELECT path, priority_score, round(refactor_effort, 1) AS refactor_effort, blast_radius, domain,
  array_to_string(list_transform(list_sort(list_filter({_SIGNALS}, lambda x: x.value IS NOT NULL))[1:3], lambda x: printf('%s:%.1f', x.key, x.value)), ', ') AS signals
  FROM final ORDER BY priority_score DESC, path LIMIT 10"""))
def markdown_hotspots(spark, sf_dir):
    f = top(full(spark, sf_dir).files, 10)
    return f.select("path", "priority_score", F.round("refactor_effort", 1).alias("refactor_effort"), "blast_radius", "domain", score.top_signals().alias("signals"))


_CAPS = "concat_ws('; ', CASE WHEN len(functions) > 0 THEN concat('functions: ', array_to_string(functions[1:3], ', ')) END, CASE WHEN len(classes) > 0 THEN concat('classes: ', array_to_string(classes[1:2], ', ')) END)"


@query(Q(f"""SELECT path, concat(file_type, ' for ', domain) AS role_hint, concat(upper(criticality[1]), criticality[2:], ' ', file_type, ' for ', chr(39), domain, chr(39), ' domain.',
  CASE WHEN {_CAPS} <> '' THEN concat(' [', {_CAPS}, ']') ELSE '' END, CASE WHEN n_warnings > 0 THEN printf(' [%d warnings]', n_warnings) ELSE '' END,
  printf(' Priority: %d/100. Blast radius: %d files. Refactor effort: %.1f.', priority_score, blast_radius, CAST(refactor_effort AS DOUBLE))) AS context FROM final"""))
def contexts(spark, sf_dir):
    """The corpus has no module documentation; ``test_documentation_decides`` holds that case."""
    return full(spark, sf_dir).files.select("path", "role_hint", "context")


@query(Q("SELECT path, array_to_string(functions, '|') AS functions, array_to_string(classes, '|') AS classes, len(specs) AS imports FROM feat WHERE sfx = '.py'", "feat"))
def ast_symbols(spark, sf_dir):
    r = records(spark, sf_dir).where(F.lower("path").endswith(".py"))
    return r.select("path", joined("functions").alias("functions"), joined("classes").alias("classes"), F.size("specs").alias("imports"))


@query()
def ast_chunks(spark, sf_dir):
    return extract.ast_chunks(corpus(spark, sf_dir).select("path", "src"))


_LINKS = "regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)"


@query(f"SELECT page_id, count(*) AS n_links, count(DISTINCT l) AS n_distinct FROM (SELECT page_id, unnest({_LINKS}) AS l FROM pages) GROUP BY page_id")
def page_links(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("l"))
    return links.groupBy("page_id").agg(F.count("l").alias("n_links"), F.count_distinct("l").alias("n_distinct"))
