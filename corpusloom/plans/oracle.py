"""DuckDB SQL of the analysis, built up as one chain of common table expressions."""

from __future__ import annotations

from corpusloom.functions import rules
from corpusloom.operators import resolve
from corpusloom.sources.corpus import CORPUS_SQL

NL = "chr(10)"


def values(rows: list[tuple], names: str) -> str:
    """``VALUES`` relation."""

    def lit(x) -> str:
        if x is None:
            return "NULL"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({names}))"


def strings(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def toks(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^a-zA-Z0-9]+'), lambda t: t <> '')"


def ranked(pairs: list[tuple]) -> list[tuple]:
    return [(i, *p) for i, p in enumerate(pairs)]


_first: dict[str, str] = {}
for _k, _d in rules.DOMAIN_KEYWORDS:
    _first.setdefault(_k, _d)
JS = strings(rules.JS_SUFFIXES)
_SECRETS = [(i, label, rules.SECRET_RE2.get(label, p)) for i, (label, p) in enumerate(rules.SECRETS)]
_SUFFIX_TYPES = [(i, s, t, c) for i, (ss, t, c) in enumerate(rules.SUFFIX_TYPES) for s in ss]
_EXACT_TYPES = [(i, s, t, c) for i, (ss, t, c) in enumerate(rules.EXACT_TYPES) for s in ss]


def _case(weights: dict[str, float], key: str, other: float) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items())
    return f"CAST(CASE {key} {arms} ELSE {other} END AS DOUBLE)"


#: name -> SQL, in dependency order.
CTES: dict[str, str] = {
    "p": """SELECT path, src, string_split(path, '/') AS parts, string_split(path, '/')[-1] AS name,
      string_split(path, '/')[1:len(string_split(path, '/')) - 1] AS dirs,
      regexp_replace(string_split(path, '/')[-1], '^(.+)\\.[^.]+$', '\\1') AS stem,
      regexp_extract(string_split(path, '/')[-1], '^.+(\\.[^.]+)$', 1) AS sfx,
      string_split(CASE WHEN suffix(src, chr(10)) THEN left(src, length(src) - 1) ELSE src END, chr(10)) AS ls FROM corpus""",
    "raw_feat": f"""SELECT path, src, parts, name, dirs, stem, sfx, ls,
      CASE WHEN sfx = '.py' THEN list_concat(regexp_extract_all(src, '(?m)^(?:async )?def (\\w+)\\(', 1), regexp_extract_all(src, '(?m)^ +(?:async )?def (\\w+)\\(', 1))
        WHEN list_contains({JS}, sfx) THEN list_concat(regexp_extract_all(src, '(?:export\\s+)?(?:async\\s+)?function\\s+([A-Za-z_$][\\w$]*)\\s*\\(', 1),
          regexp_extract_all(src, '(?:export\\s+)?(?:const|let|var)\\s+([A-Za-z_$][\\w$]*)\\s*=', 1)) ELSE [] END AS functions,
      CASE WHEN sfx = '.py' OR list_contains({JS}, sfx) THEN regexp_extract_all(src, '(?m)^(?:export )?class (\\w+)', 1) ELSE [] END AS classes,
      CASE WHEN list_contains({JS}, sfx) THEN list_concat(
          list_transform(string_split(regexp_extract(src, 'export\\s+\\{{([^}}]+)\\}}', 1), ','), lambda x: trim(string_split(trim(x), ' as ')[1])),
          regexp_extract_all(src, 'export\\s+default\\s+([A-Za-z_$][\\w$]*)', 1)) ELSE [] END AS exports,
      CASE WHEN sfx = '.py' THEN regexp_extract_all(src, '(?m)^(?:import|from) ([\\w.]+)', 1)
        WHEN list_contains({JS}, sfx) THEN list_concat(regexp_extract_all(src, 'import\\s+(?:[^''"]+?from\\s+)?[''"]([^''"]+)[''"]', 1),
          regexp_extract_all(src, 'require\\(\\s*[''"]([^''"]+)[''"]\\s*\\)', 1)) ELSE [] END AS specs FROM p""",
    "feat": "SELECT * REPLACE ("
    + ", ".join(f"list_filter({c}, lambda x, i: list_position({c}, x) = i)[1:20] AS {c}" for c in ("functions", "classes", "exports"))
    + ") FROM raw_feat",
    "secrets": f"""SELECT path, label, rank, min(line) AS line FROM (
        SELECT path, unnest(ls) AS t, generate_subscripts(ls, 1) AS line FROM p
        WHERE NOT list_contains({strings(rules.SECRET_SKIP_SUFFIXES)}, lower(sfx)) AND NOT list_contains({strings(rules.SECRET_SKIP_NAMES)}, name)) x
      JOIN {values(_SECRETS, 'rank, label, re')} r ON regexp_matches(t, re)
      WHERE NOT regexp_matches(t, '^\\s*(?:#|//|\\*|<!--)') GROUP BY path, label, rank""",
    "spec": f"""SELECT path, sfx, dirs, unnest(specs) AS spec, generate_subscripts(specs, 1) - 1 AS pos FROM feat""",
    "specb": """SELECT *, CASE WHEN sfx = '.py' THEN string_split(spec, '.')[1] ELSE string_split(spec, '/')[1] END AS base FROM spec""",
    "idx": """SELECT key, max(path) AS rel FROM (
        SELECT path, unnest([path, name, stem, concat(parts[-2], '/', stem), concat('/repo/', array_to_string(dirs, '/')), concat(parts[-2], '/', name)]) AS key FROM p) GROUP BY key""",
    # The corpus imports top-level modules and "./name" only: the stem of the last segment decides.
    "res": """SELECT s.path, s.pos, s.spec, s.base, s.sfx,
        CASE WHEN s.spec LIKE 'node:%' THEN NULL ELSE coalesce(full_.rel, last_.rel, head_.rel) END AS rel
      FROM specb s
      LEFT JOIN idx full_ ON full_.key = CASE WHEN s.spec LIKE './%' THEN concat(array_to_string(s.dirs, '/'), '/', s.spec[3:]) END
      LEFT JOIN idx last_ ON last_.key = CASE WHEN s.sfx = '.py' THEN string_split(s.spec, '.')[-1] ELSE string_split(s.spec, '/')[-1] END
      LEFT JOIN idx head_ ON head_.key = CASE WHEN s.spec NOT LIKE '.%' THEN s.base END""",
    "deps": f"""SELECT path, list_sort(list(DISTINCT rel) FILTER (rel IS NOT NULL)) AS internal,
        list_sort(list(DISTINCT base) FILTER (rel IS NULL AND base <> '' AND CASE WHEN sfx = '.py' THEN NOT list_contains({strings(resolve.STDLIB)}, base) ELSE spec NOT LIKE 'node:%' END)) AS external
      FROM res GROUP BY path""",
    "edges": "SELECT DISTINCT path AS src, rel AS dst FROM res WHERE rel IS NOT NULL AND rel <> path",
    "rec": """SELECT f.*, coalesce(d.internal, []) AS internal, coalesce(d.external, []) AS external,
        coalesce((SELECT list(concat('Possible secret detected: ', label, ' (line ', line, ')') ORDER BY line, rank) FROM secrets s WHERE s.path = f.path), []) AS secret_warnings
      FROM feat f LEFT JOIN deps d USING (path)""",
    "entry": f"""SELECT path, (list_contains({strings(rules.ENTRY_NAMES)}, lower(name)) OR list_has_any(list_transform(dirs, lambda d: lower(d)), {strings(rules.ENTRY_DIRS)})
        OR (lower(sfx) = '.py' AND regexp_matches(src, 'if\\s+__name__\\s*==\\s*[''"]__main__[''"]')) OR (list_contains({JS}, lower(sfx)) AND regexp_matches(src, '\\.listen\\s*\\('))) AS entrypoint FROM p""",
    "types": f"""SELECT path, entrypoint, coalesce(seg.t, nam.t, suf.t, exa.t, CASE WHEN code AND entrypoint THEN 'entrypoint' ELSE 'module' END) AS file_type,
        CASE WHEN seg.t IS NOT NULL THEN 0.9 WHEN nam.t IS NOT NULL THEN 0.75 WHEN suf.t IS NOT NULL THEN suf.c WHEN exa.t IS NOT NULL THEN exa.c
          WHEN code AND entrypoint THEN 0.8 WHEN code THEN 0.55 ELSE 0.5 END AS type_confidence
      FROM (SELECT p.*, e.entrypoint, list_contains({strings(['.py', *rules.JS_SUFFIXES])}, lower(sfx)) AS code FROM p JOIN entry e USING (path)) q
      LEFT JOIN (SELECT path, arg_min(t, i) AS t FROM p JOIN {values(ranked(rules.SEGMENT_RULES), 'i, k, t')} r ON list_contains(list_transform(dirs, lambda d: lower(d)), k) GROUP BY path) seg USING (path)
      LEFT JOIN (SELECT path, arg_min(t, i) AS t FROM p JOIN {values(ranked(rules.NAME_RULES), 'i, k, t')} r ON contains(lower(stem), k) GROUP BY path) nam USING (path)
      LEFT JOIN (SELECT path, arg_min(t, i) AS t, arg_min(c, i) AS c FROM p JOIN {values(_SUFFIX_TYPES, 'i, k, t, c')} r ON lower(sfx) = k GROUP BY path) suf USING (path)
      LEFT JOIN (SELECT path, arg_min(t, i) AS t, arg_min(c, i) AS c FROM p JOIN {values(_EXACT_TYPES, 'i, k, t, c')} r ON name = k GROUP BY path) exa USING (path)""",
    "points": f"""SELECT path, d AS domain, w AS points, s AS stream, i AS pos FROM (
        SELECT path, unnest(tk) AS k, generate_subscripts(tk, 1) AS i, 2.0 AS w, 1 AS s FROM (SELECT path, {toks('path')} AS tk FROM rec)
        UNION ALL SELECT path, unnest(tk), generate_subscripts(tk, 1), 2.5, 3 FROM (SELECT path, flatten(list_transform(list_concat(external, internal), lambda x: {toks('x')})) AS tk FROM rec)
        UNION ALL SELECT path, unnest(tk), generate_subscripts(tk, 1), 1.5, 4 FROM (SELECT path, flatten(list_transform(list_concat(functions, classes, exports), lambda x: {toks('x')})) AS tk FROM rec)) x
      JOIN {values(list(_first.items()), 'k, d')} m USING (k)
      UNION ALL SELECT path, d, 1.0, 2, i FROM rec JOIN {values(ranked(rules.DOMAIN_KEYWORDS), 'i, k, d')} m ON contains(lower(src), k)""",
    "evidence": "SELECT path, domain, CAST(sum(points) AS DOUBLE) AS score, min(stream * 100000 + pos) AS first_seen FROM points GROUP BY path, domain",
    "pick": """SELECT path, coalesce(arg_min(domain, r) FILTER (r = 1), 'core') AS domain, arg_min(domain, r) FILTER (r = 2) AS secondary_domain,
        CASE WHEN count(domain) = 0 THEN 0.4 ELSE round_even(least(0.95, 0.5 + max(score) / greatest(1.0, sum(score)) * 0.45), 3) END AS domain_confidence
      FROM p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, first_seen) AS r FROM evidence) e USING (path) GROUP BY path""",
    "cls": f"""SELECT r.*, t.entrypoint, t.file_type, t.type_confidence, k.domain, k.secondary_domain, k.domain_confidence,
        CASE WHEN file_type = 'config' THEN 'infrastructure' WHEN file_type IN ('docs', 'asset', 'template') THEN 'unknown'
          ELSE coalesce((SELECT l FROM {values(rules.LAYERS, 'w, l')} m WHERE w = file_type),
            (SELECT arg_min(l, i) FROM {values(ranked(rules.LAYERS), 'i, w, l')} m WHERE list_contains({toks('r.path')}, w)), 'unknown') END AS layer,
        {_case(rules.BASELINE, 'file_type', rules.BASELINE_OTHER)} AS type_baseline,
        CASE WHEN entrypoint THEN 30.0 END AS entrypoint_boost,
        CASE WHEN list_contains({strings(rules.CRITICAL_DOMAINS)}, domain) THEN 20.0 END AS critical_domain_boost,
        CASE WHEN list_has_any({toks('r.path')}, {strings(rules.RISKY_PATH)}) THEN 14.0 END AS path_risk_boost,
        CASE WHEN list_has_any(flatten(list_transform(list_concat(external, internal), lambda x: {toks('x')})), {strings(rules.RISKY_DEPENDENCY)}) THEN 12.0 END AS dependency_risk_boost,
        CASE WHEN len(secret_warnings) > 0 THEN 10.0 END AS secret_warning_boost
      FROM rec r JOIN types t USING (path) JOIN pick k USING (path)""",
    "crit": f"""SELECT *, CAST(type_baseline + coalesce(entrypoint_boost, 0) + coalesce(critical_domain_boost, 0) + coalesce(path_risk_boost, 0) + coalesce(dependency_risk_boost, 0) + coalesce(secret_warning_boost, 0) AS DOUBLE) AS criticality_score FROM cls""",
    "heads": "SELECT path, h, count(*) AS c, sum(count(*)) OVER (PARTITION BY path) AS n FROM (SELECT path, unnest(list_transform(internal, lambda x: string_split(x, '/')[1])) AS h FROM rec) GROUP BY path, h",
    "cplx": f"""SELECT c.*, CASE WHEN criticality_score >= 70 THEN 'critical' WHEN criticality_score >= 45 THEN 'infra'
          WHEN list_contains({strings(rules.CONFIG_TYPES)}, file_type) THEN 'config' ELSE 'supporting' END AS criticality,
        CAST(CASE WHEN src = '' THEN 0 ELSE len(ls) END AS DOUBLE) AS size, CAST((len(functions) + 2 * len(classes)) * 12 AS DOUBLE) AS responsibilities, CAST(len(internal) * 8 AS DOUBLE) AS fanout,
        CAST(len(regexp_extract_all(src, '\\b(if|elif|for|while|case|switch|catch|except)\\b')) * 11 AS DOUBLE) AS branches,
        CAST(len(regexp_extract_all(src, '&&|\\|\\|')) * 4 AS DOUBLE) AS logical_ops,
        CAST(coalesce(list_max(list_transform(list_filter(ls, lambda x: NOT regexp_matches(x, '^ *(?:$|#|//|/?\\*)')), lambda x: (length(x) - length(ltrim(x, ' '))) // 4)), 0) * 18 AS DOUBLE) AS nesting,
        CAST(len(list_filter(ls, lambda x: length(x) > 120)) * 2 AS DOUBLE) AS long_lines,
        coalesce((SELECT sum(-(c / n) * log2(c / n)) FROM heads h WHERE h.path = c.path), 0.0) * 10 AS entropy FROM crit c""",
    "cx": """SELECT *, CAST(round_even(size + responsibilities + fanout + branches + logical_ops + nesting + long_lines + entropy, 0) AS INTEGER) AS complexity_score FROM cplx""",
    "cxl": "SELECT *, CASE WHEN complexity_score > 1300 THEN 'extreme' WHEN complexity_score > 700 THEN 'high' WHEN complexity_score > 280 THEN 'medium' ELSE 'low' END AS complexity_label FROM cx",
    "deg": """SELECT p.path, coalesce(i.c, 0) AS fan_in, coalesce(o.c, 0) AS fan_out FROM p
      LEFT JOIN (SELECT dst AS path, count(*) AS c FROM edges GROUP BY 1) i USING (path) LEFT JOIN (SELECT src AS path, count(*) AS c FROM edges GROUP BY 1) o USING (path)""",
    "hop2": "SELECT src, dst FROM edges UNION SELECT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src",
    "rad": """SELECT p.path, coalesce(f.c, 0) AS impact_radius, coalesce(b.c, 0) AS blast_radius FROM p
      LEFT JOIN (SELECT src AS path, count(*) AS c FROM hop2 WHERE src <> dst GROUP BY 1) f USING (path) LEFT JOIN (SELECT dst AS path, count(*) AS c FROM hop2 GROUP BY 1) b USING (path)""",
    "reach": "SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src",
    "scc": "SELECT a.src AS path, least(a.src, min(a.dst)) AS scc_id FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src HAVING count(*) FILTER (a.src <> a.dst) > 0",
    "pr0": "SELECT path, fan_out AS o, 1.0 / count(*) OVER () AS r, 1.0 AS moved, count(*) OVER () AS n FROM deg",
}
for _i in range(30):
    CTES[f"pi{_i + 1}"] = (
        f"SELECT a.path, a.o, a.n, a.r AS old, a.moved, 0.15 / a.n + 0.85 * (coalesce(i.s, 0.0) + (SELECT coalesce(sum(r), 0.0) FROM pr{_i} WHERE o = 0) / a.n) AS nw"
        f" FROM pr{_i} a LEFT JOIN (SELECT e.dst AS path, sum(q.r / q.o) AS s FROM edges e JOIN pr{_i} q ON q.path = e.src GROUP BY 1) i USING (path)"
    )
    CTES[f"pr{_i + 1}"] = (
        f"SELECT path, o, CASE WHEN moved < 1e-6 THEN old ELSE nw END AS r, CASE WHEN moved < 1e-6 THEN moved ELSE sum(abs(nw - old)) OVER () END AS moved, n FROM pi{_i + 1}"
    )
CTES |= {
    "pr": "SELECT path, r / sum(r) OVER () AS pagerank FROM pr30",
    "gx": """SELECT c.*, d.fan_in, d.fan_out, pr.pagerank, CASE WHEN d.fan_out > 0 THEN r.impact_radius ELSE 0 END AS impact_radius, r.blast_radius, s.scc_id, s.scc_id IS NOT NULL AS is_in_cycle,
        c.complexity_score / (d.fan_in + 1) * abs(ln(pr.pagerank + 1e-9)) AS refactor_effort,
        d.fan_in = 0 AND NOT c.entrypoint AND NOT list_contains(['docs', 'config', 'asset', 'template'], c.file_type) AS orphan
      FROM cxl c JOIN deg d USING (path) JOIN pr USING (path) JOIN rad r USING (path) LEFT JOIN scc s USING (path)""",
    "full_": f"""SELECT *, len(secret_warnings) + CAST(is_in_cycle AS INT) + CAST(orphan AS INT) AS n_warnings,
        {_case(rules.CRITICALITY_WEIGHT, 'criticality', 5.0)} AS s_criticality, {_case(rules.COMPLEXITY_WEIGHT, 'complexity_label', 3.0)} AS s_complexity,
        CASE WHEN entrypoint THEN 15.0 ELSE 0.0 END AS s_entrypoint, least(20.0, pagerank * 1000) AS s_pagerank, least(10.0, fan_in / 2) AS s_fan_in,
        -least(5.0, greatest(0.0, fan_out - 15.0)) AS s_fan_out_penalty, {_case(rules.LAYER_BONUS, 'layer', 0.0)} AS s_layer_bonus,
        CASE WHEN is_in_cycle THEN -10.0 END AS s_cycle_penalty FROM gx""",
    "full2": "SELECT *, CASE WHEN n_warnings > 0 THEN -least(8.0, n_warnings) END AS s_warning_penalty FROM full_",
    "final": """SELECT *, CAST(greatest(0, least(100, round_even(s_criticality + s_complexity + s_entrypoint + s_pagerank + s_fan_in + s_fan_out_penalty + s_layer_bonus
        + coalesce(s_cycle_penalty, 0) + coalesce(s_warning_penalty, 0), 0))) AS INTEGER) AS priority_score FROM full2""",
}


_HEAVY = {"p", "feat", "secrets", "res", "idx", "deps", "edges", "rec", "evidence", "cls", "cx", "deg", "hop2", "scc", "pr", "final"} | {
    f"pr{i}" for i in range(31)
}


def sql(select: str, upto: str = "final") -> str:
    """The chain up to one relation, then the final query."""
    parts = [CORPUS_SQL.strip()]
    for name, body in CTES.items():
        parts.append(f"{name} AS {'MATERIALIZED ' if name in _HEAVY else ''}({body})")
        if name == upto:
            break
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select
