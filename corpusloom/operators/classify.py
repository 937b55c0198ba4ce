"""Type, domain, layer, criticality, complexity and hints: row-local column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import rules, text as X
from corpusloom.functions.rules import RuleConfig

#: The record of a file that could not be read or parsed.
FAILED = {
    "file_type": "module", "type_confidence": 0.3, "domain": "core", "domain_confidence": 0.3, "secondary_domain": None,
    "layer": "unknown", "criticality": "supporting", "entrypoint": False, "complexity_label": "low", "complexity_score": 0,
}


def entrypoint(main_guard: Column, listens: Column) -> Column:
    named = F.expr(
        f"array_contains({X.sql_array(rules.ENTRY_NAMES)}, lower(element_at(split(path, '/'), -1)))"
        f" or arrays_overlap(transform({X.sql_dirs()}, d -> lower(d)), {X.sql_array(rules.ENTRY_DIRS)})"
    )
    return named | main_guard | listens


def _types(rows: list[tuple[str, str, float]]) -> str:
    """SQL array of ``word, value, confidence``."""
    return "array(" + ", ".join(
        f"named_struct('word', {X.quoted(w)}, 'value', {X.quoted(t)}, 'confidence', {float(c)!r}D)" for w, t, c in rows
    ) + ")"


def file_type(config: RuleConfig = RuleConfig()) -> Column:
    """First matching rule: directories, stem, suffixes, exact names, code (by ``entrypoint``), module."""
    segments = [*config.segment_rules, *((w, t, 0.9) for w, t in rules.SEGMENT_RULES)]
    names = [*config.name_rules, *((w, t, 0.75) for w, t in rules.NAME_RULES)]
    suffixes = [(s, *v) for s, v in config.suffix_rules.items()] + [(x, t, c) for xs, t, c in rules.SUFFIX_TYPES for x in xs]
    exact = [(s, *v) for s, v in config.exact_name_rules.items()] + [(x, t, c) for xs, t, c in rules.EXACT_TYPES for x in xs]
    name = "element_at(split(path, '/'), -1)"
    sfx = f"lower(regexp_extract({name}, '^.+(\\\\.[^.]+)$', 1))"
    stem = f"lower(regexp_replace({name}, '(?<=.)\\\\.[^.]+$', ''))"
    code = f"array_contains({X.sql_array(['.py', *rules.JS_SUFFIXES])}, {sfx})"
    first = lambda rows, test: f"get(filter({_types(rows)}, r -> {test}), 0)"
    found = [
        first(segments, f"array_contains(transform({X.sql_dirs()}, d -> lower(d)), r.word)"),
        first(names, f"contains({stem}, r.word)"),
        first(suffixes, f"r.word = {sfx}"),
        first(exact, f"r.word = {name}"),
        f"case when {code} and entrypoint then {_types([('', 'entrypoint', 0.8)])}[0] when {code} then {_types([('', 'module', 0.55)])}[0]"
        f" else {_types([('', 'module', 0.5)])}[0] end",
    ]
    return F.expr(f"coalesce({', '.join(found)})")


def points() -> Column:
    """``array<struct<domain, points>>``: what speaks for which domain, in order of appearance."""
    typed = "array<struct<domain:string,points:double>>"

    def hits(*sources: tuple[str, float]) -> str:
        words = ", ".join(f"transform({tokens}, t -> struct(t as t, {w!r}D as w))" for tokens, w in sources)
        found = f"transform(concat({words}), x -> struct(element_at({X.sql_map(rules.DOMAIN_KEYWORDS)}, x.t) as domain, x.w as points))"
        return f"cast(filter({found}, x -> x.domain is not null) as {typed})"

    of = lambda names: f"flatten(transform(concat({names}), n -> {X.sql_tokens('n')}))"
    content = f"cast(transform(content_domains, d -> struct(d as domain, 1.0D as points)) as {typed})"
    rest = hits((of("external, internal"), 2.5), (of("functions, classes, exports"), 1.5), (X.sql_tokens("coalesce(module_doc, '')"), 1.2))
    return F.expr(f"concat({hits((X.sql_tokens('path'), 2.0))}, {content}, {rest})")


def evidence() -> Column:
    """``array<struct<domain, score>>`` of ``points``, in order of first appearance; ties later go to that order."""
    return F.expr(
        "transform(array_distinct(points.domain), d -> struct(d as domain,"
        " aggregate(filter(points, p -> p.domain = d), 0.0D, (a, p) -> a + p.points) as score))"
    )


def top_entries(entries: Column, key: str, value: str, k: int) -> Column:
    """First ``k`` by value, descending; equal values keep their order."""
    indexed = F.transform(entries, lambda x, i: F.struct((-x[value]).alias("neg"), i.alias("i"), x.alias("x")))
    return F.slice(F.transform(F.array_sort(indexed), lambda e: e["x"]), 1, k)


def domain_pick(ev: Column, config: RuleConfig = RuleConfig()) -> Column:
    """``struct<value, confidence, secondary>``."""
    ranked = top_entries(ev, "domain", "score", 2)
    total = F.aggregate(ev, F.lit(0.0), lambda a, x: a + F.greatest(x["score"], F.lit(0.0)))
    first, second = F.try_element_at(ranked, F.lit(1)), F.try_element_at(ranked, F.lit(2))
    share = first["score"] / F.greatest(F.lit(1.0), total)
    confidence = X.half_even(F.least(F.lit(0.95), 0.5 + share * 0.45), 3)
    picked = F.when(F.size(ev) == 0, F.struct(F.lit("core").alias("value"), F.lit(0.4).alias("confidence"), F.lit(None).cast("string").alias("secondary"))).otherwise(
        F.struct(first["domain"].alias("value"), confidence.alias("confidence"), second["domain"].alias("secondary"))
    )
    arms = [
        F.when(F.col("path").startswith(p.lstrip("/")), F.struct(F.lit(d).alias("value"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("secondary")))
        for p, d in config.domain_overrides.items()
    ]
    return F.coalesce(*arms, picked)


def layer(ftype: Column) -> Column:
    first = X.map_literal(rules.LAYERS)
    rows = "array(" + ", ".join(f"struct({X.quoted(w)} as w, {X.quoted(v)} as v)" for w, v in rules.LAYERS) + ")"
    by_path = F.expr(f"get(filter({rows}, r -> array_contains({X.sql_tokens('path')}, r.w)), 0).v")
    return (
        F.when(ftype == "config", F.lit("infrastructure"))
        .when(ftype.isin("docs", "asset", "template"), F.lit("unknown"))
        .otherwise(F.coalesce(F.element_at(first, ftype), by_path, F.lit("unknown")))
    )


def criticality_signals(ftype: Column, domain: Column, entry: Column, warnings: Column) -> dict[str, Column]:
    """Signals by name; null where one does not apply."""
    baseline = F.coalesce(F.element_at(X.map_literal(list(rules.BASELINE.items())).cast("map<string,double>"), ftype), F.lit(rules.BASELINE_OTHER))
    deps = f"flatten(transform(concat(external, internal), n -> {X.sql_tokens('n')}))"

    def overlap(tokens: str, words: list[str]) -> Column:
        return F.expr(f"arrays_overlap({tokens}, {X.sql_array(words)})")

    return {
        "type_baseline": baseline,
        "entrypoint_boost": F.when(entry, 30.0),
        "critical_domain_boost": F.when(domain.isin(rules.CRITICAL_DOMAINS), 20.0),
        "path_risk_boost": F.when(overlap(X.sql_tokens("path"), rules.RISKY_PATH), 14.0),
        "dependency_risk_boost": F.when(overlap(deps, rules.RISKY_DEPENDENCY), 12.0),
        "secret_warning_boost": F.when(F.exists(warnings, lambda w: F.lower(w).contains("secret")), 10.0),
    }


def total(signals: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in signals.values()])


def as_map(signals: dict[str, Column]) -> Column:
    m = F.create_map(*[x for k, v in signals.items() for x in (F.lit(k), v.cast("double"))])
    return F.map_filter(m, lambda k, v: v.isNotNull())


def criticality(ftype: Column, score: Column, config: RuleConfig = RuleConfig()) -> Column:
    arms = [F.when(F.col("path").startswith(p.lstrip("/")), F.lit(c)) for p, c in config.criticality_overrides.items()]
    word = (
        F.when(score >= 70, F.lit("critical"))
        .when(score >= 45, F.lit("infra"))
        .when(ftype.isin(rules.CONFIG_TYPES), F.lit("config"))
        .otherwise(F.lit("supporting"))
    )
    return F.coalesce(*arms, word)


def import_entropy() -> Column:
    """Shannon entropy in bits of the first path segments of ``internal``."""
    heads = "transform(internal, x -> split(x, '/')[0])"
    shares = f"transform(array_distinct({heads}), h -> size(filter({heads}, y -> y = h)) / cast(size(internal) as double))"
    return F.expr(f"case when size(internal) > 0 then aggregate({shares}, 0.0D, (a, p) -> a + -p * log2(p)) else 0.0D end")


def complexity_signals() -> dict[str, Column]:
    d = lambda c: c.cast("double")
    return {
        "size": d(F.col("lines")),
        "responsibilities": d((F.size("functions") + F.size("classes") * 2) * 12),
        "fanout": d(F.size("internal") * 8),
        "branches": d(F.col("branches") * 11),
        "logical_ops": d(F.col("logical_ops") * 4),
        "nesting": d(F.col("nesting") * 18),
        "long_lines": d(F.col("long_lines") * 2),
        "entropy": import_entropy() * 10,
    }


def complexity_label(score: Column) -> Column:
    return F.when(score > 1300, "extreme").when(score > 700, "high").when(score > 280, "medium").otherwise("low")


def hint_keywords(ftype: str = "file_type", domain: str = "domain") -> Column:
    heads = "transform(slice(concat(external, internal), 1, 12), d -> substring_index(substring_index(regexp_replace(d, '^@+', ''), '/', 1), '.', 1))"
    camel = "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
    words = f"flatten(transform(concat(slice(functions, 1, 8), slice(classes, 1, 5)), s -> split(lower(regexp_replace(s, '{camel}', '_')), '_')))"
    places = f"transform({X.sql_dirs()}, p -> regexp_replace(p, '^[./]+|[./]+$', ''))"
    return F.expr(
        f"array_sort(array_distinct(concat(array({domain}, {ftype}),"
        f" transform(filter({heads}, h -> length(h) > 1), h -> lower(h)),"
        f" filter({words}, w -> length(w) > 3),"
        f" transform(filter({places}, p -> length(p) > 2 and p not in ('src', 'lib', 'app')), p -> lower(p)), probes)))"
    )


def description(ftype: Column, domain: Column) -> Column:
    parent = F.try_element_at(X.dirs("path"), F.lit(-1))
    place = F.when(parent.isNotNull() & ~parent.isin("src", ".", ""), F.concat(F.lit(" in "), parent, F.lit("/"))).otherwise("")
    made = F.concat(ftype, F.lit(" for "), domain, F.lit(" domain"), place)
    doc = F.substring(F.split(F.trim("module_doc"), "\n")[0], 1, 120)
    return F.when(F.length(F.coalesce("module_doc", F.lit(""))) > 0, doc).otherwise(made)


def classify(records: DataFrame, config: RuleConfig = RuleConfig()) -> DataFrame:
    """Adds every classification column to features with ``external`` and ``internal``."""
    out = records.withColumn("warnings", F.transform("secrets", _warning)).withColumn(
        "entrypoint", entrypoint(F.col("main_guard"), F.col("listens"))
    )
    out = out.withColumns({"ft": file_type(config), "points": points()}).withColumn("evidence", evidence())
    out = out.withColumn("dom", domain_pick(F.col("evidence"), config))
    ftype, dom = F.col("ft.value"), F.col("dom.value")
    crit = criticality_signals(ftype, dom, F.col("entrypoint"), F.col("warnings"))
    comp = complexity_signals()
    out = out.withColumns(
        {
            "file_type": ftype,
            "type_confidence": F.col("ft.confidence"),
            "domain": dom,
            "domain_confidence": F.col("dom.confidence"),
            "secondary_domain": F.col("dom.secondary"),
            "layer": layer(ftype),
            "criticality_score": total(crit),
            "criticality_signals": as_map(crit),
            "complexity_signals": as_map(comp),
            "complexity_score": X.half_even(total(comp)).cast("int"),
        }
    )
    out = out.withColumns(
        {
            "criticality": criticality(F.col("file_type"), F.col("criticality_score"), config),
            "complexity_label": complexity_label(F.col("complexity_score")),
            "keywords": hint_keywords(),
            "description": description(F.col("file_type"), F.col("domain")),
        }
    ).drop("ft", "dom", "points")
    return out.withColumns({c: F.when(F.col("failed"), F.lit(v)).otherwise(F.col(c)) for c, v in FAILED.items()})


def _warning(x: Column) -> Column:
    from corpusloom.operators.extract import secret_warning

    return secret_warning(x)
