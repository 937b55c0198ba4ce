"""Priority scores, warnings from the graph, contexts and the project's aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import rules, text as X
from corpusloom.session import grows

CYCLE_WARNING = "File is part of a dependency cycle"
ORPHAN_WARNING = "Orphan file - no file imports it and it's not an entrypoint"


def lookup(weights: dict[str, float], key: Column, other: float) -> Column:
    return F.coalesce(F.element_at(X.map_literal(list(weights.items())).cast("map<string,double>"), key), F.lit(other))


def refactor_effort() -> Column:
    return F.col("complexity_score") / (F.col("fan_in") + 1) * F.abs(F.log(F.col("pagerank") + 1e-9))


def is_orphan() -> Column:
    return (F.col("fan_in") == 0) & ~F.col("entrypoint") & ~F.col("file_type").isin(rules.ORPHAN_EXEMPT)


def graph_warnings() -> Column:
    """Warnings with those of cycle and orphan rules appended, in this order."""
    none = F.array().cast("array<string>")
    return F.concat(
        "warnings",
        F.when(F.col("is_in_cycle"), F.array(F.lit(CYCLE_WARNING))).otherwise(none),
        F.when(is_orphan(), F.array(F.lit(ORPHAN_WARNING))).otherwise(none),
    )


def breakdown() -> dict[str, Column]:
    """Score parts by name; null where a part does not apply."""
    warns = F.size("warnings")
    return {
        "criticality": lookup(rules.CRITICALITY_WEIGHT, F.col("criticality"), 5.0),
        "complexity": lookup(rules.COMPLEXITY_WEIGHT, F.col("complexity_label"), 3.0),
        "entrypoint": F.when(F.col("entrypoint"), 15.0).otherwise(0.0),
        "pagerank": F.least(F.lit(20.0), F.col("pagerank") * 1000.0),
        "fan_in": F.least(F.lit(10.0), F.col("fan_in") / 2.0),
        "fan_out_penalty": -F.least(F.lit(5.0), F.greatest(F.lit(0.0), F.col("fan_out") - 15.0)),
        "layer_bonus": lookup(rules.LAYER_BONUS, F.col("layer"), 0.0),
        "cycle_penalty": F.when(F.col("is_in_cycle"), -10.0),
        "warning_penalty": F.when(warns > 0, -F.least(F.lit(8.0), warns.cast("double"))),
    }


def with_scores(files: DataFrame) -> DataFrame:
    from corpusloom.operators.classify import as_map, total

    parts = breakdown()
    score = F.greatest(F.lit(0), F.least(F.lit(100), X.half_even(total(parts)).cast("int")))
    return files.withColumns({"priority_score": score, "priority_breakdown": as_map(parts)})


def contexts(files: DataFrame) -> DataFrame:
    """Adds ``role_hint`` and ``context``."""
    has_doc = F.length(F.coalesce("module_doc", F.lit(""))) > 0
    hint = F.when(
        has_doc, F.concat(F.col("file_type"), F.lit(" - "), F.substring(F.trim("module_doc"), 1, 80))
    ).otherwise(F.concat(F.col("file_type"), F.lit(" for "), F.col("domain")))

    def listed(label: str, names: str, k: int) -> Column:
        return F.when(
            F.size(names) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.slice(names, 1, k), ", "))
        )

    caps = F.concat_ws("; ", listed("functions", "functions", 3), listed("classes", "classes", 2))
    text = F.concat(
        F.initcap("criticality"), F.lit(" "), F.col("file_type"), F.lit(" for '"), F.col("domain"), F.lit("' domain."),
        F.when(caps != "", F.concat(F.lit(" ["), caps, F.lit("]"))).otherwise(""),
        F.when(F.size("warnings") > 0, F.format_string(" [%d warnings]", F.size("warnings"))).otherwise(""),
        F.format_string(
            " Priority: %d/100. Blast radius: %d files. Refactor effort: %.1f.",
            F.col("priority_score"), F.col("blast_radius"), F.col("refactor_effort"),
        ),
    )
    return files.withColumns({"role_hint": hint, "context": text})


def project_stats(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("criticality") == "critical").alias("critical_files"),
        F.count_if("entrypoint").alias("entrypoints"),
        F.count_distinct("domain").alias("domains"),
    )


def module_key() -> Column:
    p = X.parts("path")
    return F.when(F.size(p) > 1, F.concat(p[0], F.lit("/"), F.col("domain"))).otherwise(F.col("domain"))


def modules(files: DataFrame) -> DataFrame:
    """``module, files`` with sorted members."""
    return files.groupBy(module_key().alias("module")).agg(F.array_sort(F.collect_list("path")).alias("files"))


def module_summary(files: DataFrame, top: int = 15) -> DataFrame:
    """``module, n_files, sample``: the largest modules."""
    return (
        files.groupBy(module_key().alias("module"))
        .agg(F.count(F.lit(1)).alias("n_files"), F.min("path").alias("sample"))
        .orderBy(F.desc("n_files"), "module")
        .limit(top)
    )


def is_secret_warning(w: Column) -> Column:
    return F.lower(w).rlike("secret|credential|hardcoded")


def diagnostics(files: DataFrame, security: bool = True, git: bool = False) -> DataFrame:
    hits = F.size(F.filter("warnings", is_secret_warning))
    return files.agg(
        F.coalesce(F.sum(hits), F.lit(0)).alias("secret_findings"),
        F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warning_count"),
    ).select(
        F.lit("full").alias("analysis_mode"),
        "secret_findings",
        "warning_count",
        F.lit(security).alias("security_scan_enabled"),
        F.lit(git).alias("git_context_enabled"),
    )


def health(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Dashboard health: its "cyclic" files are all endpoints of edges (see ``mutual_edges`` for true cycles)."""
    ends = edges.select(F.col("src").alias("v")).union(edges.select("dst")).distinct().agg(F.count(F.lit(1)).alias("linked"))
    n = files.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.size("warnings") > 0).cast("int")), F.lit(0)).alias("warned")
    )
    size = F.greatest(F.lit(1), F.col("n"))
    return n.crossJoin(ends).select(
        F.col("n").alias("n_files"),
        "warned",
        "linked",
        F.greatest(F.lit(0.0), 1 - F.col("warned") / (2 * size) - F.col("linked") / (4 * size)).alias("health"),
    )


def mutual_edges(edges: DataFrame) -> DataFrame:
    """Pairs of files that import each other, ``src < dst``."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.where("src < dst").join(grows(back), ["src", "dst"], "left_semi")


def endpoint_set(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("path")).union(edges.select("dst")).distinct()


def top_signals(k: int = 3) -> Column:
    """The strongest parts of a score as ``name:value`` text, by absolute value, ties by name."""
    entries = F.transform(
        F.map_entries("priority_breakdown"),
        lambda e: F.struct((-F.abs(e["value"])).alias("neg"), e["key"].alias("key"), e["value"].alias("value")),
    )
    return F.array_join(
        F.transform(F.slice(F.array_sort(entries), 1, k), lambda e: F.format_string("%s:%.1f", e["key"], e["value"])), ", "
    )


def top_map(m: str | Column, k: int) -> Column:
    """The ``k`` largest entries of a map by value; equal values keep their order."""
    from corpusloom.operators.classify import top_entries

    return F.map_from_entries(top_entries(F.map_entries(m), "key", "value", k))
