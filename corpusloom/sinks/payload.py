"""What the document sinks write: small aggregates, and the files as a stream.

The aggregates are bounded (top lists) or one row a module; files are streamed
in order of path, one partition at a time, so a document of any size needs
little driver memory.  For corpora too large for one document, ``tables``
writes the same rows as partitioned Parquet without the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom import __version__
from corpusloom.operators import score
from corpusloom.plans.analysis import Analysis

TOP_HOTSPOTS, TOP_DASHBOARD = 15, 20


@dataclass
class Report:
    project: str
    stats: dict
    hotspots: list[dict]
    modules: dict[str, list[str]]
    diagnostics: dict
    files: Callable[[], Iterator[dict]]
    edges: Callable[[], Iterator[tuple[str, str]]]
    dashboard: list[dict] = field(default_factory=list)
    module_summary: list[dict] = field(default_factory=list)
    health: dict = field(default_factory=dict)
    instruction: str = ""
    git: dict = field(default_factory=dict)
    version: str = __version__
    generated_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat())


def hints() -> Column:
    return F.struct(
        F.col("description"),
        F.col("keywords"),
        F.struct(
            score.top_map("criticality_signals", 6).alias("criticality_signals"),
            score.top_map("complexity_signals", 6).alias("complexity_signals"),
            score.top_map(F.map_from_entries("evidence"), 5).alias("domain_evidence"),
        ).alias("classification"),
    )


def file_rows(files: DataFrame) -> DataFrame:
    """The full record of each file, in the reporting names."""
    return files.select(
        F.col("path").alias("file"),
        F.struct(F.col("file_type").alias("value"), F.col("type_confidence").alias("confidence")).alias("file_type"),
        F.struct(F.col("domain").alias("value"), F.col("domain_confidence").alias("confidence")).alias("domain"),
        "secondary_domain", "layer", "criticality", "entrypoint", "complexity_label", "complexity_score",
        "priority_score", "priority_breakdown", "role_hint", "context",
        F.struct("functions", "classes", "exports").alias("capabilities"),
        F.concat("external", "internal").alias("dependencies"),
        F.col("internal").alias("internal_dependencies"),
        "fan_in", "fan_out", "pagerank", "warnings", "is_in_cycle", "impact_radius", "refactor_effort", "blast_radius",
        "module_doc", "docstrings", "type_hints", hints().alias("hints"), "chunks",
    )


def compact_rows(files: DataFrame) -> DataFrame:
    """The short form: two-letter names, cut lists, rounded numbers; criticality keeps its word."""
    c = F.col
    caps = F.struct(*[F.slice(f"capabilities.{k}", 1, 5).alias(k) for k in ("functions", "classes", "exports")])
    return file_rows(files).select(
        c("file").alias("f"), c("file_type").alias("ft"), c("domain").alias("d"), c("secondary_domain").alias("sd"),
        F.left("layer", F.lit(1)).alias("l"), c("criticality").alias("c"), c("entrypoint").alias("ep"),
        F.left("complexity_label", F.lit(1)).alias("cl"), c("complexity_score").alias("cs"), c("priority_score").alias("ps"),
        c("priority_breakdown").alias("pb"), c("context").alias("cx"), c("role_hint").alias("rh"), caps.alias("caps"),
        F.slice("dependencies", 1, 10).alias("deps"), F.slice("internal_dependencies", 1, 10).alias("ideps"),
        c("fan_in").alias("fi"), c("fan_out").alias("fo"), F.round("pagerank", 5).alias("pr"), c("warnings").alias("warns"),
        c("is_in_cycle").alias("cyc"), c("impact_radius").alias("ir"), F.round("refactor_effort", 4).alias("re"),
        c("blast_radius").alias("br"), c("docstrings").alias("docs"), c("type_hints").alias("th"), "hints",
    )


def hotspot_rows(files: DataFrame, n: int = TOP_HOTSPOTS) -> DataFrame:
    top = files.orderBy(F.desc("priority_score"), "path").limit(n)
    return top.select(
        F.col("path").alias("file"), "priority_score", "pagerank", "fan_in", "refactor_effort", "blast_radius",
        "domain", "criticality", F.col("priority_breakdown").alias("score_explanation"),
    )


#: Short and long name of each field of a file, with what stands for a missing value.
_FIELDS = [
    ("sd", "secondary_domain", None), ("cl", "complexity_label", "low"), ("cs", "complexity_score", 0), ("ps", "priority_score", 0),
    ("pb", "priority_breakdown", {}), ("cx", "context", ""), ("rh", "role_hint", ""), ("deps", "dependencies", []),
    ("ideps", "internal_dependencies", []), ("fi", "fan_in", 0), ("fo", "fan_out", 0), ("pr", "pagerank", 0.0), ("warns", "warnings", []),
    ("ir", "impact_radius", 0), ("re", "refactor_effort", 0.0), ("br", "blast_radius", 0), ("docs", "docstrings", {}),
    ("th", "type_hints", {}), ("module_doc", "module_doc", None), ("chunks", "chunks", []),
]
_CRITICALITY = {"c": "critical", "f": "config", "i": "infra", "s": "supporting"}
_LAYER = {"p": "presentation", "a": "application", "d": "domain", "i": "infrastructure", "u": "unknown"}


def normalised(record: dict, path: str = "") -> dict:
    """The full form of one file's record in the full or the short form; missing fields get their defaults."""

    def typed(x) -> dict:
        known = isinstance(x, dict) and {"value", "confidence"} <= set(x)
        return {"value": x["value"], "confidence": x["confidence"]} if known else {"value": "", "confidence": 0.0}

    def word(long: str, short: str, words: dict, other: str) -> str:
        found = [x for x in (record.get(long), record.get(short)) if isinstance(x, str) and x]
        return words.get(found[0], found[0]) if found else other

    caps = record.get("caps") or record.get("capabilities") or {}
    out = {
        "file": str(record.get("f") or record.get("file") or path),
        "file_type": typed(record.get("ft") or record.get("file_type")),
        "domain": typed(record.get("d") or record.get("domain")),
        "layer": word("layer", "l", _LAYER, "unknown"),
        "criticality": word("criticality", "c", _CRITICALITY, "supporting"),
        "entrypoint": bool(record.get("ep") or record.get("entrypoint")),
        "is_in_cycle": bool(record.get("cyc") or record.get("is_in_cycle")),
        "capabilities": {k: list(caps.get(s) or caps.get(k) or []) for s, k in (("fn", "functions"), ("cl", "classes"), ("ex", "exports"))},
    }
    out["hints"] = {"description": "", "keywords": [], "classification": {}} | (record.get("hints") or {})
    for short, long, other in _FIELDS:
        x = record.get(short) or record.get(long) or other
        out[long] = type(other)(x) if isinstance(other, (int, float, list)) else x
    return out


#: Sections that a document of each format cannot do without.
REQUIRED = {f: ["files", "stats"] for f in ("json", "toon", "xml", "html")} | {"md": []}
REQUIRED["html"] = [*REQUIRED["html"], "dependency_graph"]
REQUIRED["xml"] = [*REQUIRED["xml"], "hotspots"]


def validate(sections: dict, fmt: str) -> None:
    """Raises ``ValueError`` that names the sections a document of this format lacks."""
    missing = [k for k in ("generated_at", "project", "version", *REQUIRED.get(fmt, [])) if sections.get(k) is None]
    if missing:
        raise ValueError(f"a {fmt} document needs {', '.join(missing)}")


def sections(r: Report) -> dict:
    """The parts of a report by their names in documents."""
    return {
        "version": r.version, "project": r.project, "generated_at": r.generated_at, "stats": r.stats, "files": r.files,
        "hotspots": r.hotspots, "dependency_graph": r.edges, "modules": r.modules, "diagnostics": r.diagnostics,
    }


def of_records(project: str, records: dict[str, dict], **parts) -> Report:
    """A report over records in either form, as read back from a document; ``parts`` are fields of ``Report``."""
    files = [normalised(x, path) for path, x in records.items()]
    stats = {
        "total_files": len(files), "critical_files": sum(f["criticality"] == "critical" for f in files),
        "entrypoints": sum(f["entrypoint"] for f in files), "domains": len({f["domain"]["value"] for f in files}),
    }
    graph = [(f["file"], d) for f in files for d in f["internal_dependencies"]]
    given = dict(stats=stats, hotspots=[], modules={}, diagnostics={}, files=lambda: iter(files), edges=lambda: iter(graph)) | parts
    return Report(project=project, **given)


def report(a: Analysis, project: str, instruction: str = "", git: dict | None = None, security: bool = True) -> Report:
    files = file_rows(a.files).orderBy("file")
    edges = a.edges.orderBy("src", "dst")
    diagnostics = score.diagnostics(a.files, security, bool(git)).first().asDict()
    return Report(
        project=project,
        stats=score.project_stats(a.files).first().asDict(),
        hotspots=[r.asDict(True) for r in hotspot_rows(a.files).collect()],
        dashboard=[r.asDict(True) for r in hotspot_rows(a.files, TOP_DASHBOARD).collect()],
        modules={r.module: r.files for r in score.modules(a.files).orderBy("module").toLocalIterator()},
        diagnostics=diagnostics,
        files=lambda: (r.asDict(True) for r in files.toLocalIterator(True)),
        edges=lambda: ((r.src, r.dst) for r in edges.toLocalIterator(True)),
        module_summary=[r.asDict() for r in score.module_summary(a.files).collect()],
        health=score.health(a.files, a.edges).first().asDict(),
        instruction=instruction,
        git=git or {},
    )


def tables(a: Analysis, path: str) -> None:
    """All rows as Parquet, written by the executors; files are partitioned by domain."""
    file_rows(a.files).withColumn("domain_", F.col("domain.value")).write.partitionBy("domain_").parquet(f"{path}/files")
    a.edges.write.parquet(f"{path}/edges")
    score.modules(a.files).write.parquet(f"{path}/modules")
