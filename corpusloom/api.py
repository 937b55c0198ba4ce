"""Query service over an analysis: point lookups, top lists and graph queries, also as JSON-RPC lines.

Every method plans a filter, a top-k or a bounded walk on the stored tables,
so only its answer reaches the driver.  Ties are ordered by path.
"""

from __future__ import annotations

import json
import sys
from typing import TextIO

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import text as X
from corpusloom.operators import graph, score
from corpusloom.plans.analysis import Analysis
from corpusloom.sinks.payload import hints


def filtered(
    files: DataFrame,
    domain: str | None = None,
    criticality: str | None = None,
    layer: str | None = None,
    warnings_only: bool = False,
    glob: str | None = None,
) -> DataFrame:
    """Conjunction of the filters given."""
    for c, v in (("domain", domain), ("criticality", criticality), ("layer", layer)):
        if v:
            files = files.where(F.col(c) == v)
    if warnings_only:
        files = files.where(F.size("warnings") > 0)
    return files.where(X.any_glob(F.col("path"), [glob])) if glob else files


def page(df: DataFrame, by: str, n: int, offset: int) -> DataFrame:
    """``n`` rows after ``offset`` by ``by`` descending, ties by the first column."""
    return df.orderBy(F.desc(by), df.columns[0]).offset(offset).limit(n)


def search(files: DataFrame, needle: str) -> DataFrame:
    """``path, symbols``: files with a symbol that contains ``needle``, at most ten symbols each."""
    hits = F.filter(F.concat("functions", "classes", "exports"), lambda s: F.contains(F.lower(s), F.lit(needle.lower())))
    return files.select("path", F.slice(hits, 1, 10).alias("symbols")).where(F.size("symbols") > 0)


METHODS = (
    "get_dependents search_symbol get_file_summary list_hotspots list_orphans list_by_blast_radius "
    "list_refactor_candidates get_subgraph get_dependency_chain explain_score list_cycles list_by_volatility"
).split()


def file_() -> Column:
    return F.col("path").alias("file")


class QueryService:
    def __init__(self, analysis: Analysis, change_frequency: DataFrame | None = None):
        self.files, self.edges = analysis.files, analysis.edges
        self.changes = change_frequency

    def _one(self, path: str, columns: list) -> dict | None:
        row = self.files.where(F.col("path") == path).select(*columns).first()
        return row.asDict(True) if row else None

    def _rows(self, df: DataFrame) -> list[dict]:
        return [r.asDict(True) for r in df.collect()]

    def get_dependents(self, file_path: str) -> list[str]:
        return [r.src for r in self.edges.where(F.col("dst") == file_path).select("src").orderBy("src").collect()]

    def search_symbol(self, symbol_name: str) -> list[dict]:
        return self._rows(search(self.files, symbol_name).select(file_(), "symbols").orderBy("file"))

    def get_file_summary(self, file_path: str) -> dict | None:
        cut8 = F.struct(*[F.slice(c, 1, 8).alias(c) for c in ("functions", "classes", "exports")])
        out = self._one(
            file_path,
            [
                file_(), hints().alias("hints"), "module_doc", "file_type", "domain", "layer", "criticality", "entrypoint",
                "complexity_label", "complexity_score", "priority_score", "fan_in", "fan_out",
                F.round("pagerank", 5).alias("pagerank"), F.round("refactor_effort", 4).alias("refactor_effort"),
                "blast_radius", F.slice(F.concat("external", "internal"), 1, 10).alias("dependencies"),
                F.slice("internal", 1, 10).alias("internal_dependencies"), "warnings", cut8.alias("capabilities"),
            ],
        )
        if out:
            out["capabilities"] = {k: v for k, v in out["capabilities"].items() if v}
        return out

    def list_hotspots(
        self,
        n: int = 10,
        offset: int = 0,
        domain: str | None = None,
        criticality: str | None = None,
        layer: str | None = None,
        warnings_only: bool = False,
    ) -> list[dict]:
        files = filtered(self.files, domain, criticality, layer, warnings_only).select(
            file_(), "priority_score", F.round("pagerank", 5).alias("pagerank"), "fan_in", "domain", "criticality",
            F.round("refactor_effort", 4).alias("refactor_effort"), "blast_radius",
            F.col("priority_breakdown").alias("score_explanation"),
        )
        return self._rows(page(files, "priority_score", n, offset))

    def list_orphans(self, offset: int = 0, limit: int = 50) -> list[str]:
        found = self.files.where(score.is_orphan()).select(file_()).orderBy("file").offset(offset).limit(limit)
        return [r.file for r in found.collect()]

    def list_by_blast_radius(self, n: int = 10, offset: int = 0, domain: str | None = None) -> list[dict]:
        files = filtered(self.files, domain).select(file_(), "blast_radius", "fan_in")
        return self._rows(page(files, "blast_radius", n, offset))

    def list_refactor_candidates(self, n: int = 10, offset: int = 0, criticality: str | None = None) -> list[dict]:
        effort = F.round("refactor_effort", 4).alias("refactor_effort")
        files = filtered(self.files, None, criticality).select(file_(), effort, "complexity_score", "fan_in")
        return self._rows(page(files, "refactor_effort", n, offset))

    def get_subgraph(self, file_path: str, depth: int = 1) -> dict:
        nodes = graph.subgraph_nodes(self.edges, file_path, depth)
        inside = graph.subgraph_edges(self.edges, nodes).orderBy("src", "dst")
        return {
            "root": file_path,
            "depth": depth,
            "nodes": [r.path for r in nodes.orderBy("path").collect()],
            "edges": [[r.src, r.dst] for r in inside.collect()],
        }

    def get_dependency_chain(self, source: str, target: str, direction: str = "outbound") -> list[str]:
        return graph.dependency_chain(self.edges, source, target, direction)

    def explain_score(self, file_path: str) -> dict | None:
        return self._one(
            file_path,
            [
                file_(), "priority_score", "criticality", "complexity_label", "fan_in", "fan_out",
                F.round("pagerank", 5).alias("pagerank"), "blast_radius", "priority_breakdown", "warnings", hints().alias("hints"),
            ],
        )

    def list_cycles(self) -> list[list[str]]:
        members = self.files.where("scc_id is not null").groupBy("scc_id").agg(F.array_sort(F.collect_list("path")).alias("m"))
        return [r.m for r in members.orderBy("scc_id").collect()]

    def list_by_volatility(self, n: int = 10, offset: int = 0) -> list[dict]:
        return [] if self.changes is None else self._rows(page(self.changes.select("file", "changes"), "changes", n, offset))

    def dispatch(self, request: object) -> dict:
        """The response to one JSON-RPC request."""
        request = request if isinstance(request, dict) else {}
        name, params = request.get("method", ""), request.get("params")
        head = {"jsonrpc": "2.0", "id": request.get("id")}

        def failed(code: int, message: str) -> dict:
            return {**head, "error": {"code": code, "message": message}}

        if name not in METHODS:
            return failed(-32601, f"unknown method {name!r}")
        try:
            return {**head, "result": getattr(self, name)(**(params if isinstance(params, dict) else {}))}
        except TypeError as e:
            return failed(-32602, f"bad parameters: {e}")
        except Exception as e:  # noqa: BLE001  the loop must go on
            return failed(-32603, str(e))

    def serve(self, lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
        """Answers one request a line until the input ends."""
        for line in filter(None, map(str.strip, lines)):
            try:
                answer = self.dispatch(json.loads(line))
            except json.JSONDecodeError as e:
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": f"no JSON: {e}"}}
            out.write(json.dumps(answer, ensure_ascii=False) + "\n")
            out.flush()
