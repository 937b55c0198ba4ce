"""Command line: analyse a folder, write documents, gate on findings, or answer queries on stdio."""

from __future__ import annotations

import argparse
import importlib.util
import sys
from pathlib import Path

from pyspark.sql import SparkSession, functions as F

from corpusloom import __version__
from corpusloom.api import QueryService
from corpusloom.operators import score
from corpusloom.plans import analysis, tour
from corpusloom.session import local_session
from corpusloom.sinks import documents, payload
from corpusloom.sources import aliases, config as project, gitlog, scan

PROFILES = ["fast", "standard", "deep", "security"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    p.add_argument("root", nargs="?", default=".")
    p.add_argument("--format", choices=[*documents.WRITERS, "all"], default="all")
    p.add_argument("--output", help="folder of the documents")
    p.add_argument("--instruction-file")
    p.add_argument("--no-security", action="store_true")
    p.add_argument("--no-cache", action="store_true", help="extract every file again and keep no snapshot")
    p.add_argument("--verbose", action="store_true", help="print the configuration")
    p.add_argument("--profile", choices=PROFILES, default="standard")
    p.add_argument("--fail-on-warning", action="store_true")
    p.add_argument("--fail-on-secret", action="store_true")
    p.add_argument("--summary-only", action="store_true")
    p.add_argument("--diagnostics", action="store_true")
    p.add_argument("--serve", action="store_true", help="answer JSON-RPC lines on stdin")
    p.add_argument("--tour", action="store_true", help="print the tour's script")
    p.add_argument("--validate-config", action="store_true")
    p.add_argument("--version", action="version", version=__version__)
    return p


def git_context(spark: SparkSession, root: str, cfg: project.ProjectConfig) -> dict:
    out: dict = {}
    if not gitlog.is_repo(root):
        return out
    if cfg.git_include_logs:
        out["recent_commits"] = [r.asDict() for r in gitlog.recent_commits(spark, root, cfg.git_logs_count).collect()]
    if cfg.git_include_diffs:
        out["diff_stat"] = gitlog.diff_stat(root)
    if cfg.git_sort_by_changes:
        rows = gitlog.change_frequency(spark, root, cfg.git_sort_max_commits).collect()
        out["change_frequency"] = {r.file: r.changes for r in rows}
    return out


#: Folder of the snapshots below the root.
CACHE = ".corpusloom-cache"


def analyse(spark: SparkSession, root: str, cfg: project.ProjectConfig, cache: bool = True) -> analysis.Analysis:
    files = scan.scan(spark, root, cfg.scan(root))
    packages = spark.createDataFrame([(x,) for x in aliases.package_names(root)], "name string")
    names = aliases.bare_names(files).unionByName(packages)
    return analysis.analyse(
        files, cfg.rules, aliases.import_aliases(root), names, cfg.security_enabled,
        chunk_tokens=cfg.chunk_max_tokens, cache=str(Path(root) / CACHE) if cache else None,
    )


def optional_dependencies() -> dict[str, bool]:
    """Which optional packages can be imported, by the name they are installed under."""
    names = {"pyyaml": "yaml", "pathspec": "pathspec", "jinja2": "jinja2", "tiktoken": "tiktoken", "pydub": "pydub", "pyttsx3": "pyttsx3"}
    return {label: importlib.util.find_spec(module) is not None for label, module in names.items()}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    root = Path(args.root).resolve()
    if not root.is_dir():
        print(f"no folder: {root}", file=sys.stderr)
        return 1
    ok, message = project.validate(str(root))
    if args.validate_config or not ok:
        print(message, file=sys.stderr)
        return 0 if ok else 1
    cfg = project.apply_profile(project.load(str(root)), args.profile)
    if args.no_security:
        cfg = project.replace(cfg, security_enabled=False)
    spark = spark or local_session()
    if args.verbose:
        print(f"configuration: {cfg}", file=sys.stderr)
    a = analyse(spark, str(root), cfg, not args.no_cache)
    git = git_context(spark, str(root), cfg)
    if args.serve:
        changes = gitlog.change_frequency(spark, str(root), cfg.git_sort_max_commits) if gitlog.is_repo(str(root)) else None
        QueryService(a, changes).serve()
        return 0
    instruction = args.instruction_file or cfg.instruction_file
    text = ""
    if instruction and (f := root / instruction).is_file():
        text = f.read_text(encoding="utf-8", errors="ignore").strip()
    report = payload.report(a, root.name, text, git, cfg.security_enabled)
    print(", ".join(f"{k}: {v}" for k, v in report.stats.items()))
    if args.diagnostics:
        print(report.diagnostics | {"optional_dependencies": optional_dependencies()})
    if args.tour:
        print(tour.script(root.name, [r.asDict() for r in tour.overview(a.files).collect()]))
    if not args.summary_only:
        out = Path(args.output) if args.output else root / cfg.output_dir
        out.mkdir(parents=True, exist_ok=True)
        formats = list(documents.WRITERS) if args.format == "all" else [args.format]
        print("\n".join(documents.write(report, str(out), formats)))
    if args.fail_on_warning and report.diagnostics["warning_count"]:
        return 2
    secret = F.exists("warnings", score.is_secret_warning)
    return 2 if args.fail_on_secret and not a.files.where(secret).isEmpty() else 0


if __name__ == "__main__":
    sys.exit(main())
