"""Import aliases and bare module names from a project's metadata files.

Targets are paths relative to the root, as everything is resolved against the
scanned files; targets outside the root are left out.
"""

from __future__ import annotations

import json
import os
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions import text as X


def _mapping(x) -> dict:
    return x if isinstance(x, dict) else {}


def _json(f: Path) -> dict:
    try:
        return _mapping(json.loads(f.read_text(encoding="utf-8", errors="ignore")))
    except (OSError, ValueError):
        return {}


def _toml(f: Path) -> dict:
    try:
        return tomllib.loads(f.read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}


def _inside(root: Path, *parts: str) -> str | None:
    """Normal relative path, or None outside ``root``."""
    p = os.path.normpath(os.path.join(root, *parts))
    rel = os.path.relpath(p, root)
    return None if rel.startswith("..") else "" if rel == "." else rel


def _bare(x: str) -> str:
    return x.rstrip("/*")


def _compiler_options(root: Path) -> dict:
    """Options of ``tsconfig.json`` over those of its parent, which must lie inside the root."""
    own = _json(root / "tsconfig.json")
    options = _mapping(own.get("compilerOptions"))
    if isinstance(own.get("extends"), str):
        name = own["extends"] if Path(own["extends"]).suffix else own["extends"] + ".json"
        rel = _inside(root, name)
        if rel:
            options = {**_mapping(_json(root / rel).get("compilerOptions")), **options}
    return options


def workspaces(root: Path, package: dict) -> list[Path]:
    """Folders with a ``package.json`` that the workspace patterns name."""
    globs = package.get("workspaces")
    globs = _mapping(globs).get("packages", globs)
    found = []
    for g in globs if isinstance(globs, list) else []:
        if isinstance(g, str) and g and not os.path.isabs(g):
            found += [p for p in sorted(root.glob(g)) if p.is_dir() and (p / "package.json").is_file()]
    return found


def import_aliases(folder: str) -> list[tuple[str, str]]:
    """``(alias, target)``; an alias set by an earlier kind of file is replaced by later ones, folders only fill gaps."""
    root = Path(folder).resolve()
    found: dict[str, str | None] = {}
    ts = _compiler_options(root)
    for alias, targets in _mapping(ts.get("paths")).items():
        if isinstance(targets, list) and targets:
            found[_bare(alias)] = _inside(root, str(ts.get("baseUrl", ".")), _bare(str(targets[0])))
    package = _json(root / "package.json")
    for alias, target in _mapping(package.get("_moduleAliases")).items():
        found[_bare(alias)] = _inside(root, str(target))
    for alias, target in _mapping(_mapping(_toml(root / "bunfig.toml").get("bundle")).get("alias")).items():
        found[_bare(alias)] = _inside(root, str(target))
    folders: list[Path] = []
    if (root / "pyproject.toml").is_file():
        node = _toml(root / "pyproject.toml")
        for key in "tool setuptools packages find".split():
            node = _mapping(node.get(key))
        for where in node.get("where", []) if isinstance(node.get("where"), list) else []:
            found[str(where)] = _inside(root, str(where))
        if (root / "src").is_dir():
            found.setdefault("src", "src")
            folders.append(root / "src")
    for w in workspaces(root, package):
        found.setdefault(w.name, _inside(root, str(w)))
        folders.append(w / "src")
    for f in folders:
        for child in sorted(f.iterdir()) if f.is_dir() else []:
            if child.is_dir():
                found.setdefault(child.name, _inside(root, str(child)))
    return sorted((a, t) for a, t in found.items() if a and t is not None)


def package_names(folder: str) -> list[str]:
    """Last segments of the package's ``name``, ``main`` and ``module``."""
    package = _json(Path(folder) / "package.json")
    return sorted({v.split("/")[-1] for k in ("name", "main", "module") if isinstance(v := package.get(k), str)} - {""})


def bare_names(files: DataFrame) -> DataFrame:
    """Distinct ``name``: stems and parent folders of the files."""
    parts = X.parts("path")
    names = F.array(X.stem("path"), F.when(F.size(parts) > 1, F.element_at(parts, -2)))
    return files.select(F.explode(names).alias("name")).where("name is not null and name != ''").distinct()
