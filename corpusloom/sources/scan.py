"""Directory scan: accepted source files as ``path, size, mtime, src``.

A root is a local folder or a URI that ``pyarrow.fs`` knows.  The driver lists the
first levels, tasks walk the folders that are left; ignored folders are never
entered.  The rules are filters on these rows of path, size and time, and only
accepted files are opened.  (Spark's own file source leaves out every name that
begins with ``_`` or ``.``, ``__init__.py`` among them.)  A file that cannot be
read has a null source.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions import rules, text as X
from corpusloom.session import ship

#: Folders from which the driver leaves the walk to tasks.
WALK_FOLDERS = 64
#: Bytes of content that a worker hands on at once.
READ_BYTES = 8_000_000
LISTED = "path string, folder boolean, size long, mtime double"


@dataclass(frozen=True)
class ScanConfig:
    exclude_dirs: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)
    include_patterns: list[str] = field(default_factory=list)
    extra_names: list[str] = field(default_factory=list)
    gitignore: list[str] = field(default_factory=list)


def gitignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last matching pattern ignores the path; ``!`` takes back.  Patterns match as plain globs."""
    out = F.lit(False)
    name = X.name(path)
    for raw in patterns:
        p = raw.strip()
        if not p or p.startswith("#"):
            continue
        keep, p = p.startswith("!"), p.removeprefix("!")
        hit = X.any_glob(name, [p]) | X.any_glob(path, [p, "**/" + p])
        if p.endswith("/"):
            hit = hit | X.any_glob(name, [p.rstrip("/")])
        out = F.when(hit, F.lit(not keep)).otherwise(out)
    return out


def git_rule(line: str) -> tuple[bool, str] | None:
    """``(ignore, regex)`` of a line of an ignore file as git reads it; None for blanks and comments.

    A pattern with a slash before its end is bound to the root, any other holds
    at every depth; ``*`` and ``?`` stay within a segment, ``**`` spans segments;
    what lies below a matching folder matches, and a last slash asks for that.
    """
    p = line.rstrip()
    if not p or p.startswith("#"):
        return None
    ignore, p = not p.startswith("!"), p.removeprefix("!")
    p = p.removeprefix("\\")
    inside = p.endswith("/")
    parts = [x for i, x in enumerate(p.split("/")) if x or i == 0]
    if not any(parts):
        return None
    if parts[0] == "":
        parts = parts[1:]
    elif len(parts) == 1 and parts[0] != "**":
        parts = ["**", *parts]
    out, joint = "", ""
    for i, x in enumerate(parts):
        last = i == len(parts) - 1
        if x == "**":
            out += (joint + ".+" if last else f"(?:{joint}.+)?" if joint else "(?:.+/)?")
            joint = "/" if joint else ""
            continue
        out += joint + X.glob_regex(x, within=True)
        joint = "/"
    if parts[-1] != "**":
        out += "/.*" if inside else "(?:/.*)?"
    return ignore, f"(?s)^{out}$"


def git_ignored(path: Column, patterns: list[str]) -> Column:
    """As ``gitignored``, but with git's own meaning of the patterns."""
    out = F.lit(False)
    for ignore, regex in filter(None, map(git_rule, patterns)):
        out = F.when(path.rlike(regex), F.lit(ignore)).otherwise(out)
    return out


def accept(files: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Rows of ``files`` whose ``path`` passes every rule."""
    name, folder = X.name("path"), X.dirs("path")
    ignored = sorted({*rules.IGNORE_DIRS, *config.exclude_dirs})
    out = files.where(~name.isin(rules.GENERATED_NAMES))
    out = out.where(~F.arrays_overlap(folder, F.array(*map(F.lit, ignored))))
    out = out.where(~X.any_glob(name, [*rules.IGNORE_PATTERNS, *config.exclude_patterns]))
    if config.gitignore:
        out = out.where(~git_ignored(F.col("path"), config.gitignore))
    out = out.where(F.lower(X.suffix("path")).isin(rules.TEXT_SUFFIXES) | name.isin([*rules.SPECIAL_NAMES, *config.extra_names]))
    if config.include_patterns:
        out = out.where(X.any_glob(F.col("path"), config.include_patterns))
    return out


def _uri(root: str) -> str:
    return root.rstrip("/") if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", root) else f"file://{Path(root).resolve()}"


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it; a local path is taken as it is, whatever signs it holds."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    return pafs.FileSystem.from_uri(uri)


def _children(fs: pafs.FileSystem, folder: str, skip: set[str]) -> tuple[list[str], list[tuple]]:
    """Folders to enter and files (rows of ``LISTED``) of one folder; links to folders are not followed."""
    folders, files = [], []
    local = isinstance(fs, pafs.LocalFileSystem)
    for x in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if x.type == pafs.FileType.Directory:
            if x.base_name not in skip and not (local and os.path.islink(x.path)):
                folders.append(x.path)
        elif x.type == pafs.FileType.File:
            files.append((x.path, False, x.size, x.mtime.timestamp() if x.mtime else 0.0))
    return folders, files


def scan_roots(root: str, exclude_dirs: list[str] | None = None) -> list[str]:
    """``root/src`` alone, else each first-level ``child/src``, else the root; paths in the root's file system."""
    fs, base = _file_system(_uri(root))
    is_dir = lambda p: fs.get_file_info(p).type == pafs.FileType.Directory
    if is_dir(f"{base}/src"):
        return [f"{base}/src"]
    children, _ = _children(fs, base, {*rules.IGNORE_DIRS, *(exclude_dirs or [])})
    return [f"{c}/src" for c in sorted(children) if is_dir(f"{c}/src")] or [base]


def gitignore_lines(root: str) -> list[str]:
    f = Path(root) / ".gitignore"
    return f.read_text(encoding="utf-8", errors="ignore").splitlines() if f.is_file() else []


def below(path: str, base: str) -> str:
    """SQL of ``path`` relative to ``base``; ``file:`` URIs have one, two or three slashes."""
    plain = re.sub("^file:/*", "/", base)
    return f"regexp_replace(regexp_replace({path}, '^file:/*', '/'), {X.quoted('^' + X.glob_regex(plain) + '/')}, '')"


def sources(raw: DataFrame, path: str, config: ScanConfig) -> DataFrame:
    """``path, size, mtime, src`` of the accepted rows of a binary file listing (``path`` is SQL): text, invalid bytes dropped."""
    meta = raw.selectExpr(f"{path} as path", "length as size", "cast(modificationTime as double) as mtime", "content")
    # Invalid bytes become U+FFFD and go; in a source with such bytes, so does this character itself.
    raw_text = "cast(content as string)"
    text = F.expr(f"case when is_valid_utf8({raw_text}) then {raw_text} else replace(make_valid_utf8({raw_text}), '\ufffd', '') end")
    return accept(meta, config).select("path", "size", "mtime", text.alias("src"))


def listing(spark: SparkSession, root: str, exclude_dirs: list[str] | None = None) -> DataFrame:
    """``path, folder, size, mtime`` of all files below the scan roots, with full paths."""
    uri, skip = _uri(root), {*rules.IGNORE_DIRS, *(exclude_dirs or [])}
    fs, _ = _file_system(uri)
    front, found = scan_roots(root, exclude_dirs), []
    while front and len(front) < WALK_FOLDERS:
        ahead = []
        for folder in front:
            folders, files = _children(fs, folder, skip)
            ahead += folders
            found += files
        front = ahead
    rows = found + [(p, True, 0, 0.0) for p in front]
    cols = list(zip(*rows)) if rows else [()] * 4
    kinds = (pa.string(), pa.bool_(), pa.int64(), pa.float64())
    start = spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["path", "folder", "size", "mtime"]))
    start = start.repartition(max(1, min(len(rows) // 8, spark.sparkContext.defaultParallelism * 4)))
    if not front:
        return start

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _file_system(uri)
        for b in batches:
            left = [p for p, folder in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if folder]
            yield b.filter(pa.array([not x for x in b.column(1).to_pylist()], pa.bool_()))
            while left:
                folders, files = _children(fs, left.pop(), skip)
                left += folders
                if files:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*files), kinds)], names=b.schema.names)

    return start.mapInArrow(walk, LISTED)


def scan(spark: SparkSession, root: str, config: ScanConfig | None = None) -> DataFrame:
    """``path, size, mtime, src`` of the accepted files below ``root``; ``src`` is null if a file cannot be read."""
    ship(spark)
    config = config or ScanConfig(gitignore=gitignore_lines(root))
    uri = _uri(root)
    base = _file_system(uri)[1].rstrip("/")
    relative = F.substr("path", F.lit(len(base) + 2))
    meta = accept(listing(spark, root, config.exclude_dirs).select(relative.alias("path"), "size", "mtime"), config)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _file_system(uri)
        for b in batches:
            begin, held, texts = 0, 0, []
            for i, path in enumerate(b.column(0).to_pylist()):
                try:
                    with fs.open_input_stream(f"{base}/{path}") as f:
                        texts.append(f.read().decode("utf-8", errors="ignore"))
                except OSError:
                    texts.append(None)
                held += len(texts[-1] or "")
                if held > READ_BYTES or i == b.num_rows - 1:
                    part = b.slice(begin, i + 1 - begin)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["path", "size", "mtime", "src"])
                    begin, held, texts = i + 1, 0, []

    return meta.mapInArrow(read, "path string, size long, mtime double, src string")
