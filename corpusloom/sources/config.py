"""Project configuration: a YAML file with defaults, its validation, and profiles."""

from __future__ import annotations

from dataclasses import dataclass, field, replace  # noqa: F401
from pathlib import Path

from corpusloom.functions.rules import RuleConfig
from corpusloom.sources.scan import ScanConfig, gitignore_lines

try:
    import yaml
except ImportError:  # the parser is an optional dependency
    yaml = None

CONFIG_FILE = "corpusloom.yaml"


@dataclass(frozen=True)
class ProjectConfig:
    exclude_dirs: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)
    include_patterns: list[str] = field(default_factory=list)
    extra_names: list[str] = field(default_factory=list)
    max_depth: int = 8
    max_workers: int = 0
    chunk_max_tokens: int = 800
    output_dir: str = "."
    output_formats: list[str] = field(default_factory=lambda: ["toon", "html", "md"])
    security_enabled: bool = True
    instruction_file: str = ""
    git_include_logs: bool = False
    git_logs_count: int = 10
    git_include_diffs: bool = False
    git_sort_by_changes: bool = False
    git_sort_max_commits: int = 100
    rules: RuleConfig = RuleConfig()

    def scan(self, root: str) -> ScanConfig:
        return ScanConfig(
            self.exclude_dirs, self.exclude_patterns, self.include_patterns, self.extra_names, gitignore_lines(root)
        )


def _with_confidence(rows, default: float) -> list[tuple[str, str, float]]:
    return [(r[0], r[1], float(r[2]) if len(r) > 2 else default) for r in rows or []]


def from_dict(data: dict) -> ProjectConfig:
    """Configuration of a parsed mapping; keys that are missing keep their defaults."""
    git, text = data.get("git") or {}, data.get("text_files") or {}
    plain = "exclude_dirs exclude_patterns include_patterns max_depth max_workers chunk_max_tokens output_dir output_formats instruction_file"
    given = {k: data[k] for k in plain.split() if data.get(k) is not None}
    given |= {f"git_{k}": git[k] for k in "include_logs logs_count include_diffs sort_by_changes sort_max_commits".split() if k in git}
    pair = lambda v: (v, 1.0) if isinstance(v, str) else (v[0], float(v[1]))
    rules = RuleConfig(
        segment_rules=_with_confidence(data.get("type_segment_rules"), 0.9),
        name_rules=_with_confidence(data.get("type_name_rules"), 0.75),
        suffix_rules={k: pair(v) for k, v in (data.get("type_suffix_rules") or {}).items()},
        exact_name_rules={k: pair(v) for k, v in (data.get("type_exact_name_rules") or {}).items()},
        domain_overrides=dict(data.get("domain_overrides") or {}),
        criticality_overrides=dict(data.get("criticality_overrides") or {}),
    )
    enabled = bool((data.get("security") or {}).get("enabled", True))
    return ProjectConfig(extra_names=list(text.get("extra_names") or []), security_enabled=enabled, rules=rules, **given)


def _read(root: str) -> tuple[dict | None, str]:
    """The file's mapping (None if there is none) and what is wrong with it."""
    f = Path(root) / CONFIG_FILE
    if not f.is_file():
        return {}, ""
    if yaml is None:
        return None, "no YAML parser is installed"
    try:
        data = yaml.safe_load(f.read_text(encoding="utf-8"))
    except (OSError, UnicodeDecodeError, yaml.YAMLError) as e:
        return None, str(e)
    if data is not None and not isinstance(data, dict):
        return None, f"{CONFIG_FILE} is no mapping at its top level"
    return data or {}, ""


def load(root: str) -> ProjectConfig:
    """Configuration of a project; defaults where the file is missing or bad."""
    return from_dict(_read(root)[0] or {})


def validate(root: str) -> tuple[bool, str]:
    data, wrong = _read(root)
    return data is not None, wrong or "ok"


def apply_profile(config: ProjectConfig, profile: str) -> ProjectConfig:
    """``fast``, ``standard``, ``deep`` or ``security`` preset."""
    match profile:
        case "fast":
            return replace(
                config,
                max_depth=min(config.max_depth, 4),
                chunk_max_tokens=min(config.chunk_max_tokens, 400),
                max_workers=min(config.max_workers or 4, 8),
            )
        case "deep":
            return replace(
                config, max_depth=max(config.max_depth, 12), chunk_max_tokens=max(config.chunk_max_tokens, 1200)
            )
        case "security":
            return replace(config, security_enabled=True)
        case "standard":
            return config
    raise ValueError(f"unknown profile {profile!r}")
