"""The driver contract, with and without the optional subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["path", "priority_score", "fan_in", "domain", "criticality", "blast_radius"]
    assert df.count() == 10


def test_nothing_else_imports_the_optional_subpackage():
    needle = "corpusloom" + ".llm"
    for p in (ROOT / "corpusloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert needle not in p.read_text(), p


def test_imports_without_the_optional_subpackage(tmp_path):
    shutil.copytree(ROOT / "corpusloom", tmp_path / "corpusloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hotspots' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
    # a leftover pipeline file without the subpackage is no error either
    if (ROOT / "corpus_pipeline.py").is_file():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
