from __future__ import annotations

import os

from corpusloom.streaming import watch


def test_watch_takes_new_and_changed_files(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def one(): pass")
    (src / "skip.lock").write_text("x")
    run = lambda: watch.watch(spark, str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    run()
    assert {r.path: r.functions for r in watch.latest(spark, str(tmp_path / "out")).collect()} == {"a.py": ["one"]}
    (src / "b.py").write_text("def two(): pass")
    os.utime(src / "b.py", (2e9, 2e9))
    run()
    assert {r.path for r in watch.latest(spark, str(tmp_path / "out")).collect()} == {"a.py", "b.py"}
