from __future__ import annotations

import importlib
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]


def test_entry_runs(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_stands_without_the_pipeline(tmp_path):
    """As when tidemark/llm and corpus_pipeline.py are gone."""
    for path in [ROOT / "__spark_entry__.py", *(p for p in (ROOT / "tidemark").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts)]:
        to = tmp_path / path.relative_to(ROOT)
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_text(path.read_text())
    code = "import __spark_entry__ as e; assert 'cube' in e.queries() and not [k for k in e.queries() if k.startswith('op') or k == 'pipeline']; assert set(e.oracle_sql()) == set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=True, timeout=120)
