"""The entry works without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_entry_without_corpus_operators(tmp_path):
    for x in ("basewise", "tests"):
        shutil.copytree(ROOT / x, tmp_path / x, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for x in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(ROOT / x, tmp_path / x)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) >= 90 and not any(k == 'pipeline' or k.startswith('op') for k in [*q, *s]); print(len(q))"
    for extra in (False, True):  # with and without corpus_pipeline.py
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
        if not extra:
            (tmp_path / "corpus_pipeline.py").unlink()
