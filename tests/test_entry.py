"""The driver's contract holds with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(q.startswith('op') or q == 'pipeline' for q in e.queries()))"


@pytest.mark.parametrize("gone", [("palimpsest/llm", "tests/llm"), ("palimpsest/llm", "tests/llm", "corpus_pipeline.py")])
def test_queries_load_without_the_corpus_operators(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in gone:
        target = tmp_path / "copy" / name
        if target.is_dir():
            shutil.rmtree(target)
        elif target.exists():
            target.unlink()
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    queries, sql, corpus = map(int, out.stdout.split())
    assert queries > 100 and sql > 90 and corpus == 0


def test_oracle_names_are_queries():
    import __spark_entry__ as e

    assert e.oracle_sql().keys() <= e.queries().keys()
