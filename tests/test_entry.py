"""The driver contract holds without the llm part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(n.startswith('op') or n == 'pipeline' for n in e.queries()))"


@pytest.mark.parametrize("gone", [("tidemark/llm", "corpus_pipeline.py"), ("tidemark/llm",)])
def test_entry_without_the_llm_part(tmp_path, gone):
    for name in ("tidemark", "__spark_entry__.py", "corpus_pipeline.py"):
        source = REPO / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    for name in gone:
        path = tmp_path / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    said = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    queries, oracles, llm = map(int, said.stdout.split())
    assert queries > 70 and oracles > 60 and llm == 0
