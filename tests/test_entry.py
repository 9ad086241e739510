"""The driver's contract holds where the llm subpackage is not there."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_without_llm(tmp_path, with_pipeline):
    skipped = shutil.ignore_patterns("llm", "__pycache__", ".git", *(() if with_pipeline else ("corpus_pipeline.py",)))
    there = tmp_path / "copy"
    shutil.copytree(ROOT, there, ignore=skipped)
    told = "import __spark_entry__ as e; a, b = e.queries(), e.oracle_sql(); assert len(a) > 50 and set(b) <= set(a); assert not any(x.startswith('op') and x[2].isdigit() or x == 'pipeline' for x in a)"
    subprocess.run([sys.executable, "-c", told], cwd=there, check=True, env={**os.environ, "PYTHONPATH": ""})


def test_nothing_else_imports_llm():
    for path in (ROOT / "tallyweave").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
