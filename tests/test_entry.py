"""The driver contract where the training-data operators are left out."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAYS = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), sorted(set(e.oracle_sql()) - set(e.queries())))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_imports_without_them(tmp_path, pipeline):
    copy = tmp_path / "copy"
    left = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, copy, ignore=left)
    assert not (copy / "answerlab" / "llm").exists()
    done = subprocess.run([sys.executable, "-c", SAYS], cwd=copy, env={"PATH": ""}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    count, has_pipeline, extra = done.stdout.split(" ", 2)
    assert int(count) > 50 and has_pipeline == "False" and extra.strip() == "[]"
    collected = subprocess.run(
        [sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=copy, capture_output=True, text=True, timeout=300
    )
    assert collected.returncode == 0, collected.stdout
