"""The driver contract, with and without the training-data operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert set(s) <= set(q); print(len(q), 'pipeline' in q, any(k.startswith('op') for k in q))"


def _run(where: Path) -> list[str]:
    env = os.environ | {"PYTHONPATH": "", "PYTHONDONTWRITEBYTECODE": "1"}
    return subprocess.run([sys.executable, "-c", COUNT], cwd=where, env=env, capture_output=True, text=True, check=True).stdout.split()


def test_entry_without_the_training_data_operators(tmp_path):
    shutil.copytree(REPO, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    n, pipeline, ops = _run(tmp_path / "copy")
    assert int(n) > 100 and (pipeline, ops) == ("False", "False")
    if (REPO / "corpus_pipeline.py").exists() and (REPO / "flowquarry" / "llm").is_dir():
        whole, pipeline, ops = _run(REPO)
        assert int(whole) == int(n) + 14 and (pipeline, ops) == ("True", "True")
