"""The driver's contract holds, also without the text operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
import bench

ROOT = Path(__file__).resolve().parent.parent


def test_flagship_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_and_headline_has_its_query():
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names
    assert {n for n in bench.HEADLINE if not n.startswith(("op", "pipeline"))} <= names


def test_the_rest_imports_without_the_text_operators(tmp_path):
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__, bench; n = __spark_entry__.queries(); assert n and not any(x.startswith('op1_') for x in n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"}, timeout=120)
