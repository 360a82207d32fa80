"""The entry point with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def keys(root):
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*sorted(q))"
    env = {**os.environ, "PYTHONPATH": "", "PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return set(done.stdout.split())


def test_without_the_operators(tmp_path):
    bare = tmp_path / "repo"
    shutil.copytree(ROOT, bare, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse", ".pytest_cache"))
    left = keys(bare)
    whole = keys(ROOT)
    assert left and not any(k == "pipeline" or k.startswith("op") and k[2].isdigit() for k in left)
    assert left <= whole


def test_nothing_else_imports_the_operators():
    for folder, _, names in os.walk(ROOT):
        if f"{os.sep}llm" in folder or ".git" in folder:
            continue
        for name in names:
            if name.endswith(".py") and name not in ("corpus_pipeline.py", "__spark_entry__.py", "test_entry.py"):
                text = open(os.path.join(folder, name)).read()
                assert "tidewater.llm" not in text and "from .llm" not in text and "import llm" not in text, name
