"""The driver's contract, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 70


def test_entry_works_without_the_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/gradewalk", tmp_path / "gradewalk", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; q = e.queries(); assert 'hbi_grid' in q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr


def test_nothing_outside_imports_the_subpackage():
    for folder, _, names in os.walk(f"{ROOT}/gradewalk"):
        if "/llm" in folder:
            continue
        for n in names:
            if n.endswith(".py"):
                with open(f"{folder}/{n}", encoding="utf-8") as f:
                    assert "gradewalk.llm" not in f.read(), n
