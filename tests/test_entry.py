"""The driver's contract, with and without the subpackage for training data."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_contract(spark):
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and all(callable(f) for f in names.values())
    assert entry.entry(spark).count() > 0


def test_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.parquet", "spark-warehouse"))
    code = "import __spark_entry__ as e, sys; q = e.queries(); e.oracle_sql(); assert not any(n.startswith('op') or n == 'pipeline' for n in q) and 'pretoken_count' in q; assert not any('llm' in m for m in sys.modules if m.startswith('lexmill'))"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})


def test_with_a_subpackage_that_cannot_be_imported(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.parquet", "spark-warehouse"))
    for folder in ("lexmill/llm", "."):
        (copy / folder).mkdir(exist_ok=True)
    (copy / "lexmill/llm/__init__.py").write_text("import a_module_that_is_not_there\n")
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert 'pretoken_count' in q and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})


def test_nothing_else_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "lexmill")):
        for f in files:
            if f.endswith(".py") and os.sep + "llm" not in folder:
                assert "llm" not in open(os.path.join(folder, f)).read()
