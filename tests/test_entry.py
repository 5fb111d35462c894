import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_stands_without_the_language_model_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; assert 'iv_ranking' in e.queries() and 'pipeline' not in e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})


def test_nothing_else_imports_them():
    for folder, _, files in os.walk(os.path.join(ROOT, "riskloom")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "riskloom.llm" not in open(os.path.join(folder, f)).read(), f
