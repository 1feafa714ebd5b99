"""The library without its training-data part."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e, bench; q, o = e.queries(), e.oracle_sql(); assert 'lsh_pairs' in q and set(o) <= set(q); assert not [k for k in q if k.startswith('op') or k == 'pipeline']"


def copy(to, *without):
    shutil.copytree(REPO, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", "*.json"))
    for x in without:
        path = to / x
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    return to


def imports(at, code=CODE):
    return subprocess.run([sys.executable, "-c", code], cwd=at, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(at)})


def test_imports_without_the_training_data_part(tmp_path):
    for i, without in enumerate((("twinfold/llm", "tests/llm"), ("twinfold/llm", "tests/llm", "corpus_pipeline.py"))):
        got = imports(copy(tmp_path / str(i), *without))
        assert got.returncode == 0, got.stderr


def test_errors_inside_the_part_are_raised(tmp_path):
    at = copy(tmp_path / "x")
    if (at / "twinfold/llm/queries.py").exists():
        (at / "twinfold/llm/queries.py").write_text("import no_such_module\n")
        assert "no_such_module" in imports(at).stderr
