"""The rest works without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def child(args, where, timeout=300):
    """Runs Python there, without this repository's own folder among its paths; its output stands in the message of a failure."""
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.realpath(p) != os.path.realpath(ROOT)]
    ran = subprocess.run([sys.executable, *args], cwd=where, env=os.environ | {"PYTHONPATH": os.pathsep.join([str(where), *paths])}, timeout=timeout, capture_output=True, text=True)
    assert ran.returncode == 0, f"{args}: status {ran.returncode}\n{ran.stdout[-6000:]}\n{ran.stderr[-3000:]}"
    return ran.stdout


def test_entry_without_llm(tmp_path):
    shutil.copytree(f"{ROOT}/quarrylight", tmp_path / "quarrylight", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    child(["-c", "import __spark_entry__ as e; assert 'bm25_topk' in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"], tmp_path)
    # The other tests are found, and some of them run, without the subpackage.
    options = ["-q", "-p", "no:cacheprovider", "--rootdir", str(tmp_path), "-c", os.devnull]
    found = child(["-m", "pytest", "tests", "--collect-only", *options], tmp_path)
    assert "test_query_matches_sql[bm25_code]" in found and "tests/llm/" not in found
    child(["-m", "pytest", "tests/test_chunking.py", *options], tmp_path)


def test_other_import_errors_are_not_swallowed(tmp_path):
    shutil.copytree(f"{ROOT}/quarrylight", tmp_path / "quarrylight", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    (tmp_path / "quarrylight/llm/queries.py").write_text("import a_module_that_is_not_there\n") if (tmp_path / "quarrylight/llm").is_dir() else pytest.skip("no such subpackage")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    told = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=env, timeout=120, capture_output=True, text=True)
    assert told.returncode and "a_module_that_is_not_there" in told.stderr
