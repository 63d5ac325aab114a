"""Registered queries against their SQL twins on the smallest tables."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.queries())
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    verdict, _, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert verdict.startswith(("ok", "rows-only")) and "types" not in verdict, verdict


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry_needs_no_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))


@pytest.mark.parametrize("left", [[], ["corpus_pipeline.py"]])
def test_rest_works_without_the_text_preparation(tmp_path, left):
    """A copy without its folders (and, or not, the pipeline) registers all
    other queries."""
    repo = os.path.dirname(os.path.abspath(entry.__file__))
    for name in ["__spark_entry__.py", *left]:
        shutil.copy(f"{repo}/{name}", tmp_path)
    for name in ["symptia", "checks"]:
        shutil.copytree(f"{repo}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert not set(e.oracle_sql()) - set(e.queries()); print(*e.queries())"
    out = subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, capture_output=True, text=True).stdout.split()
    assert out == [n for n in entry.queries() if n != "pipeline" and not n.startswith("op")]
