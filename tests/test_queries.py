"""Every query of the core against its SQL."""

import os
import shutil
import subprocess
import sys

import pytest

from fanloom.plans import files_and_streams, pipelines, problems, programs, relational, text_reports, weblog_report
from tests import oracle

MODULES = [problems, weblog_report, text_reports, relational, programs, pipelines, files_and_streams]
WITH_SQL = [(m, n) for m in MODULES for n in m.ORACLE]
WITHOUT = [(m, n) for m in MODULES for n in m.QUERIES if n not in m.ORACLE]


@pytest.fixture(scope="module")
def con():
    return oracle.connection()


@pytest.mark.parametrize("module, name", WITH_SQL, ids=[n for _, n in WITH_SQL])
def test_query_matches_sql(spark, con, module, name):
    oracle.same(module.QUERIES[name](spark, oracle.DATA), con, module.ORACLE[name])


def test_every_query_has_sql():
    assert WITHOUT == []


def test_every_sql_belongs_to_a_query():
    for m in MODULES:
        assert set(m.ORACLE) <= set(m.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_only_an_absent_subpackage_is_passed_over(tmp_path):
    """Without the folder the entry has the core's queries; with a fault inside it, it does not load."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/fanloom", tmp_path / "fanloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    run = lambda: subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert int(run().stdout) == sum(len(m.QUERIES) for m in MODULES)
    os.mkdir(tmp_path / "fanloom" / "llm")
    (tmp_path / "fanloom" / "llm" / "__init__.py").write_text("")
    (tmp_path / "fanloom" / "llm" / "queries.py").write_text("import nothing_of_that_name\n")
    assert "nothing_of_that_name" in run().stderr
