import pytest

from tests.conftest import SF
from tests.duck import connect, spark_rows, sql_rows
from tideline.plans.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, tmp_path, name):
    df = QUERIES[name](spark, SF)
    if name not in ORACLE:
        assert df.count() > 0
        return
    assert spark_rows(df, str(tmp_path / "out"), duck) == sql_rows(duck, ORACLE[name])


def test_regression_constant(spark):
    assert QUERIES["materialize_state"](spark, SF).count() == 12


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 12
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_llm_parts(tmp_path):
    """The rest imports, and its tests run, when the folders of the llm operators are gone."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "tideline"), tmp_path / "tideline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'materialize_state' in q and not any(k.startswith('op1') for k in q) and 'pipeline' not in q"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
    shutil.copytree(os.path.join(root, "tests"), tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_apply.py", "tests/test_sources.py", "tests/test_queries.py", "-k", "not without and (test_apply or test_sources or entry or regression)"], cwd=tmp_path, check=True, env=env)


def test_the_whole_log_is_replayed(spark, monkeypatch):
    from tideline.plans import state

    seen, fold = [], state.apply.apply_changes
    monkeypatch.setattr(state.apply, "apply_changes", lambda log, *a, **k: seen.append(log) or fold(log, *a, **k))
    QUERIES["replay_idempotent"](spark, SF)
    assert {r["count"] for r in seen[0].groupBy("seq").count().collect()} == {2}
