"""Every registered query of the engine against its SQL on the smallest tables."""

import duckdb
import pytest

from mesalith.plans import registry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df, columns):
    return sorted(repr([None if v is None or v != v else v for v in r]) for r in df[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLES:
        want = duck.execute(registry.ORACLES[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert rows(got, columns) == rows(want, columns)
    else:
        assert len(got) > 0


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100


def test_oracles_are_sql():
    import __spark_entry__ as e

    assert all(isinstance(sql, str) for sql in e.oracle_sql().values())


def test_engine_stands_alone(tmp_path):
    """Without the training-data operators and their pipeline, the driver's module imports and has the other queries."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "mesalith"), tmp_path / "mesalith", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') and '_' in k and k[2].isdigit() for k in e.queries()))"], cwd=tmp_path, env={"PATH": os.environ["PATH"], "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    n, other = out.stdout.split()
    # without both folders, the other tests are found and quick ones pass
    shutil.copytree(os.path.join(root, "tests"), tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    for more in (["--collect-only"], ["-k", "test_contract or test_oracles_are_sql"]):
        ran = subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests", *more], cwd=tmp_path, env=env, capture_output=True, text=True)
        assert ran.returncode == 0, ran.stdout
    assert int(n) == len(registry.QUERIES) and other == "False"
