import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from lexmill import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def canon(names, found):
    at = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(None if r[k] is None else r[k] + 0.0 if isinstance(r[k], float) else r[k] for k in at) for r in found) if all(None not in r for r in found) else sorted((tuple(r[k] for k in at) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_against_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, DATA)
    found = con.execute(catalogue.ORACLE[name])
    names, want = [d[0] for d in found.description], found.fetchall()
    assert sorted(got.columns) == sorted(names)
    assert canon(got.columns, [tuple(r) for r in got.collect()]) == canon(names, want)
    assert want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry_without_the_subpackage(tmp_path):
    """The entry still imports, with the other queries, where the subpackage and its pipeline are gone."""
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "lexmill", tmp_path / "lexmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
    assert [int(x) for x in said] == [len(catalogue.QUERIES), len(catalogue.ORACLE)]
