"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from lodestone.plans import catalogue
from lodestone.session import TABLES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=repr)
    if name in catalogue.ORACLE_SQL:
        r = duck.sql(catalogue.ORACLE_SQL[name])
        at = [list(r.columns).index(c) for c in columns]
        assert sorted(r.columns) == columns
        assert rows == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)


def test_entry_imports_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "lodestone", tmp_path / "lodestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and int(said.stdout.split()[-2]) == len(catalogue.QUERIES)
