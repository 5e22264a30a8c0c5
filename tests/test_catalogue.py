"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from graphloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(df):
    one = lambda v: "" if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    names = sorted(df.columns)
    return names, sorted(str([one(v) for v in row]) for row in df[names].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_like_sql(spark, sql, name):
    assert plain(catalogue.QUERIES[name](spark, SF).toPandas()) == plain(sql.execute(catalogue.ORACLES[name]).fetchdf())


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_imports_need_no_session():
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], capture_output=True, text=True, cwd=__spark_entry__.__file__.rpartition("/")[0])
    assert out.returncode == 0, out.stderr
