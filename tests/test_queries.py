"""Every registered query against its DuckDB oracle (small scale) and the entry point."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from dunegrid.plans import QUERIES
from tests.conftest import SF_SMALL

TABLES = "lineitem embeddings region nation customer".split()


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def n(v):
        if isinstance(v, float):
            return round(v, 6)
        if hasattr(v, "item"):
            return n(v.item())
        return v
    return sorted((tuple(n(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(k for k in E.oracle_sql() if k in QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    a = _norm([tuple(r) for r in df.collect()], df.columns)
    b = _norm(res.fetchall(), dcols)
    assert len(a) == len(b)
    assert a == b


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["c", "r", "ndvi"]
    assert df.count() >= 0


def test_every_query_has_ops():
    assert all(q.ops for q in QUERIES.values())


def test_package_reaches_python_workers_from_any_cwd(tmp_path):
    """The driver may import the entry module from another folder: the Arrow
    steps must still find the package on the workers (shipped with addPyFile)."""
    import os
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import sys; sys.path.insert(0, %r)\n"
            "from pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled','false').getOrCreate()\n"
            "import __spark_entry__ as E\n"
            "print('ROWS', E.queries()['focal_median'](s, '/root/testdata/sf0.001').count())\n") % repo
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True,
                         text=True, timeout=600)
    assert "ROWS 200" in out.stdout, out.stderr[-2000:]
