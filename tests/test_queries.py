"""Registered queries against their SQL on the smallest tables, and the registry without the llm package."""

import os
import subprocess
import sys

import duckdb
import pytest

from palimpsest.plans import more_queries  # noqa: F401
from palimpsest.plans import queries as Q

DATA = "/root/testdata/sf0.001"
NAMES = [n for n in Q.QUERIES if n in Q.SQL]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test data is not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = Q.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    listed = ", ".join(f'"{c}"' for c in cols)
    assert got == sorted(map(repr, con.sql(f"SELECT {listed} FROM ({Q.SQL[name]})").fetchall()))


@pytest.mark.parametrize("name", ["o03_replace", "o04_redact_items"])
def test_items_are_made_once(spark, tmp_path, name):
    """Nothing that a row of an item needs is written out, and run, in several places of the plan; rows of texts with no, one and many spans are those of the SQL."""
    texts = ["a@b.co, é <c.d+e@f-g.example.org>", "", None, "no address, but an @", "no sign", " ".join(f"ü{k} u{k}@host{k % 7}.net" for k in range(500)), "x@y.com"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = Q.QUERIES[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
    listed = ", ".join(df.columns)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(f"SELECT {listed} FROM ({Q.SQL[name]})").fetchall()
    assert len(want) == 503 and sorted(map(tuple, df.collect())) == sorted(want)


def test_registry_without_llm(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['palimpsest.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'o13_redact_email' in e.queries() and not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
