"""The driver's contract, and every core query against its SQL."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from gapfold.plans import registry

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, db, name):
    df = registry.queries()[name](spark, DATA)
    cur = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and {f"p{n}_found" for n in (1, 2, 4, 5)} <= set(q)


def test_core_does_not_need_text_operators():
    code = "import sys; sys.modules['gapfold.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('p8') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for folder, _, files in os.walk(os.path.join(ROOT, "gapfold")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "gapfold.llm" not in open(os.path.join(folder, f)).read()
