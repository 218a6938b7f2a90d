"""Every registered graph query against its SQL on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from weftgraph.plans import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(q.ORACLES))
def test_agrees_with_sql(spark, duck, name):
    df = q.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = duck.execute(q.ORACLES[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == names
    want = Counter(tuple(plain(r[order.index(c)]) for c in names) for r in found.fetchall())
    assert Counter(tuple(plain(r[c]) for c in names) for r in df.collect()) == want
    assert want, "a comparison of nothing with nothing"


@pytest.mark.parametrize("name", [n for n in q.QUERIES if n not in q.ORACLES])
def test_runs(spark, name):
    assert q.QUERIES[name](spark, SF).collect() is not None


def test_stars_read_one_table_and_no_python(spark):
    df = q.QUERIES["bgp_star"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "Python" not in plan
    for name in ("compile_customer_triples", "sparql_filter_numeric", "bgp_three_hop"):
        assert "BatchEvalPython" not in q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
