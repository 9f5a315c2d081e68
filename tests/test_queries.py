"""Every query of the library against its oracle, on the smallest tables."""

import os

import duckdb
import pytest

from ledgerloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLES[name]).fetchall()
    names = [d[0] for d in duck.description]
    assert sorted(names) == sorted(got.columns)
    plain = lambda v: v.date() if hasattr(v, "date") else v
    mine = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=repr)
    assert mine == sorted((tuple(map(plain, r)) for r in want), key=repr)


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_plans_prune_and_push(spark):
    plan = registry.QUERIES["weighted_yield"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" in plan and "l_shipdate" not in plan and "p_name" not in plan and "Python" not in plan
