"""The registered queries against their SQL, and their plans."""

import pytest

from __spark_entry__ import oracle_sql, queries
from moderata.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
NATIVE = ("op1_sharding", "op9_fingerprints", "op10_license_scan")


def test_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    ok, n, _, _, why = compare(spark, connect(SF), name, QUERIES[name], ORACLES.get(name), SF)
    assert ok is not False, why
    assert n > 0


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "MapInPandas"))
