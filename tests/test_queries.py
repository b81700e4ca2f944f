"""Every registered query against its SQL, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
# Several fits each; the driver runs them as well.
SLOW = {"cv_train", "train_baseline_char", "retrain"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_registry():
    assert set(oracle_sql()) <= set(queries())
    # Fitted coefficients have no SQL counterpart; nor have some pipeline operators.
    own = {n for n in queries() if n != "pipeline" and not n.startswith("op")}
    assert own - set(oracle_sql()) == {"train_baseline", "train_baseline_char"}


def test_entry(spark):
    out = entry(spark)
    assert out.count() == 2 and "macro_f1" in out.columns


OWN = [n for n in queries() if n != "pipeline" and not n.startswith("op")]  # the others are tested in tests/llm


@pytest.mark.parametrize("name", [n for n in OWN if n not in SLOW])
def test_query(spark, con, name):
    ok, n, _, _, why = compare(spark, con, name, queries()[name], oracle_sql().get(name), SF)
    assert ok is not False, why
    assert n > 0
