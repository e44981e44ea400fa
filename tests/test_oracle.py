"""Every named query against its SQL, on the smallest tables; those without SQL against what must hold."""

import pytest

import oracle
from millrace.plans import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
SLOW = {"girvan_newman_communities", "model_cf_full", "model_cf", "hybrid_switch", "bfr_rounds", "bfr_labels"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert not oracle.differences(QUERIES[name](spark, FOLDER), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
