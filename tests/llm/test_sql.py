"""Every llm query that has SQL against it, on the smallest tables."""

import oracle
import pytest

from millrace.llm import queries as Q

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, name):
    assert not oracle.differences(Q.queries()[name](spark, FOLDER), oracle.connect(FOLDER), Q.oracle_sql()[name])
