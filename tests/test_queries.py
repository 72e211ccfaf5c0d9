"""Every query over the small tables against its oracle."""

import pytest

from pagemill.plans import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracle(name, spark, sf, same_as_oracle):
    same_as_oracle(Q.QUERIES[name](spark, sf), Q.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_runs(name, spark, sf):
    assert Q.QUERIES[name](spark, sf).count() > 0
